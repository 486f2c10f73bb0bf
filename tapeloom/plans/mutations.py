"""Mutations (M-…) as plans: what a table holds after a batch of changes, decided by keyed aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.operators import changes
from tapeloom.plans.base import release_fields
from tapeloom.plans.registry import Family
from tapeloom.tables import table

family = Family()
query = family.query


@query("M-1", "SNK-1", sql="select coalesce(c.o_orderkey, b.o_orderkey) as o_orderkey, coalesce(c.o_orderstatus, b.o_orderstatus) as o_orderstatus, b.o_orderpriority from orders b full join (select o_orderkey, 'X' as o_orderstatus from orders where o_orderkey % 7 = 0) c on c.o_orderkey = b.o_orderkey")
def upsert_whitelisted(spark: SparkSession, d: str) -> DataFrame:
    """An upsert of named columns only; others keep their value."""
    base = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = base.filter("o_orderkey % 7 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit("ignored").alias("o_orderpriority"))
    return changes.upsert(base, new, ["o_orderkey"], ["o_orderstatus"])


@query("M-2", "A-16", sql="select user_id, arg_max(value, event_id) as value from events group by user_id")
def last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    """A key's last value."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"))


@query("M-4", "T-6", sql="""select indexer, release_id, min(first_seen) is not null as seen, arg_max(status, id) as status, arg_min(artist_id, id) as artist_id, count(*) as n from {RELEASES} group by indexer, release_id""")
def upsert_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Releases by key: the first sighting and owner are kept, the rest replaced."""
    r = release_fields(spark, d)
    return r.groupBy("indexer", "release_id").agg(F.min("first_seen").isNotNull().alias("seen"), F.max_by("status", "id").alias("status"), F.min_by("artist_id", "id").alias("artist_id"), F.count("*").alias("n"))


@query("M-5", sql="""with r as (select regexp_replace(lower(title), '[^a-z0-9]', '', 'g') as wrong, title, rid, confirmed from song_titles), l as (select wrong, arg_max(title, rid) as right_title, arg_max(confirmed, rid) as ok from r where wrong <> '' group by wrong) select wrong, right_title from l where ok = 1""")
def keyed_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules by key, the last one winning, and only where it stands confirmed."""
    r = table(spark, d, "song_titles").withColumn("wrong", F.regexp_replace(F.lower("title"), "[^a-z0-9]", "")).filter("wrong <> ''")
    return r.groupBy("wrong").agg(F.max_by("title", "rid").alias("right_title"), F.max_by("confirmed", "rid").alias("ok")).filter("ok = 1").drop("ok")


@query("M-6", sql="""with n as (select c_custkey as id, 1 as rev, c_mktsegment as body from customer), u as (select c_custkey as id, 1 + c_custkey % 2 as rev, 'edited' as body from customer where c_custkey % 3 = 0)
 select n.id, cast(case when u.rev = n.rev then n.rev + 1 else n.rev end as bigint) as rev, case when u.rev = n.rev then u.body else n.body end as body, u.id is not null and u.rev <> n.rev as conflict from n left join u on u.id = n.id""")
def optimistic_update(spark: SparkSession, d: str) -> DataFrame:
    """Edits that name the revision they saw: others are conflicts and change nothing."""
    notes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).cast("long").alias("rev"), F.col("c_mktsegment").alias("body"))
    edits = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), (F.lit(1) + F.col("c_custkey") % 2).alias("rev"), F.lit("edited").alias("body"))
    return changes.compare_and_set(notes, edits, "id", "rev", ["body"])


@query("M-7", sql="""select user_id as batch, event_id as seq, row_number() over (partition by user_id order by event_id desc) as step, 'dst' || event_id as src, 'src' || event_id as dst from events where event_type = 'click'""")
def undo_plan(spark: SparkSession, d: str) -> DataFrame:
    """A journal read backwards, source and destination exchanged."""
    ops = table(spark, d, "events").filter("event_type = 'click'").select(F.col("user_id").alias("batch"), F.col("event_id").alias("seq"), F.concat(F.lit("src"), "event_id").alias("src"), F.concat(F.lit("dst"), "event_id").alias("dst"))
    return changes.undo(ops, "batch", "seq")


@query("M-7", sql="""with s as (select distinct id, status, current_path, filed_path, source_hint, strftime(created_at, '%Y-%m') as batch from shows where filed_path <> ''), o as (select batch, id as seq, current_path as src, filed_path as dst, source_hint as before from s where status <> 'rejected' and right(batch, 2) <> '01'),
 p as (select filed_path as path from s where status = 'filed' union select current_path from (select distinct id, current_path, filed_path from shows) where id % 5 = 0 and current_path <> ''), m as (select distinct batch, dst from o)
 select o.batch, o.seq, row_number() over (partition by o.batch order by o.seq desc) as step, o.dst as src, o.src as dst, o.before, case when a.path is null then 'gone' when b.path is not null and m.dst is null then 'taken' end as conflict
 from o left join p a on a.path = o.dst left join p b on b.path = o.src left join m on m.batch = o.batch and m.dst = o.src""")
def undo_with_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """The filings of each month undone: what is gone or whose place is taken is listed, months undone before (January) stay as they are."""
    s = table(spark, d, "shows").select("id", "status", "current_path", "filed_path", F.col("source_hint").alias("before"), F.date_format("created_at", "yyyy-MM").alias("batch")).distinct()
    filed = s.filter("filed_path <> ''")
    ops = filed.filter("status <> 'rejected'").select("batch", F.col("id").alias("seq"), F.col("current_path").alias("src"), F.col("filed_path").alias("dst"), "before")
    present = filed.filter("status = 'filed'").select(F.col("filed_path").alias("path")).unionByName(s.filter("id % 5 = 0 and current_path <> ''").select(F.col("current_path").alias("path")))
    return changes.undo(ops, "batch", "seq", present, ops.filter("batch like '%-01'").select("batch"))


@query("M-8", sql="select status, folder_name as src, min(id) as id from (select distinct id, status, folder_name from shows) group by status, folder_name")
def dry_run_plan(spark: SparkSession, d: str) -> DataFrame:
    """Operations recorded and not done, each once per kind and source."""
    return table(spark, d, "shows").select("id", "status", F.col("folder_name").alias("src")).groupBy("status", "src").agg(F.min("id").alias("id"))


@query("M-9", "F-25", "X-45", sql="select event_type, count(*) filter (where event_id % 10 <> 0) as live, count(*) filter (where event_id % 10 = 0) as deleted, count(*) filter (where event_id % 10 = 0 and ts < (select max(ts) from events) - interval 10 day) as purged from events group by event_type")
def soft_delete(spark: SparkSession, d: str) -> DataFrame:
    """Tombstones: live rows, deleted ones, and those past their time."""
    e = table(spark, d, "events").select("event_type", "ts", (F.col("event_id") % 10 == 0).alias("gone"))
    newest = e.agg(F.max("ts").alias("newest"))
    x = e.crossJoin(F.broadcast(newest))  # one row
    return x.groupBy("event_type").agg(F.count_if(~F.col("gone")).alias("live"), F.count_if(F.col("gone")).alias("deleted"), F.count_if(F.col("gone") & F.expr("ts < newest - interval 10 days")).alias("purged"))


@query("M-10", sql="select status, case status when 'planned' then 'pending' when 'error' then 'pending' else status end as next, count(*) as n from (select distinct id, status from shows) group by all")
def bulk_transition(spark: SparkSession, d: str) -> DataFrame:
    """Rows moved from state to state at once."""
    s = table(spark, d, "shows").select("id", "status").distinct()
    return s.groupBy("status", F.when(F.col("status").isin("planned", "error"), "pending").otherwise(F.col("status")).alias("next")).agg(F.count("*").alias("n"))


@query("M-11", "A-3", sql="select norm, name, length(name) as n, 3 as schema_version from artists")
def migrated(spark: SparkSession, d: str) -> DataFrame:
    """A table taken through versioned steps, each only if its version is newer."""
    steps = [(1, lambda t: t.withColumn("k", F.lower("name"))), (2, lambda t: t.withColumn("n", F.length("name"))), (3, lambda t: t.drop("k"))]
    return changes.migrate(table(spark, d, "artists").select("norm", "name"), steps, 0)


@query("M-12", sql="select r.id, case when r.artist_id in (select id from monitored_artists where monitored = 1) then r.artist_id end as artist_id from {RELEASES} r")
def orphaned_references(spark: SparkSession, d: str) -> DataFrame:
    """References to removed parents are emptied."""
    keep = table(spark, d, "monitored_artists").filter("monitored = 1").select(F.col("id").alias("artist_id"), F.lit(True).alias("there"))
    return release_fields(spark, d).join(keep, "artist_id", "left").select("id", F.when(F.col("there"), F.col("artist_id")).alias("artist_id"))


QUERIES, ORACLE, COVERS = family.queries, family.oracle, family.covers
