"""Ordered analytics (W-…), sorting and limits (O-…), set operations (U-…)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tapeloom.functions import text
from tapeloom.operators import nested, sequences, shows
from tapeloom.plans.base import release_fields, show_fields, show_tracks
from tapeloom.plans.problems import P1_TRACKS_SQL
from tapeloom.plans.registry import Family
from tapeloom.tables import table

family = Family()
query = family.query

_RANK_SQL = "case source_type when 'SBD' then 6 when 'SBD.FM' then 5 when 'MTX' then 4 when 'AUD.FOB' then 3 when 'AUD' then 2 else 1 end"
_N = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


@query("W-1", "Q-1", sql=f"""with r as (select id, {_N.format('artist')} as a, date, {_RANK_SQL} as rank from {{RELEASES}} where artist is not null and date <> '') select id, rank from (select *, max(rank) over (partition by a, date) as best from r) where rank = best""")
def best_by_rank_keep_ties(spark: SparkSession, d: str) -> DataFrame:
    """Of an act's night, the releases of the best kind of source; equal ones all stay. The best is an aggregate, joined back."""
    r = release_fields(spark, d).filter("artist is not null and date <> ''").select("id", text.norm_key(F.col("artist")).alias("a"), "date", sequences.source_rank(F.col("source_type")).alias("rank"))
    return r.join(r.groupBy("a", "date").agg(F.max("rank").alias("best")), ["a", "date"]).filter("rank = best").select("id", "rank")


@query("W-3", "W-4", sql="""with e as (select user_id, event_id, event_type, lag(event_type) over w as prev, lead(event_type) over w as next from events window w as (partition by user_id order by ts, event_id)),
 f as (select *, (prev is null or next is null or prev <> event_type or next <> event_type) as edge from e)
 select user_id, event_id, edge, coalesce(lag(edge) over w2, false) or coalesce(lead(edge) over w2, false) as beside from f window w2 as (partition by user_id order by event_id)""")
def edges_and_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Where a run begins or ends, and the rows beside such an edge."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    prev, nxt = F.lag("event_type").over(w), F.lead("event_type").over(w)
    f = e.withColumn("edge", prev.isNull() | nxt.isNull() | (prev != F.col("event_type")) | (nxt != F.col("event_type")))
    w2 = W.partitionBy("user_id").orderBy("event_id")
    beside = F.coalesce(F.lag("edge").over(w2), F.lit(False)) | F.coalesce(F.lead("edge").over(w2), F.lit(False))
    return f.select("user_id", "event_id", "edge", beside.alias("beside"))


@query("W-5", "R-9", sql="""with e as (select user_id, event_id, event_type, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as before,
 first_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between 1 following and unbounded following) as after from events)
 select user_id, event_id, case when before is null then 'start' when after is null then 'end' else 'between' end as place from e where event_type = 'error'""")
def gap_labels(spark: SparkSession, d: str) -> DataFrame:
    """A row's label by the nearest rows of a kind before and after it."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return sequences.gap_labels(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", "event_id").filter("event_type = 'error'").select("user_id", "event_id", "place")


@query("W-6", "X-49", sql=f"""with t as (select *, lag(coalesce(segue, false)) over (partition by show_id, part_no order by track_no) as prev from ({P1_TRACKS_SQL})),
 g as (select *, sum(case when prev then 0 else 1 end) over (partition by show_id, part_no order by track_no) as chain from t)
 select show_id, part_no, cast(chain as bigint) as chain, coalesce(string_agg(title, ' > ' order by track_no), '') as title, count(*) as tracks from g group by show_id, part_no, chain""")
def segue_groups(spark: SparkSession, d: str) -> DataFrame:
    """Tracks chained by segues, numbered as groups: a new one begins where the track before does not run on."""
    t = show_tracks(spark, d).select("show_id", "part_no", "track_no", "title", F.coalesce("segue", F.lit(False)).alias("segue"))
    return sequences.chains(t, ["show_id", "part_no"], ["track_no"], "segue").groupBy("show_id", "part_no", "chain").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("track_no", "title"))), lambda x: x["title"]), " > ").alias("title"), F.count("*").alias("tracks")
    )


@query("W-6", sql="""with e as (select user_id, event_id, ts, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as prev from events),
 g as (select *, sum(case when prev is null or prev <> event_type then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from e)
 select user_id, cast(island as bigint) as island, min(event_type) as event_type, count(*) as n from g group by user_id, island""")
def islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal events of one user."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    prev = F.lag("event_type").over(w)
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type").withColumn("start", (prev.isNull() | (prev != F.col("event_type"))).cast("long"))
    g = e.withColumn("island", F.sum("start").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return g.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


@query("W-7", "X-34", sql="""with l as (select doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) as line, generate_subscripts(string_split(replace(text, chr(13), ''), chr(10)), 1) as n from documents),
 r as (select doc_id, n, line, sum(case when regexp_matches(line, '^Set [0-9]') then 1 else 0 end) over (partition by doc_id order by n rows unbounded preceding) as set_no from l)
 select doc_id, cast(set_no as bigint) as set_no, count(*) as lines from r where set_no > 0 group by doc_id, set_no""")
def set_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a text under the set they stand in: a running sum of the headings above."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n", -1)).alias("n", "line"))
    w = W.partitionBy("doc_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    r = lines.withColumn("set_no", F.sum(F.col("line").rlike("^Set [0-9]").cast("long")).over(w))
    return r.filter("set_no > 0").groupBy("doc_id", "set_no").agg(F.count("*").alias("lines"))


@query("W-8", sql="""with e as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as prev from events) select user_id, event_id, event_type from e where prev is null or prev <> event_type""")
def adjacent_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Rows that differ from the one before them."""
    prev = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("prev", prev).filter(F.col("prev").isNull() | (F.col("prev") != F.col("event_type"))).select("user_id", "event_id", "event_type")


@query("W-9", "SNK-8", sql="""with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as place from orders) select o_custkey, o_orderkey, place from r where place <= 10""")
def keep_newest(spark: SparkSession, d: str) -> DataFrame:
    """The newest ten per key. The filter on the rank limits each group already before the shuffle."""
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, d, "orders").withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 10").select("o_custkey", "o_orderkey", "place")


@query("W-10", "R-25", "Q-12", sql="""with recursive d as (select show_id, doc_id, coalesce(n_chars, 0) as n_chars, row_number() over (partition by show_id order by doc_id) as k from documents where show_id is not null),
 r as (select show_id, doc_id, n_chars, k, n_chars <= 4000 as taken, case when n_chars <= 4000 then 4000 - n_chars else 4000 end as room from d where k = 1
  union all select d.show_id, d.doc_id, d.n_chars, d.k, d.n_chars <= r.room, case when d.n_chars <= r.room then r.room - d.n_chars else r.room end from r join d on d.show_id = r.show_id and d.k = r.k + 1)
 select show_id, doc_id, n_chars, taken from r""")
def budget_fold(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a source taken in order while a budget lasts; what would exceed it is refused and takes nothing."""
    docs = table(spark, d, "documents").filter("show_id is not null").select("show_id", "doc_id", "n_chars")
    return sequences.budget(docs, "show_id", "doc_id", "n_chars", 4000)


@query("W-12", "SNK-4", sql="""with n as (select p_partkey, p_type as name, row_number() over (partition by p_type order by p_partkey) as k from part) select p_partkey, case when k = 1 then name else name || ' (' || k || ')' end as dest from n""")
def collision_suffix(spark: SparkSession, d: str) -> DataFrame:
    """Equal names told apart by " (2)" and so on."""
    k = F.row_number().over(W.partitionBy("p_type").orderBy("p_partkey"))
    return table(spark, d, "part").withColumn("k", k).select("p_partkey", F.when(F.col("k") == 1, F.col("p_type")).otherwise(F.concat("p_type", F.lit(" ("), "k", F.lit(")"))).alias("dest"))


@query("W-13", "T-12", sql="""with e as (select user_id, event_id, ts, count(*) over (partition by user_id order by ts range between interval 30 day preceding and current row) as recent from events where event_type = 'error') select user_id, event_id, recent, recent >= 5 as locked from e""")
def failure_window(spark: SparkSession, d: str) -> DataFrame:
    """Failures of a user within the window before each, and whether they lock."""
    e = table(spark, d, "events").filter("event_type = 'error'").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    n = F.count("*").over(W.partitionBy("user_id").orderBy("t").rangeBetween(-30 * 86_400_000_000, 0))
    return e.select("user_id", "event_id", n.alias("recent")).withColumn("locked", F.col("recent") >= 5)


@query("O-1", "F-1", sql="select id, release_id from {RELEASES} where status = 'wanted' order by updated_at desc nulls last, id limit 50 offset 20")
def status_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of the newest rows of one status."""
    return release_fields(spark, d).filter("status = 'wanted'").orderBy(F.col("updated_at").desc_nulls_last(), "id").offset(20).limit(50).select("id", "release_id")


@query("O-2", sql="select event_id, event_type from events order by event_id desc limit 300")
def log_page(spark: SparkSession, d: str) -> DataFrame:
    """The newest entries of a log: a top-k, not a full sort."""
    return table(spark, d, "events").orderBy(F.desc("event_id")).limit(300).select("event_id", "event_type")


@query("O-3", sql="select name, row_number() over (order by lower(name), name) as place from monitored_artists")
def name_order(spark: SparkSession, d: str) -> DataFrame:
    """Names in order without regard to case; a fixed, small list."""
    m = table(spark, d, "monitored_artists")
    return m.select("name", F.row_number().over(W.orderBy(F.lower("name"), "name")).cast("long").alias("place"))


@query("O-4", "O-5", "O-7", sql="""select id, artist, row_number() over (order by case when owned then 1 else 0 end desc, downloads * 10000 + id desc nulls last, id) as place from {RELEASES} order by 3 limit 40""")
def composite_sort(spark: SparkSession, d: str) -> DataFrame:
    """Several keys, a computed one, blanks last, and a tie-break: the first forty."""
    key = [F.desc(F.coalesce(F.col("owned").cast("int"), F.lit(0))), (F.col("downloads").cast("long") * 10000 + F.col("id")).desc_nulls_last(), F.asc("id")]
    top = release_fields(spark, d).orderBy(*key).limit(40)
    return top.select("id", "artist", F.row_number().over(W.orderBy(*key)).cast("long").alias("place"))


@query("O-6", sql="""select source_type, count(*) as n, min(case source_type when 'SBD' then 1 when 'MTX' then 2 when 'AUD' then 3 else 99 end) as place from {RELEASES} group by source_type""")
def custom_rank_order(spark: SparkSession, d: str) -> DataFrame:
    """A listed order, unknown values last."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ("SBD", "MTX", "AUD"))), F.col("source_type")), F.lit(0)), F.lit(99)).cast("int")
    return release_fields(spark, d).groupBy("source_type").agg(F.count("*").alias("n"), F.min(place).alias("place"))


@query("O-9", sql="select artist_norm, array_to_string(list_slice(list(title order by rid), 1, 6), '|') as first_titles from song_titles group by artist_norm")
def stable_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The first six of a list, in order. Only six rows per group reach the list."""
    first = table(spark, d, "song_titles").withColumn("k", F.row_number().over(W.partitionBy("artist_norm").orderBy("rid"))).filter("k <= 6")
    return first.groupBy("artist_norm").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rid", "title"))), lambda x: x["title"]), "|").alias("first_titles"))


@query("O-10", "SRC-5", sql="""with r as (select show_id, doc_id, row_number() over (partition by show_id order by doc_id) as k, count(*) over (partition by show_id) as n from documents where show_id is not null) select show_id, doc_id from r where (k - 1) % greatest(1, n // 4) = 0 and (k - 1) // greatest(1, n // 4) < 4""")
def strided_sample(spark: SparkSession, d: str) -> DataFrame:
    """Up to four rows of a group at even steps (a sample is what is asked for)."""
    t = table(spark, d, "documents").filter("show_id is not null").select("show_id", "doc_id")
    k, n = F.row_number().over(W.partitionBy("show_id").orderBy("doc_id")) - 1, F.count("*").over(W.partitionBy("show_id"))
    r = t.withColumn("k", k).withColumn("step", F.greatest(F.lit(1), F.floor(n / 4)))
    return r.filter("k % step = 0 and k / step < 4").select("show_id", "doc_id")


@query("U-1", sql="""with a as (select norm as k, name, 1 as prio from artists union all select regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), name, 2 from monitored_artists) select k, arg_max(name, prio) as name from a group by k""")
def keyed_union(spark: SparkSession, d: str) -> DataFrame:
    """Two keyed lists, the later one winning."""
    a = table(spark, d, "artists").select(F.col("norm").alias("k"), "name", F.lit(1).alias("prio"))
    b = table(spark, d, "monitored_artists").select(text.norm_key(F.col("name")).alias("k"), "name", F.lit(2).alias("prio"))
    return a.unionByName(b).groupBy("k").agg(F.max_by("name", "prio").alias("name"))


@query("U-2", sql="select 'show' as kind, show_id as id, artist, null as title from {SHOWS} union all select 'release', id, artist, title from {RELEASES}")
def typed_listing(spark: SparkSession, d: str) -> DataFrame:
    """Two listings of different columns under each other."""
    a = show_fields(spark, d).select(F.lit("show").alias("kind"), F.col("show_id").alias("id"), "artist")
    b = release_fields(spark, d).select(F.lit("release").alias("kind"), "id", "artist", "title")
    return a.unionByName(b, allowMissingColumns=True)


@query("U-4", sql="select name from artists except select artist from {RELEASES}")
def names_never_released(spark: SparkSession, d: str) -> DataFrame:
    """A set difference."""
    return table(spark, d, "artists").select("name").subtract(release_fields(spark, d).select(F.col("artist").alias("name")))


@query("U-6", sql=f"select show_id, list(concat_ws('|', part_no, title) order by part_no, track_no) as tracks from ({P1_TRACKS_SQL}) where part_no > 0 group by show_id")
def joined_track_lists(spark: SparkSession, d: str) -> DataFrame:
    """The tracks of a show's parts as one list, the part as the disc."""
    t = show_tracks(spark, d).filter("part_no > 0")
    item = F.struct("part_no", "track_no", "title")
    return t.groupBy("show_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat_ws("|", x["part_no"], x["title"])).alias("tracks"))


_MODEL = (*shows.SHOW_FIELDS, "tracks", "parts")


@query("U-7", sql=f"with k as (select distinct unnest(json_keys(meta)) as field from shows where json_valid(meta) and json_type(meta) = 'OBJECT') select field, field in {_MODEL} as known from k")
def unknown_columns(spark: SparkSession, d: str) -> DataFrame:
    """The fields that the records have, from their merged schema, and whether the model knows them."""
    docs = nested.parse_documents(table(spark, d, "shows").select("meta"), "meta").filter(F.schema_of_variant("doc").startswith("OBJECT"))
    return spark.createDataFrame([(name, name in _MODEL) for name, _ in nested.schema_fields(nested.merged_schema(docs))], "field string, known boolean")


QUERIES, ORACLE, COVERS = family.queries, family.oracle, family.covers
