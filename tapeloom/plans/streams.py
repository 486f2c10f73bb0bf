"""Streaming operators (T-…): what the loops leave behind, in batch with SQL and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tapeloom.plans.base import release_fields
from tapeloom.plans.registry import Family
from tapeloom.streaming import loops
from tapeloom.tables import shared_folder, table

family = Family()
query = family.query


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream; the session's zone gives their times."""
    return loops.file_stream(spark, d, "events", table(spark, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


_GAP = "interval 6 hour"


@query("T-2", sql=f"""with e as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as prev from events), g as (select user_id, ts, sum(case when prev is null or ts - prev >= {_GAP} then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as s from e)
 select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_seen, count(*) as n from g group by user_id, s""")
def settle_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Activity of a user parted by six hours of quiet."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), "n")


@query("T-2", "T-1", sql=f"""with e as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as prev from events), g as (select user_id, ts, sum(case when prev is null or ts - prev >= {_GAP} then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as s from e)
 select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_seen, count(*) as n from g group by user_id, s having max(ts) + {_GAP} <= (select max(ts) - interval 10 minute from events)""")
def settle_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same as a stream: all sessions that the watermark has closed."""
    got = loops.drain(loops.settled(_events(spark, d).select("user_id", "ts"), "user_id", "ts", "6 hours"))
    return got.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), "n")


@query("T-3", sql="""select a.user_id, a.event_id as early_id, b.event_id as late_id from events a left join events b on b.user_id = a.user_id and b.event_type = 'purchase' and b.ts >= a.ts and b.ts <= a.ts + interval 120 minute where a.event_type = 'click'""")
def pair_wait(spark: SparkSession, d: str) -> DataFrame:
    """Clicks with the purchases of two hours after, or alone. The range join meets in blocks of two hours."""
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_type")
    span = 7_200_000_000
    a = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("early_id"), F.col("t").alias("t1"), F.explode(F.array(F.floor(F.col("t") / span), F.floor(F.col("t") / span) + 1)).alias("block"))
    b = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("late_id"), F.col("t").alias("t2"), F.floor(F.col("t") / span).alias("block"))
    hit = a.join(b, ["user_id", "block"]).filter((F.col("t2") >= F.col("t1")) & (F.col("t2") <= F.col("t1") + span)).select("early_id", "late_id")
    return e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("early_id")).join(hit, "early_id", "left").select("user_id", "early_id", "late_id")


@query("T-3", sql="""with m as (select least(max(ts) filter (where event_type = 'click'), max(ts) filter (where event_type = 'purchase')) - interval 10 minute as mark from events)
 select a.user_id, a.event_id as early_id, b.event_id as late_id from events a left join events b on b.user_id = a.user_id and b.event_type = 'purchase' and b.ts >= a.ts and b.ts <= a.ts + interval 120 minute cross join m where a.event_type = 'click' and (b.event_id is not null or a.ts + interval 120 minute < m.mark)""")
def pair_wait_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same as a join of two streams."""
    side = lambda k: _events(spark, d).filter(F.col("event_type") == k).select("user_id", F.col("event_id").alias("id"), "ts")
    return loops.drain(loops.paired_or_alone(side("click"), side("purchase"), "user_id"))


@query("T-4", "T-5", sql="select artist, strftime(max(cast(added as timestamp)), '%Y-%m-%d') as mark, count(*) as n from {RELEASES} where artist is not null and added is not null group by artist")
def high_water_marks(spark: SparkSession, d: str) -> DataFrame:
    """The day up to which each artist was read."""
    return loops.marks(release_fields(spark, d).filter("artist is not null and added is not null"), "artist", "added")


@query("T-4", sql="with m as (select artist, max(left(added, 10)) as mark from {RELEASES} where id % 2 = 0 group by artist) select r.id from {RELEASES} r left join m on m.artist = r.artist where r.added is not null and (m.mark is null or left(r.added, 10) >= m.mark) and r.id % 2 = 1")
def incremental_read(spark: SparkSession, d: str) -> DataFrame:
    """What an inclusive mark lets through of the rows not read before."""
    r = release_fields(spark, d)
    m = r.filter("id % 2 = 0").groupBy("artist").agg(F.max(F.substring("added", 1, 10)).alias("mark"))
    return r.filter("id % 2 = 1 and added is not null").join(m, "artist", "left").filter(F.col("mark").isNull() | (F.substring("added", 1, 10) >= F.col("mark"))).select("id")


@query("T-6", "T-7", sql="select distinct indexer, release_id from releases")
def judged_once(spark: SparkSession, d: str) -> DataFrame:
    """Releases streamed with their repeated rows: every key comes out once."""
    s = loops.file_stream(spark, d, "releases", table(spark, d, "releases").schema).select("indexer", "release_id")
    return loops.drain(loops.first_sight(s, ["indexer", "release_id"]))


@query("T-6", "M-4", "SNK-1", sql="with r as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id desc) as k from events) select user_id, event_id, value from r where k = 1")
def upsert_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events upserted batch by batch into a keyed table: the last value of every user, each snapshot complete."""
    home = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    merge = lambda rows: rows.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))
    loops.drain(_events(spark, d).select("user_id", "event_id", "value"), each=loops.keyed_table(home, "user_id", "user_id long, event_id long, value double", merge))
    return loops.read_keyed(spark, home, "user_id long, event_id long, value double")


@query("T-12", "W-13", sql="with e as (select user_id, least(3, count(*) over (partition by user_id order by ts range between interval 6 day preceding and current row)) as recent from events where event_type = 'error') select user_id, recent, recent >= 3 as locked from e")
def failure_lock_stream(spark: SparkSession, d: str) -> DataFrame:
    """Failures and locks with a bounded state per user."""
    got = loops.drain(loops.locked_out(_events(spark, d).filter("event_type = 'error'"), "user_id", "ts", most=3, seconds=6 * 86400, lock=3600))
    return got.select(F.col("key").alias("user_id"), "recent", (F.col("locked_until") > 0).alias("locked"))


@query("T-9", "X-45", sql="select event_type, count(*) as n from events where ts < (select max(ts) from events) - interval 15 day group by event_type")
def expiry_sweep(spark: SparkSession, d: str) -> DataFrame:
    """What a sweep removes."""
    e = table(spark, d, "events").select("event_type", "ts")
    newest = e.agg(F.max("ts").alias("newest"))
    return e.crossJoin(F.broadcast(newest)).filter(F.expr("ts < newest - interval 15 days")).groupBy("event_type").agg(F.count("*").alias("n"))  # one row


@query("T-11", "A-22", sql="select event_type as outcome, count(*) as n, min(event_id) as first from events group by event_type")
def run_totals(spark: SparkSession, d: str) -> DataFrame:
    """A run's outcomes."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("outcome")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("extra: sliding windows", sql="""select strftime(time_bucket(interval 1 day, ts), '%Y-%m-%d') as day, event_type, count(*) as n from events group by all""")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts by day. Spark-native; no counterpart in the reference."""
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("extra: cube", sql="select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by cube (o_orderstatus, o_orderpriority)")
def cube_totals(spark: SparkSession, d: str) -> DataFrame:
    """A cube. Spark-native; no counterpart in the reference."""
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("extra: as-of", sql="select a.event_id, b.event_id as last_view from events a asof left join (select * from events where event_type = 'view') b on a.user_id = b.user_id and a.ts >= b.ts where a.event_type = 'purchase'")
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    """Purchases with the user's last view before. Spark-native; no counterpart in the reference."""
    e = table(spark, d, "events").filter("event_type in ('purchase', 'view')").select("user_id", "event_id", "ts", "event_type")
    w = W.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1)).rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("last_view", last).filter("event_type = 'purchase'").select("event_id", "last_view")


QUERIES, ORACLE, COVERS = family.queries, family.oracle, family.covers
