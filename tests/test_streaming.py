from pyspark.sql import functions as F

from tapeloom.plans import streams
from tapeloom.sources import paged
from tapeloom.streaming import loops


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_settled_sessions_are_the_batch_ones(spark, small):
    batch, stream = rows(streams.settle_sessions(spark, small)), rows(streams.settle_stream(spark, small))
    assert stream <= batch and len(batch) - len(stream) < 0.1 * len(batch)  # the last sessions stay open


def test_pair_wait(spark, small):
    batch, stream = rows(streams.pair_wait(spark, small)), rows(streams.pair_wait_stream(spark, small))
    assert stream <= batch and len(batch) - len(stream) < 10


def test_judged_once_and_upserts(spark, small):
    assert streams.judged_once(spark, small).count() == spark.read.parquet(f"{small}/releases.parquet").select("indexer", "release_id").distinct().count()
    want = spark.read.parquet(f"{small}/events.parquet").groupBy("user_id").agg(F.max("event_id"), F.max_by("value", "event_id"))
    assert rows(streams.upsert_stream(spark, small)) == rows(want)


def test_keyed_table_rewrites_touched_buckets_only(spark, tmp_path):
    schema, home = "k long, v long", f"file://{tmp_path}/t"
    apply = loops.keyed_table(home, "k", schema, lambda df: df.groupBy("k").agg(F.max("v").alias("v")), buckets=4)
    assert loops.read_keyed(spark, home, schema).count() == 0
    first = spark.createDataFrame([(i, 1) for i in range(20)], schema)
    apply(first, 0)
    apply(spark.createDataFrame([(3, 2)], schema), 1)
    apply(spark.createDataFrame([(3, 2)], schema), 1)  # given again
    assert rows(loops.read_keyed(spark, home, schema)) == {(i, 2 if i == 3 else 1) for i in range(20)}
    assert sum("data-1" in r["path"] for r in spark.read.parquet(f"{home}/snapshot-1").collect()) == 1


def test_runs_by_an_interval_and_goes_on(spark, tmp_path):
    home, schema = f"file://{tmp_path}/run", "id long"
    for part in range(2):
        spark.range(part * 10, part * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in.parquet")
        q = loops.run_every(spark.readStream.schema(schema).parquet(f"{tmp_path}/in.parquet"), home, "1 second")
        q.processAllAvailable()
        q.stop()
        assert rows(spark.read.schema(schema).parquet(f"{home}/out")) == {(i,) for i in range(part * 10 + 10)}


def test_first_sight_within_a_time(spark, small):
    s = loops.file_stream(spark, small, "releases", spark.read.parquet(f"{small}/releases.parquet").schema).select("indexer", "release_id", F.col("first_seen").cast("timestamp").alias("t"))
    got = loops.drain(loops.first_sight(s, ["indexer", "release_id"], "t", "3650 days"))
    assert got.count() == spark.read.parquet(f"{small}/releases.parquet").select("indexer", "release_id").distinct().count()


def test_requests_and_pages(spark, tmp_path):
    df = spark.createDataFrame([(i, "x", f"r{i}", ("a" if i % 2 else "b", f"20{i:02d}-01-01" if i else None)) for i in range(40)], "id long, indexer string, release_id string, data struct<artist:string,added:string>")
    df.orderBy("id").coalesce(1).write.option("parquet.block.row.count.limit", 8).option("parquet.block.size", 1).parquet(f"{tmp_path}/r")
    spark.dataSource.register(paged.PagedIndex)
    read = lambda **o: {r["id"] for r in spark.read.format("paged_index").options(path=f"{tmp_path}/r", **o).load().collect()}
    assert read() == set(range(1, 40)) and read(since="2035-01-01", rows=2) == {35, 36, 37, 38, 39} and read(artist="a", since="2036-01-01") == {37, 39} and read(since="2100") == set()
    assert len(paged.requests(f"{tmp_path}/r", "2100")) == 0


def test_failures_lock(spark, small):
    got = streams.failure_lock_stream(spark, small)
    assert got.count() == spark.read.parquet(f"{small}/events.parquet").filter("event_type = 'error'").count()
    assert got.filter("locked").count() == got.filter("recent >= 3").count()


def test_paged_stream_reads_everything_once(spark, small):
    spark.dataSource.register(paged.PagedIndex)
    s = spark.readStream.format("paged_index").option("path", f"{small}/releases.parquet").option("rows", 40).load()
    q = s.writeStream.format("memory").queryName("paged").start()
    q.processAllAvailable()
    q.stop()
    known = spark.read.parquet(f"{small}/releases.parquet").filter("data.added is not null")
    assert spark.table("paged").count() == known.count()


def test_marks(spark):
    df = spark.createDataFrame([("a", "2020-01-02T10:00:00"), ("a", "2020-01-01"), ("b", None)], "artist string, added string")
    assert rows(loops.marks(df, "artist", "added")) == {("a", "2020-01-02", 2), ("b", None, 1)}
