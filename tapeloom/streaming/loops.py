"""The intake and monitoring loops as Structured Streaming.

Every function takes a streaming frame and gives one; :func:`drain` runs it over what is there and returns
the result as a table, with the checkpoint in the shared folder, so that a restart goes on where it stopped.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tapeloom.tables import exists, shared_folder


def file_stream(spark: SparkSession, folder: str, name: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """A table's files as a stream, in the order they came."""
    path, glob = (f"{folder}/{name}.parquet", "*.parquet") if os.path.isdir(f"{folder}/{name}.parquet") else (folder, f"{name}.parquet")
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Runs a stream over all that is there now (trigger: available now) and returns what it wrote.

    With ``each``, every micro-batch goes to that function instead, which must bear being given a batch twice.
    """
    spark = stream.sparkSession
    home = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    w = stream.writeStream.option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True)
    if each:
        w.foreachBatch(each).start().awaitTermination()
        return None
    w.outputMode(mode).format("parquet").option("path", f"{home}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


def run_every(stream: DataFrame, home: str, every: str, mode: str = "append") -> StreamingQuery:
    """T-1: starts a stream that looks for new rows every so often and appends them to ``home``/out; one run at a time.

    A run that takes longer than the interval delays the next one, and missed ones are not made up for: what they would have
    found is in the next. A restart with the same ``home`` goes on where the last run stopped.
    """
    w = stream.writeStream.option("checkpointLocation", f"{home}/checkpoint").trigger(processingTime=every)
    return w.outputMode(mode).format("parquet").option("path", f"{home}/out").start()


def keyed_table(home: str, key: str, schema: str, merge: Callable[[DataFrame], DataFrame], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """M-4, SNK-1: a function for :func:`drain` that upserts every batch into a table kept in ``home``, by buckets of the key.

    A batch rewrites the buckets that its keys fall in, and no others: each gets a new folder for the batch, and the
    batch's small list of folders, written last, is the next snapshot. ``merge`` reduces old and new rows to one for
    each key and must not mind rows given twice, so a batch that is given again writes the same snapshot again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucketed = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in bucketed.select("bucket").distinct().collect()]  # at most ``buckets``
        before = _snapshot(spark, home, number - 1)
        old = [before[b] for b in touched if b in before]
        rows = batch.unionByName(spark.read.schema(schema).parquet(*old)) if old else batch
        merged = merge(rows).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{home}/data-{number}")
        after = before | {b: f"{home}/data-{number}/bucket={b}" for b in touched}
        spark.createDataFrame(list(after.items()), "bucket int, path string").coalesce(1).write.mode("overwrite").parquet(f"{home}/snapshot-{number}")

    return apply


def _snapshot(spark: SparkSession, home: str, number: int) -> dict[int, str]:
    if number < 0:
        return {}
    return {r["bucket"]: r["path"] for r in spark.read.schema("bucket int, path string").parquet(f"{home}/snapshot-{number}").collect()}


def read_keyed(spark: SparkSession, home: str, schema: str) -> DataFrame:
    """The newest snapshot of a table kept by :func:`keyed_table`; empty if no batch came."""
    path = spark._jvm.org.apache.hadoop.fs.Path(home)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    numbers = [int(n.rpartition("-")[2]) for n in names if n.startswith("snapshot-") and exists(spark, f"{home}/{n}/_SUCCESS")]
    paths = list(_snapshot(spark, home, max(numbers, default=-1)).values())
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def settled(events: DataFrame, key: str, time: str, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """T-2: a key's sessions, each closed once nothing came for ``gap``: start, end, n.

    In a stream the last session stays open until the watermark has passed it.
    """
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def paired_or_alone(early: DataFrame, late: DataFrame, key: str, wait: str = "120 minutes", slack: str = "10 minutes") -> DataFrame:
    """T-3: every early row with the late rows of its key that came within ``wait``, or alone after that.

    Both have key, id, ts. A stream-to-stream left outer join: the time bound and the watermarks limit the state.
    """
    a = early.select(F.col(key), F.col("id").alias("early_id"), F.col("ts").alias("early_ts")).withWatermark("early_ts", slack)
    b = late.select(F.col(key).alias("__k"), F.col("id").alias("late_id"), F.col("ts").alias("late_ts")).withWatermark("late_ts", slack)
    on = (F.col(key) == F.col("__k")) & (F.col("late_ts") >= F.col("early_ts")) & (F.col("late_ts") <= F.col("early_ts") + F.expr(f"interval {wait}"))
    return a.join(b, on, "left_outer").select(key, "early_id", "late_id")


def locked_out(failures: DataFrame, key: str, time: str, most: int = 5, seconds: int = 900, lock: int = 300) -> DataFrame:
    """T-12: a row for every failure: key, t, recent, locked_until (0 if not locked), in seconds. ``most`` failures within ``seconds`` lock for ``lock`` more.

    The state of a key is the times of its last ``most`` failures, no more; it is dropped when nothing came for the
    window. Late failures are counted in the order they come.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = []
        for pdf in batches:
            for t in sorted(pdf["t"].tolist()):
                times = [x for x in times if t - x <= seconds][-(most - 1) :] + [t] if most > 1 else [t]
                rows.append((k[0], t, len(times), t + lock if len(times) >= most else 0.0))
        state.update((times,))
        state.setTimeoutTimestamp(int((max(times) + seconds) * 1000) + 1 if times else 1)
        yield pd.DataFrame(rows, columns=["key", "t", "recent", "locked_until"])

    src = failures.withWatermark(time, "1 day").select(F.col(key), F.col(time), F.unix_micros(time).cast("double").alias("m")).withColumn("t", F.col("m") / 1e6)
    kind = dict(failures.dtypes)[key]
    return src.groupBy(key).applyInPandasWithState(update, f"key {kind}, t double, recent long, locked_until double", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def first_sight(releases: DataFrame, keys: list[str], time: str | None = None, within: str = "30 days") -> DataFrame:
    """T-4, T-6: every key once, whatever is replayed.

    Without ``time`` the state is the ledger of all keys and is kept for good; with it, a key is forgotten once the
    watermark is ``within`` past its sighting, which is enough where replays come no later.
    """
    return releases.withWatermark(time, within).dropDuplicatesWithinWatermark(keys) if time else releases.dropDuplicates(keys)


def marks(rows: DataFrame, key: str, added: str) -> DataFrame:
    """T-4: per key the newest day that was read in full; the next read begins on it, the day included."""
    return rows.groupBy(key).agg(F.max(F.to_date(added)).cast("string").alias("mark"), F.count("*").alias("n"))


def windows(events: DataFrame, time: str, size: str, slide: str | None, by: str, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding counts (no counterpart in the reference)."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
