"""Changes to tables as new snapshots: upserts, compare-and-set, undo, migration. Every key is unique in the base."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W, functions as F


def upsert(base: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """M-1: ``new``'s rows win in ``columns`` (a null there is a value of its own); other columns are never written.

    ``new`` must have one row per key. Keys only in ``new`` are inserted with nulls elsewhere.
    """
    fresh = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__new"))
    j = base.join(fresh, keys, "full")
    return j.select(*[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def compare_and_set(rows: DataFrame, edits: DataFrame, key: str, rev: str, columns: list[str]) -> DataFrame:
    """M-6: an edit that names the current revision is applied and raises it; any other is a conflict and changes nothing."""
    e = edits.select(key, F.col(rev).alias("__rev"), *[F.col(c).alias(f"__{c}") for c in columns])
    j = rows.join(e, key, "left")
    hit = F.coalesce(F.col("__rev") == F.col(rev), F.lit(False))
    return j.select(key, F.when(hit, F.col(rev) + 1).otherwise(F.col(rev)).alias(rev), *[F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns], (F.col("__rev").isNotNull() & ~hit).alias("conflict"))


def undo(ops: DataFrame, batch: str, seq: str, present: DataFrame | None = None, done: DataFrame | None = None) -> DataFrame:
    """M-7: the operations that undo each batch: last first, source and destination exchanged, other columns kept (a row's snapshot).

    ``present`` has the paths that are there (path): an operation whose file is gone, or whose place is taken by a
    file that the batch itself does not move away, is listed with its conflict. ``done`` has batches that were
    undone before: they are not undone again.
    """
    if done is not None:
        ops = ops.join(done.select(batch).distinct(), batch, "left_anti")
    step = F.row_number().over(W.partitionBy(batch).orderBy(F.desc(seq))).cast("long")
    kept = [c for c in ops.columns if c not in (batch, seq, "src", "dst")]
    back = ops.select(batch, seq, step.alias("step"), F.col("dst").alias("src"), F.col("src").alias("dst"), *kept)
    if present is None:
        return back
    there = present.select("path").distinct()
    moved = ops.select(batch, F.col("dst").alias("path"), F.lit(True).alias("moved")).distinct()
    x = back.join(there.select(F.col("path").alias("src"), F.lit(True).alias("has_src")), "src", "left").join(there.select(F.col("path").alias("dst"), F.lit(True).alias("has_dst")), "dst", "left")
    x = x.join(moved.withColumnRenamed("path", "dst"), [batch, "dst"], "left")
    conflict = F.when(F.col("has_src").isNull(), "gone").when(F.col("has_dst") & F.col("moved").isNull(), "taken")
    return x.select(batch, seq, "step", "src", "dst", *kept, conflict.alias("conflict"))


def migrate(df: DataFrame, steps: list[tuple[int, Callable[[DataFrame], DataFrame]]], version: int) -> DataFrame:
    """M-11: the steps newer than ``version``, in order. A gap or a version beyond the last step is an error."""
    numbers = [n for n, _ in steps]
    if numbers != list(range(1, len(numbers) + 1)) or version > len(numbers):
        raise ValueError(f"steps {numbers} can't bring version {version} up")
    for n, step in steps:
        df = step(df) if n > version else df
    return df.withColumn("schema_version", F.lit(numbers[-1] if numbers else version))
