"""Ordered operators: ranks of sources, labels of gaps, chains, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# How kinds of sources rank, best first.
SOURCE_RANK = {"SBD": 6, "SBD.FM": 5, "MTX": 4, "AUD.FOB": 3, "AUD": 2}


def source_rank(c: Column) -> Column:
    """The library's ranking of sources (Q-1); 1 for none."""
    out = F
    for name, rank in SOURCE_RANK.items():
        out = out.when(c == name, rank)
    return out.otherwise(1)


def gap_labels(df: DataFrame, keys: list[str], order: list[str], is_mark: Column, row: str) -> DataFrame:
    """W-5: adds ``place``: start (no marked row before), end (none after) or between."""
    w = W.partitionBy(*keys).orderBy(*order)
    mark = F.when(is_mark, F.col(row))
    before = F.last(mark, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(mark, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    return df.withColumn("place", F.when(before.isNull(), "start").when(after.isNull(), "end").otherwise("between"))


def chains(df: DataFrame, keys: list[str], order: list[str], runs_on: str) -> DataFrame:
    """W-6: adds ``chain``, counting from 1: rows stay in the chain of the row before where that runs on."""
    w = W.partitionBy(*keys).orderBy(*order)
    begins = F.when(F.coalesce(F.lag(runs_on).over(w), F.lit(False)), 0).otherwise(1)
    return df.withColumn("__b", begins).withColumn("chain", F.sum("__b").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__b")


def budget(df: DataFrame, key: str, order: str, size: str, limit: int) -> DataFrame:
    """W-10: key, order, size, taken. A row that would exceed what is left is refused and takes nothing.

    A fold over the group's list, in order: it has no form as a running sum. Groups are one show's files. A null
    size counts as 0; limit 0 means none.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("s"))))
    start = F.struct(F.lit(limit).cast("long").alias("left"), F.array().cast("array<boolean>").alias("ok"))

    def step(acc: Column, x: Column) -> Column:
        fits = (x["s"] <= acc["left"]) if limit else F.lit(True)
        return F.struct(F.when(fits, acc["left"] - x["s"]).otherwise(acc["left"]).alias("left"), F.concat(acc["ok"], F.array(fits)).alias("ok"))

    g = df.groupBy(key).agg(listed.alias("l")).withColumn("ok", F.aggregate("l", start, step, lambda a: a["ok"]))
    return g.select(key, F.explode(F.arrays_zip("l", "ok")).alias("e")).select(key, F.col("e.l.o").alias(order), F.col("e.l.s").alias(size), F.col("e.ok").alias("taken"))
