"""Merging what several sources say: trust order with provenance, agreement, majority, dominance.

All are aggregates with partial aggregation before the shuffle; none ranks a whole group in one task unless
it says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tapeloom.functions.text import norm_key


def agreement(long: DataFrame, keys: list[str], field: str = "field", value: str = "value") -> DataFrame:
    """A-4: per key and field, how often the most frequent value stands, by the first 24 letters of its key.

    Null and empty values don't count; a value whose key is empty does (Q-10).
    """
    some = long.filter(F.col(value).isNotNull() & (F.col(value) != "")).withColumn("k", F.left(norm_key(F.col(value)), F.lit(24)))
    return some.groupBy(*keys, field, "k").agg(F.count("*").alias("n")).groupBy(*keys, field).agg(F.max("n").alias("agreement"))


def merge_by_trust(long: DataFrame, keys: list[str], order: list[str], special: dict[str, list[str]] | None = None) -> DataFrame:
    """R-1: per key and field, the value of the most trusted source that has one, its source, and the agreement.

    ``long`` has keys, field, source, value. ``special`` gives fields an order of their own (a date is trusted
    otherwise than a venue). Sources in no order come last, by name. Equal sources: the least value.
    """
    rank = lambda names: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col("source")), F.lit(0)), F.lit(len(names) + 1))
    place = rank(order)
    for name, own in (special or {}).items():
        place = F.when(F.col("field") == name, rank(own)).otherwise(place)
    some = long.filter(F.col("value").isNotNull() & (F.trim("value") != ""))
    best = some.groupBy(*keys, "field").agg(F.min(F.struct(place.alias("place"), "source", "value")).alias("m"))
    return best.select(*keys, "field", "m.value", "m.source").join(agreement(some, keys), [*keys, "field"])


def top_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in an order that should have no ties. For groups of aggregated rows, not of raw ones."""
    return df.withColumn("__place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__place = 1").drop("__place")


def majority(df: DataFrame, keys: list[str], value: str, least: int = 2, share: float = 0.8) -> DataFrame:
    """A-10: the value with at least ``least`` votes and ``share`` of all; keys, value, n, total. Ties have no majority unless share allows; the least value then."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    total = n.withColumn("total", F.sum("n").over(W.partitionBy(*keys)))
    return top_by(total, keys, [F.desc("n"), F.asc(value)]).filter((F.col("n") >= least) & (F.col("n") >= share * F.col("total")))


def dominant(df: DataFrame, keys: list[str], value: str, weight: str, ratio: float = 15.0) -> DataFrame:
    """A-11: the value whose greatest weight is ``ratio`` times its runner-up's, or that is alone; keys, value, weight, next."""
    best = df.groupBy(*keys, value).agg(F.max(weight).alias(weight))
    order = W.partitionBy(*keys).orderBy(F.desc(weight), F.asc(value))
    ranked = best.withColumn("next", F.lead(weight).over(order)).withColumn("__place", F.row_number().over(order)).filter("__place = 1").drop("__place")
    return ranked.filter(F.col("next").isNull() | (F.col(weight) >= ratio * F.greatest("next", F.lit(1))))
