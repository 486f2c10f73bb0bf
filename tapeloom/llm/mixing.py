"""Problem 8: mixing sources to target weights.

Method: temperature mixing. A source's weight starts as its target and is tilted towards its natural
token share: weight ~ target^(1-t) * share^t, the exponent t of the token shares being bisected to the
least value at which no source has to repeat its texts more often than it may (t = 0 is the target
itself, t = 1 the natural mix, in which nothing repeats). Without targets the weight is share^t and t is
bisected to a wanted entropy. A source that cannot reach its target even with every text used as often
as allowed is pinned at what it has, and the others share the rest; with targets within reach, t stays 0.

The weights are realised as budgeted block permutations: a source's budget is laid out as whole passes
over its texts, then one pass that stops where the budget does. Each pass is a permutation by a seeded
hash. The stopping place is found by a prefix sum over hash blocks (sums per block, then rows within a
block); a source has as many blocks as its texts need, so that one that holds a third of all rows is spread
over many tasks. Whether a source reaches its target is read from the mix as realised.

What is broadcast or collected has one row per source of the targets, never per text. Sources without a target
are counted, and not collected, however many there are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tapeloom.llm import tokens
from tapeloom.tables import cut, table, whole_rows

#: Texts of a hash block, about.
BLOCK_ROWS = 50_000
#: Halvings of the exponent's interval.
STEPS = 60


def bisect(fails, low: float = 0.0, high: float = 1.0) -> float:
    """The least t in [low, high] at which ``fails(t)`` is false, if it turns false only once."""
    if not fails(low):
        return low
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if fails(mid) else (low, mid)
    return high


def entropy(weights: dict) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def tempered(shares: dict, t: float) -> dict:
    """Shares to the power t, summing to 1. Sources without tokens get no weight."""
    raw = {s: q**t if q > 0 else 0.0 for s, q in shares.items()}
    total = sum(raw.values()) or 1.0
    return {s: r / total for s, r in raw.items()}


def temperature_for_entropy(shares: dict, wanted: float) -> float:
    """The exponent at which the tempered shares have the wanted entropy (nearest end if none has)."""
    return bisect(lambda t: entropy(tempered(shares, t)) > wanted, 0.0, 16.0)


def weigh(sizes: dict[str, int], targets: dict[str, float], repeats: dict[str, int], total: int | None = None) -> tuple[dict[str, float], set[str], float]:
    """Weights of a mix of ``total`` tokens (all sources together, if not given); the sources pinned at all they have; the exponent."""
    total = sum(sizes.values()) if total is None else total
    most = {s: sizes.get(s, 0) * repeats[s] / total if total else 0.0 for s in targets}
    short = {s for s in targets if most[s] < targets[s]}
    weights, pinned, t = {s: most[s] for s in short}, set(short), 0.0
    free = set(targets) - pinned
    while free:
        room = max(0.0, 1.0 - sum(weights[s] for s in pinned))

        def at(t: float, free: set = free, room: float = room) -> dict[str, float]:
            raw = {s: targets[s] ** (1 - t) * (sizes.get(s, 0) / total) ** t if targets[s] and sizes.get(s, 0) else 0.0 for s in free}
            return {s: r * room / (sum(raw.values()) or 1.0) for s, r in raw.items()}

        over = lambda t: any(w > most[s] * (1 + 1e-12) for s, w in at(t).items())  # noqa: E731, B023
        t = bisect(over)
        if not over(t):
            return weights | at(t), short, t
        full = {s for s, w in at(1.0).items() if w >= most[s]}
        weights |= {s: most[s] for s in full}
        pinned |= full
        free -= full
    return weights, short, t


def _sized(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(key, "source", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("long").alias("n_tokens"))


def mix(docs: DataFrame, targets: DataFrame, seed: int = 8, key: str = "doc_id", block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The mix and the report on it.

    ``docs`` has a row per text: key, source, n_tokens; ``targets`` a row per source: source, target_share,
    max_repeats. A null or negative size counts as 0; such texts are never used. A source without target is
    not used, but its tokens count for the size of the mix; a target without texts is reported as out of reach.

    The mix: source, key, n_tokens, uses (1 or more). The report: source, target_share, weight, tokens_held,
    tokens_used, actual_share (of the mix as realised), largest_repeat, reachable (false where every text was used
    as often as it may be and the tokens used still fall short of the target).
    """
    spark = docs.sparkSession
    docs = _sized(docs, key)
    want = [(r["source"], float(r["target_share"] or 0.0), max(0, int(r["max_repeats"] or 0))) for r in targets.select("source", "target_share", "max_repeats").distinct().collect()]
    per_source = cut(docs.groupBy("source").agg(F.sum("n_tokens").alias("held"), F.count("*").alias("n")))
    total = per_source.agg(F.sum("held")).first()[0] or 0
    listed = spark.createDataFrame([(s,) for s, _, _ in want], "source string")
    found = {r["source"]: (r["held"], r["n"]) for r in per_source.join(F.broadcast(listed), "source", "left_semi").collect()}  # one row per target
    held = {s: n for s, (n, _) in found.items()}
    share = {s: t for s, t, _ in want}
    repeats = {s: n for s, _, n in want}
    weights, _, _ = weigh(held, share, repeats, total)
    plan = []
    for s in share:
        budget, size = round(weights.get(s, 0.0) * total), held.get(s, 0)
        passes = min(budget // size, repeats[s]) if size else 0
        rest = min(budget - passes * size, size) if passes < repeats[s] else 0
        plan.append((s, share[s], repeats[s], weights.get(s, 0.0), passes, rest, size, -(-found[s][1] // block_rows) if s in found else 1))
    plan_df = spark.createDataFrame(plan, "source string, target_share double, most int, weight double, passes long, rest long, tokens_held long, blocks long")
    placed = docs.join(F.broadcast(plan_df), "source").withColumn("h", F.xxhash64(F.lit(seed), key)).withColumn("block", F.pmod("h", "blocks"))
    before = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("sum")).select("source", "block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    inner = W.partitionBy("source", "block").orderBy("h", key).rowsBetween(W.unboundedPreceding, W.currentRow)
    used = (
        placed.withColumn("upto", F.sum("n_tokens").over(inner))
        .join(starts, ["source", "block"])
        .withColumn("uses", F.col("passes") + (F.col("start") + F.col("upto") <= F.col("rest")).cast("long"))
        .filter("uses > 0 and n_tokens > 0")
        .select("source", key, "n_tokens", "uses")
    )
    actual = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens_used"), F.max("uses").alias("largest_repeat"))
    report = plan_df.join(actual, "source", "left").fillna(0, ["tokens_used", "largest_repeat"])
    spent = F.col("tokens_used") >= F.col("tokens_held") * F.col("most")
    short = (F.col("tokens_used") < F.col("target_share") * F.lit(float(total))) | ((F.lit(total) == 0) & (F.col("target_share") > 0))
    sum_all = F.sum("tokens_used").over(W.partitionBy())  # over one row per source
    report = report.select(
        "source",
        "target_share",
        F.round("weight", 6).alias("weight"),
        "tokens_held",
        "tokens_used",
        F.coalesce(F.round(F.try_divide("tokens_used", sum_all), 6), F.lit(0.0)).alias("actual_share"),
        "largest_repeat",
        (~(spent & short)).alias("reachable"),
    )
    return used, report


def mix_to_entropy(docs: DataFrame, targets: DataFrame, wanted: float, seed: int = 8, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The same without target shares: the sources of ``targets`` (source, max_repeats) get their natural shares to the
    power that gives the wanted entropy, in nats."""
    names = [r["source"] for r in targets.select("source").distinct().collect()]
    sums = _sized(docs, key).join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("held"))
    held = {r["source"]: r["held"] for r in sums.collect()}  # one row per target
    total = sum(held.values()) or 1
    shares = {s: held.get(s, 0) / total for s in names}
    tempered_shares = tempered(shares, temperature_for_entropy(shares, wanted))
    listed = docs.sparkSession.createDataFrame(list(tempered_shares.items()), "source string, target_share double")
    return mix(docs, targets.select("source", "max_repeats").distinct().join(listed, "source"), seed, key)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = whole_rows(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    return cut(tokens.sizes(documents, ("doc_id", "source")))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix(_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that do not reach their target share in the mix."""
    return _mixed(spark, sf_dir)[1].filter("not reachable").select("source")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    return _mixed(spark, sf_dir)[1]


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix: every text used, and how often."""
    return _mixed(spark, sf_dir)[0]


def p8_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on a mix of natural shares, tempered to the entropy that the target shares have."""
    targets = table(spark, sf_dir, "mix_targets")
    wanted = entropy({r["source"]: r["target_share"] or 0.0 for r in targets.collect()})
    return mix_to_entropy(_documents(spark, sf_dir), targets, wanted)[1]


QUERIES = {q.__name__: q for q in (p8_found, p8_report, p8_mix, p8_entropy)}
