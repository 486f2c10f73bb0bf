import pytest

from tapeloom.llm import mixing

SCHEMA = "doc_id long, source string, n_tokens long, uses int"


def data(spark, **sizes):
    rows = [(k * 100_000 + i, s, n, 0) for k, (s, (count, n)) in enumerate(sizes.items()) for i in range(count)]
    return spark.createDataFrame(rows, SCHEMA)


def targets(spark, **t):
    return spark.createDataFrame([(s, float(x), n) for s, (x, n) in t.items()], "source string, target_share double, max_repeats int")


def test_reachable_targets_are_met(spark):
    used, report = mixing.mix(data(spark, a=(1000, 10), b=(500, 10), c=(300, 20)), targets(spark, a=(0.2, 1), b=(0.5, 3), c=(0.3, 2)))
    got = {r["source"]: r for r in report.collect()}
    assert all(r["reachable"] and abs(r["actual_share"] - r["target_share"]) < 0.005 for r in got.values())
    assert {r["source"]: r["m"] for r in used.groupBy("source").agg({"uses": "max"}).withColumnRenamed("max(uses)", "m").collect()} == {"a": 1, "b": 3, "c": 2}


def test_short_source_gives_all_it_may(spark):
    used, report = mixing.mix(data(spark, a=(1000, 10), b=(10, 10)), targets(spark, a=(0.5, 2), b=(0.5, 3), gone=(0.0, 1), none=(0.1, 4)))
    got = {r["source"]: r for r in report.collect()}
    assert not got["b"]["reachable"] and got["b"]["tokens_used"] == 300 and not got["none"]["reachable"] and got["gone"]["reachable"]
    assert used.filter("source = 'b'").count() == 10


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 5, 0), (2, "a", None, 0), (3, "a", 0, 0), (4, "a", 7, 0)], SCHEMA)
    used, report = mixing.mix(df, targets(spark, a=(1.0, 2)))
    assert [(r["doc_id"], r["uses"]) for r in used.collect()] == [(4, 1)]
    for d, t in ((df.filter("false"), targets(spark, a=(1.0, 2))), (df, targets(spark, a=(1.0, 2)).filter("false"))):
        used, report = mixing.mix(d, t)
        assert used.count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_weights(seed):
    import random

    random.seed(seed)
    names = "abcdefg"
    sizes = {s: random.randint(1, 1000) for s in names}
    raw = {s: random.random() for s in names}
    share = {s: r / sum(raw.values()) for s, r in raw.items()}
    repeats = {s: random.randint(1, 4) for s in names}
    w, short, _ = mixing.weigh(sizes, share, repeats)
    total = sum(sizes.values())
    assert abs(sum(w.values()) - min(1, sum(sizes[s] * repeats[s] for s in names) / total)) < 1e-6
    assert all(w[s] <= sizes[s] * repeats[s] / total + 1e-9 for s in names)
    assert short == {s for s in names if sizes[s] * repeats[s] < share[s] * total}


@pytest.mark.parametrize("block_rows", [50_000, 7])
def test_blocks_change_nothing_but_the_place(spark, block_rows):
    used, report = mixing.mix(data(spark, a=(1000, 10), b=(400, 5), other=(50, 10)), targets(spark, a=(0.3, 1), b=(0.7, 2)), block_rows=block_rows)
    got = {r["source"]: (r["tokens_used"], r["reachable"]) for r in report.collect()}
    # b gives all it may, 4,000 of 12,500 tokens; a has the rest of its own.
    assert got == {"a": (8500, True), "b": (4000, False)} and used.filter("source = 'other'").count() == 0


def test_entropy_is_met(spark):
    df = data(spark, a=(900, 10), b=(90, 10), c=(10, 10))
    t = targets(spark, a=(0, 9), b=(0, 9), c=(0, 9))
    wanted = 0.7
    _, report = mixing.mix_to_entropy(df, t, wanted)
    assert abs(mixing.entropy({r["source"]: r["actual_share"] for r in report.collect()}) - wanted) < 0.01


def test_temperature():
    shares = {"a": 0.9, "b": 0.1}
    t = mixing.temperature_for_entropy(shares, 0.6)
    assert abs(mixing.entropy(mixing.tempered(shares, t)) - 0.6) < 1e-6
