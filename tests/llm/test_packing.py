import random

import pytest

from tapeloom.llm import packing


def check(rows, items, capacity):
    used, seen = {}, {}
    for r in rows:
        if r["container_id"] is not None:
            spans = used.setdefault(r["container_id"], [])
            spans.append((r["offset"], r["offset"] + r["n_tokens"]))
        seen.setdefault(r["id"], []).append((r["token_start"], r["n_tokens"]))
    for spans in used.values():
        spans.sort()
        assert spans[-1][1] <= capacity and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    for key, size in items.items():
        pieces = sorted(seen[key])
        assert sum(n for _, n in pieces) == size and (len(pieces) == 1 or size > capacity)
        assert all(a[0] + a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
    return len(used)


@pytest.mark.parametrize("seed", range(3))
def test_packing_is_whole_and_tight(spark, seed):
    random.seed(seed)
    items = {i: random.choice([random.randint(1, 400), 33, random.randint(1, 64)]) for i in range(400)} | {1000: 0, 1001: 300}
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in items.items()], "id long, n_tokens long, rank string, rest int")
    n = check(packing.pack(df, "id", capacity=100).collect(), items, 100)
    assert n <= 1.06 * -(-sum(items.values()) // 100) + 1


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 200), (4, 100), (5, 201)], "id long, n_tokens long")
    rows = packing.pack(df, "id", capacity=100).collect()
    check(rows, {1: 0, 2: 0, 3: 200, 4: 100, 5: 201}, 100)
    assert packing.pack(df.filter("false"), "id", capacity=100).count() == 0


@pytest.mark.parametrize("block_rows", [50_000, 100])
def test_hot_size(spark, block_rows):
    df = spark.range(5000).selectExpr("id", "30L as n_tokens")
    assert check(packing.pack(df, "id", capacity=100, block_rows=block_rows).collect(), dict.fromkeys(range(5000), 30), 100) == -(-5000 // 3)


def test_plan_does_not_grow_with_the_items():
    random.seed(1)
    sizes = [random.randint(1, 2048) for _ in range(2000)]
    few = {s: 3 for s in sizes}
    many = {s: 3000 for s in sizes}
    assert len(packing.sweep(many, 2048)[0]) < 60_000 and len(packing.sweep(many, 2048)[0]) < 12 * len(packing.sweep(few, 2048)[0])
