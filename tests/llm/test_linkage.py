import random

import numpy as np

from tapeloom.llm import linkage
from tapeloom.llm.canonical import near


def test_label_model_recovers_a_planted_model():
    rng = np.random.default_rng(3)
    n, right = 20000, np.array([0.95, 0.85, 0.8, 0.5])
    truth = rng.random(n) < 0.7
    votes = np.where(rng.random((n, 4)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    votes[rng.random((n, 4)) < 0.2] = 0
    votes = np.column_stack([votes, votes[:, 1]])  # a function that says what another says
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = linkage.LabelModel()
    post = model.fit(patterns, counts.astype(float), np.array([1, 1, 1, 0, 0]), np.zeros(len(patterns), bool))
    assert (1, 4) in model.factors or (4, 1) in model.factors
    best = np.log(0.7 / 0.3) + (votes[:, :4] * np.log(right / (1 - right))).sum(axis=1) > 0
    assert ((post[back.ravel()] > 0.5) == truth).mean() > (best == truth).mean() - 0.01
    assert abs(model.prior - 0.7) < 0.05


def test_never_is_respected():
    patterns = np.array([[1, 1, 1, 1], [1, -1, -1, 1], [1, 1, -1, 1], [-1, 1, 1, 1], [-1, -1, -1, 1], [-1, 1, -1, -1]])
    post = linkage.LabelModel().fit(patterns, np.array([80.0, 4, 9, 10, 12, 8]), np.ones(4), patterns[:, 0] < 0)
    assert (post[3:] == 0).all() and post[0] > 0.5


def test_pairs_of_small_tables(spark, small):
    got = linkage.p6_found(spark, small).collect()
    assert len(got) > 20 and len(set(got)) == len(got)


def test_likeness():
    assert linkage.likeness("orvan hall", "the orvan hall") == 1.0
    assert linkage.likeness("orvanik hall", "orvanki hall") == 1.0
    assert linkage.likeness("orvanik hall", "pelmundo arena") < 0.6
    assert linkage.likeness("", "x") == 0.0


def plain_vote(r):
    """The votes as one would read them off a candidate."""
    out = dict.fromkeys(linkage.FUNCTIONS, 0)
    if r["r_night"]:
        out["night"] = 1 if r["r_night"] == r["s_night"] else -1
    elif r["r_part"]:
        out["part_of_date"] = 1 if r["s_night"].startswith(r["r_part"]) else -1
    if r["s_venue_ref"] and r["r_venue_ref"]:
        out["venue_entry"] = 1 if r["s_venue_ref"] == r["r_venue_ref"] else -1
    if r["s_venue"] and r["r_venue"]:
        alike = linkage.likeness(r["s_venue"], r["r_venue"]) if r["s_venue"] != r["r_venue"] else 1.0
        out["venue_words"] = 1 if alike >= 0.75 else -1 if alike < 0.6 and bool(r["s_venue_ref"]) == bool(r["r_venue_ref"]) else 0
    if r["s_city_ref"] and r["r_city_ref"]:
        out["city"] = 1 if r["s_city_ref"] == r["r_city_ref"] else -1
    elif r["s_city"] and r["r_city"]:
        out["city"] = 1 if near(r["s_city"], r["r_city"]) else -1
    if r["s_region"] and r["r_region"]:
        out["region"] = 1 if r["s_region"] == r["r_region"] else -1
    title = f" {r['r_title']} "
    if r["s_venue"] and f" {r['s_venue']} " in title or r["s_city"] and f" {r['s_city']} " in title:
        out["title"] = 1
    elif " live at " in title and r["s_venue"] and r["s_city"]:
        place = title.split(" live at ", 1)[1].split(" on ")[0]
        alike = max(linkage.likeness(r["s_venue"], place), linkage.likeness(r["s_city"], place))
        out["title"] = 1 if alike >= 0.75 else -1 if alike < 0.6 else 0
    out["spelling"] = int(bool(r["s_key"]) and r["s_key"] == r["r_key"])
    out["owned"] = {True: 1, False: -1}.get(r["owned"], 0)
    return out


def test_votes_by_columns(spark):
    draw = random.Random(4)
    texts = ["", "orvan hall", "orvanik hall", "the orvan hall", "pelmundo arena", "kesten", "kestne"]
    pick = lambda *more: draw.choice([*texts, *more])
    rows = []
    for _ in range(300):
        rows.append(
            dict(
                s_key=pick(None), r_key=pick(None), s_night="1998-11-06", r_night=draw.choice([None, "1998-11-06", "1998-11-07"]), r_part=draw.choice([None, "1998", "1998-10"]), s_venue=pick(), r_venue=pick(),
                s_city=pick(), r_city=pick(), s_region=draw.choice(["", "aa"]), r_region=draw.choice(["", "aa", "bb"]), s_venue_ref=draw.choice(["", "1"]), r_venue_ref=draw.choice(["", "1", "2"]),
                s_city_ref=draw.choice(["", "1"]), r_city_ref=draw.choice(["", "1", "2"]), r_title=draw.choice(["", f"some act live at {pick()} on a night", f"{pick()} {pick()}", "live at x"]), owned=draw.choice([None, True, False]),
            )
        )
    schema = ", ".join(f"{k} {'boolean' if k == 'owned' else 'string'}" for k in rows[0])
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    assert [r.asDict() for r in df.select(*[v.alias(f) for f, v in linkage.votes().items()]).collect()] == [plain_vote(r) for r in rows]


def test_split_blocks_give_the_same(spark, small, monkeypatch):
    whole = {tuple(r) for r in linkage.p6_found(spark, small).collect()}
    monkeypatch.setattr(linkage, "BLOCK_PAIRS", 2)
    assert {tuple(r) for r in linkage.p6_found(spark, small).collect()} == whole
