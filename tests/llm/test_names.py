import random

import pytest

from tapeloom.llm import names
from tapeloom.llm.canonical import near


def linked(spark, listed):
    got = names.link_names(spark.createDataFrame([(n,) for n in listed], "name string")).collect()
    return {r["key"]: r["class"] for r in got}


def distance(a, b):
    """Errors and swaps of neighbours, no letter touched twice."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@pytest.mark.parametrize("most", [0, 1, 2])
def test_automaton_against_brute_force(most):
    random.seed(1)
    words = {"".join(random.choice("abc") for _ in range(random.randint(1, 7))) for _ in range(200)}
    trie = names.Trie()
    listed = sorted(words)
    for i, w in enumerate(listed):
        trie.add(w, i)
    for w in listed[:40]:
        apart = {x: distance(w, x) for x in listed}
        assert {listed[i]: n for i, n in trie.within(w, most)} == {x: n for x, n in apart.items() if n <= most}
        assert most != 1 or {x for x, n in apart.items() if n <= 1} == {x for x in listed if near(w, x)}


@pytest.mark.parametrize("most", [1, 2, 3])
def test_near_forms_share_a_shard(most):
    random.seed(most)
    met = 0
    for _ in range(1500):
        a = b = "".join(random.choice("abcd") for _ in range(random.randint(1, 24)))
        for _ in range(random.randint(0, most)):
            i = random.randrange(len(b) + 1)
            b = random.choice([b[:i] + b[i + 1 :], b[:i] + "z" + b[i:], b[:i] + "z" + b[i + 1 :], b[:i] + b[i : i + 2][::-1] + b[i + 2 :]])
        if b and distance(a, b) <= names.errors(min(len(a), len(b)), most):
            met += 1
            assert set(names.shard_keys(a, most)) & set(names.shard_keys(b, most)), (a, b)
    assert met > 500


def test_every_order_of_many_words():
    a, b = names.Parts("Orvan Pelmik and one two three four five six seven eight nine"), names.Parts("Orvan Pelmik and nine eight seven six five four three two one")
    assert a.agrees(b) and not a.agrees(names.Parts("Orvan Pelmik and one two three four five six seven eight zebra"))


@pytest.mark.parametrize(
    "a, b",
    [
        ("The Velnor Haskin String Band", "Velnor Haskin String Band, The"),
        ("The Velnor Haskin String Band", "velnorhaskinband"),
        ("The Velnor Haskin String Band", "Velnor Haksin Str. Bd."),
        ("Dorvan Pelmik & the Salt Foxes", "Foxes, Dorvan Pelmik & the Salt"),
        ("Dorvan Pelmik & the Salt Foxes", "DorvanPelmikTheSaltFoxes"),
        ("Dorvan Pelmik & the Salt Foxes", "Pelmik Dorvan w/ the Salt Foxes"),
        ("Henry Kolmarendal", "Hank Kolmarendal"),
        ("Henry Kolmarendal", "H. Kolmarendal"),
        ("Henry Kolmarendal", "Kolmarendal, Henry"),
        ("Henry Kolmarendal", "hkolmarendal"),
        ("Henry Kolmarendal", "Henry J. Kolmarendla"),
        ("Sigur Rós", "Sigur Ros"),
        ("Sigur Rós", "SIGUR ROS"),
        ("U2", "U 2"),
        ("R.E.M.", "REM"),
        ("Весна Город", "ВЕСНА ГОРРОД!"),
    ],
)
def test_variants_link(spark, a, b):
    got = linked(spark, [a, b])
    assert got.get(names.key_of(a)) is not None and got[names.key_of(a)] == got.get(names.key_of(b))


def test_shared_surname_does_not_link(spark):
    got = linked(spark, ["Eleanor Kolmarendal", "Ellie Kolmarendal", "Samuel Kolmarendal", "Sam Kolmarendal", "Kolmarendal"])
    assert got["eleanor kolmarendal"] == got["ellie kolmarendal"] != got["samuel kolmarendal"] == got["sam kolmarendal"]
    assert "kolmarendal" not in got


def test_ambiguous_short_form_ties_nothing(spark):
    got = linked(spark, ["Edward Kolmarendal", "Eddie Kolmarendal", "Theodore Kolmarendal", "Theo Kolmarendal", "Ted Kolmarendal"])
    assert got["edward kolmarendal"] != got["theodore kolmarendal"] and "ted kolmarendal" not in got
    one = linked(spark, ["Theodore Kolmarendal", "Ted Kolmarendal"])
    assert one["ted kolmarendal"] == one["theodore kolmarendal"]


@pytest.mark.parametrize("rows", [20_000, 3])
def test_split_shards_and_distance(spark, rows):
    listed = [f"Dorvan Pelmik{c}" for c in "abcdefgh"] + ["Dorvan Pelxyika", "Another Name Here"]
    got = names.link_names(spark.createDataFrame([(n,) for n in listed], "name string"), bucket_rows=rows)
    assert {r["key"] for r in got.collect()} == {names.key_of(n) for n in listed[:8]} and got.select("class").distinct().count() == 1
    two = names.link_names(spark.createDataFrame([(n,) for n in listed], "name string"), distance=2, bucket_rows=rows)
    assert {r["key"] for r in two.collect()} == {names.key_of(n) for n in listed[:9]}


def test_links_are_counted(spark):
    got = names.with_links(*names.linked(spark.createDataFrame([("Henry Kolmarendal",), ("Hank Kolmarendal",), ("H. Kolmarendal",)], "name string")))
    assert {r["key"]: r["n_links"] for r in got.collect()} == {"henry kolmarendal": 2, "hank kolmarendal": 2, "h kolmarendal": 2}


def test_edges(spark):
    got = linked(spark, [None, "", "  ", "!!", "Весна", "x" * 5000, "x" * 5000, "Solo Name"])
    assert got == {}
    assert names.link_names(spark.createDataFrame([], "name string")).count() == 0
