import pytest

from tapeloom.llm import canonical

ENTRIES = [("1", "Orvan Hall", "Delmar", "AA"), ("2", "Orvan Hall", "Kesten", "BB"), ("3", "The Miltor Opera House", "Delmar", "AA"), ("4", "Saint Porvik City", "", "AA")]


@pytest.fixture(scope="module")
def lexicon():
    return canonical.Lexicon(ENTRIES)


@pytest.mark.parametrize(
    "value, place, region, ref",
    [
        ("orvan hall", "Delmar", "", "1"),
        ("ORVAN HALL (upstairs)", "Kesten", "", "2"),
        ("Live at Orvan Hall", "", "bb", "2"),
        ("Hall Orvan", "Delmar", "", "1"),
        ("Opera House Miltor", "", "", "3"),
        ("Miltor Opera House, The - Delmar", "", "", "3"),
        ("Mitlor Opera Hse", "", "", "3"),
        ("Miltοr Oрera​ House", "", "", "3"),
        ("St. Porvik", "", "", "4"),
        ("Saint-Porvik", "", "", "4"),
        ("Orvan Arena", "Delmar", "", ""),
        ("unknown", "", "", ""),
        ("???", "", "", ""),
    ],
)
def test_resolve(lexicon, value, place, region, ref):
    assert lexicon.resolve(value, place, region)[0] == ref


def test_longest_mention_wins(lexicon):
    assert lexicon.mentions("at the miltor opera house near orvan hall")[0] == ("the miltor opera house", 3)


def test_short_names_are_found_inside():
    lex = canonical.Lexicon([("1", "Rex", "", ""), ("2", "Orvan Theatre", "", "")])
    assert [lex.resolve(v)[0] for v in ("live at the rex upstairs", "rexx", "orvan theatre")] == ["1", "", "2"]


@pytest.mark.parametrize("most", [1, 2, 3, 5, 1000])
def test_shards_give_what_one_list_gives(spark, most):
    listed = [*ENTRIES, ("5", "Red Barn", "Delmar", "AA"), ("6", "Blue Moon Ballroom", "", ""), ("7", "Blue Moon Theatre", "", ""), ("8", "Orvan Theatre", "Zed", "CC"), ("9", "Moon Theatre", "", ""), ("10", "Orvan Hall", "", "")]
    weighed = [(*e, float(i % 3)) for i, e in enumerate(listed)]
    entries = spark.createDataFrame(weighed, "ref string, name string, place string, region string, weight double")
    said = ["the old Red Barn, near Blue Moon Ballroom", "orvan hall", "ORVAN HALL", "Blue Mooon Theatr", "Moon Theater", "Theatre", "orvan", "hall orvan (bar)", "St. Porvik", "Barn", "", "Blue Moon"]
    rows = [(v, p, r) for v in said for p, r in (("", ""), ("Delmar", "aa"), ("Kestn", ""), ("", "cc"))]
    lex = canonical.Lexicon(weighed)
    got = {(r["value"], r["place"], r["region"]): (r["ref"], round(r["similarity"], 6)) for r in canonical.map_values(spark.createDataFrame(rows, "value string, place string, region string"), entries, most=most).collect()}
    want = {(v, p, r): lex.resolve(v, p, r) for v, p, r in rows}
    assert got == {k: (ref, round(x, 6)) for k, (ref, x) in want.items()}
    assert want[said[0], "", ""][0] == "6"


def test_codes():
    lex = canonical.Lexicon([("AA", "North Delmark", "", ""), ("BB", "Kestenland", "", "")], codes=True)
    assert [lex.resolve(v)[0] for v in ("a.a.", " bb ", "N. Delmark", "KESTENLAND", "Keste.", "zz", "Kestenlnad")] == ["AA", "BB", "AA", "BB", "BB", "", "BB"]


def test_frame_and_shards(spark):
    entries = spark.createDataFrame(ENTRIES, "ref string, name string, place string, region string")
    values = spark.createDataFrame([("orvan hall", "Delmar", None), ("orvan hall", "Delmar", None), ("", None, None), ("x" * 30000, None, None)], "value string, place string, region string")
    for most in (10, 2):
        got = {r["value"][:12]: r["ref"] for r in canonical.map_values(values, entries, most=most).collect()}
        assert got == {"orvan hall": "1", "": "", "x" * 12: ""}
    assert canonical.map_values(values, entries.filter("false")).filter("ref <> ''").count() == 0
    assert canonical.map_values(values.filter("false"), entries).count() == 0
