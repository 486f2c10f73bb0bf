import json
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import changes, matching, merging, places, predicates, sequences
from tapeloom.operators.alignment import align
from tapeloom.plans import inputs, joins, scalars
from tapeloom.plans.base import release_fields, show_fields
from tapeloom.sources import sinks, texts


def test_trust_order_does_not_depend_on_row_order(spark):
    rows = [(1, "tags", "venue", "B"), (1, "info", "venue", "A!"), (1, "x", "venue", "a"), (1, "info", "date", "2"), (1, "folder", "date", "3"), (1, "info", "city", " "), (1, "tags", "city", None), (2, "zz", "venue", "")]
    for r in (rows, rows[::-1]):
        df = spark.createDataFrame(r, "id long, source string, field string, value string")
        got = {(x["id"], x["field"]): (x["value"], x["source"], x["agreement"]) for x in merging.merge_by_trust(df, ["id"], ["info", "tags"], {"date": ["folder", "info"]}).collect()}
        assert got == {(1, "venue"): ("A!", "info", 2), (1, "date"): ("3", "folder", 1)}


def test_majority_and_dominance(spark):
    df = spark.createDataFrame([("a", "X")] * 4 + [("a", "Y")] + [("b", "X"), ("b", "Y"), ("c", "Z")], "k string, v string")
    assert [(r["k"], r["v"], r["n"]) for r in merging.majority(df, ["k"], "v").collect()] == [("a", "X", 4)]
    p = spark.createDataFrame([("a", "X", 90), ("a", "Y", 10), ("b", "X", 2), ("b", "Y", 1), ("c", "Z", 0)], "k string, v string, pop long")
    assert {r["k"]: r["v"] for r in merging.dominant(p, ["k"], "v", "pop", 3).collect()} == {"a": "X", "c": "Z"}


def test_pairs(spark):
    df = spark.createDataFrame([(1, "k", "e"), (2, "k", "l"), (3, "m", "e"), (4, "m", "e"), (5, "m", "l")], "id long, k string, kind string")
    assert [tuple(r) for r in matching.pair_one_of_each(df, ["k"], "kind", "e", "l", "id").collect()] == [("k", 1, 2)]
    nights = spark.createDataFrame([("a1", "New Riders", "d", "early"), ("b", "nr", "d", "late"), ("c", "Others", "d", "late"), ("x", "Others", "d", ""), (None, "q", "d", "early")], "folder string, artist string, date string, part string")
    assert [tuple(r) for r in matching.early_late(nights).collect()] == [("a1", "b")]
    two = nights.unionByName(spark.createDataFrame([("b2", "nr", "d", "late")], nights.schema))
    assert matching.early_late(two).count() == 0


def test_prefix_and_tail(spark):
    rules = spark.createDataFrame([("/a", "X"), ("/a/b", "Y")], "remote string, local string")
    paths = spark.createDataFrame([(1, "/a/b/c"), (2, "/ab"), (3, "/a/c"), (4, "/a/b")], "id long, path string")
    assert {r["id"]: r["mapped"] for r in matching.longest_prefix(paths, rules, "id", "path").collect()} == {1: "Y/c", 3: "X/c", 4: "Y"}
    df = spark.createDataFrame([("x/a/b", "y/a/b"), ("a", "b")], "a string, b string")
    assert [r[0] for r in df.select(matching.common_tail(F.col("a"), F.col("b"))).collect()] == [2, 0]


def test_only_best_rejects_ties(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 2, 2), ("b", 1, 3), ("b", 2, 3)], "k string, o long, s long")
    assert [(r["k"], r["o"]) for r in matching.only_best(df, ["k"], "s").collect()] == [("a", 1)]


def test_fuzzy_tie_takes_the_greater(spark):
    a, b = spark.createDataFrame([("abcdefg",)], "a string"), spark.createDataFrame([("abcdefx",), ("abcdefy",)], "b string")
    assert matching.best_fuzzy(a, b, "a", "b", 0.8).first()["b"] == "abcdefy"


def test_contained_at_any_place(spark, small):
    keys = ["falwen", "thefalwen", "falwenband", "aolneb", "olne", "oln", "xx", "", None, "falwen"]
    got = sorted(tuple(r) for r in matching.contained_pairs(spark.createDataFrame([(k,) for k in keys], "k string"), "k").collect())
    assert got == [("aolneb", "olne")] + [("falwen", "falwenband")] * 2 + [("falwen", "thefalwen")] * 2
    names = [r["norm"] for r in spark.read.parquet(f"{small}/artists.parquet").collect()]
    want = sorted((a, b) for a in names for b in names if a and b and a < b and min(len(a), len(b)) >= 4 and (a in b or b in a))
    assert sorted(tuple(r) for r in scalars.contained_keys(spark, small).collect()) == want


def test_titles_of_any_script_are_composed(spark, tmp_path):
    rows = [("Café: Zoë", " ", "ST"), ("Тихий/Дом", "Łąka", None), ("\u200bHall.", None, "NK."), ("Tab\there", "", ""), (None, None, None), ("Hall", "Orvan", "AA")]
    meta = [json.dumps(dict(zip(("venue", "city", "state"), r))) for r in rows] + ["{", None]
    spark.createDataFrame([(i, "f", "s", 1.0, m) for i, m in enumerate(meta)], "id long, folder_name string, status string, confidence double, meta string").write.parquet(f"{tmp_path}/shows.parquet")
    got = {r["show_id"]: r["title"] for r in scalars.composed_titles(spark, str(tmp_path)).collect()}
    assert got == {0: "Café- Zoë, ST", 1: "Тихий-Дом, Łąka", 2: "\u200bHall., NK", 3: "Tab-here", 4: "Unknown", 5: "Hall, Orvan, AA"}


def test_no_title_and_no_date_is_left_out(spark, small, tmp_path):
    rows = [(1, "‚a„ — b−c…"), (2, None), (3, "‘a’ “b” –\u200b"), (4, "a")]
    spark.createDataFrame(rows, "rid long, title string").write.parquet(f"{tmp_path}/song_titles.parquet")
    assert {r["rid"]: r["t"] for r in scalars.plain_signs(spark, str(tmp_path)).collect()} == {1: "'a\" - b-c...", 2: None, 3: "'a' \"b\" -", 4: "a"}
    dates = {r["id"]: r["date"] for r in release_fields(spark, small).select("id", "date").collect()}
    days = {r["id"]: r["day"] for r in scalars.iso_dates(spark, small).collect()}
    short = [i for i, t in dates.items() if re.fullmatch(r"\d+/\d+/\d\d", t or "")]
    assert short and set(days) == set(dates) and {days[i] for i in short} == {None}  # no family of X-25 has m/d/yy


def closest(x, others, cutoff):
    scored = [(SequenceMatcher(None, x[1], y[1]).ratio(), y[0]) for y in others]
    return max((m for m in scored if m[0] >= cutoff), default=None)


@pytest.mark.parametrize("cutoff", [0.87, 0.8, 0.6])
def test_near_duplicates_by_brute_force(spark, small, cutoff):
    keys = ["thefalwennolpororchestra", "falwennolpororchestrathe", "abcd", "abxcd", "a", "", "aaaaaaaa", "aaaaaaa", "xbcdefghiy", "zbcdefghiw"]
    keys += [r["norm"] for r in spark.read.parquet(f"{small}/artists.parquet").distinct().collect()]
    want = {}
    for k in set(keys):
        if m := closest((k, k), [(o, o) for o in set(keys) - {k}], cutoff):
            pair = tuple(sorted((k, m[1])))
            want[pair] = max(want.get(pair, 0), round(m[0], 6))
    got = matching.near_duplicates(spark.createDataFrame([(k,) for k in keys + [None]], "k string"), "k", cutoff).collect()
    assert {(r["a"], r["b"]): r["score"] for r in got} == want and len(got) == len(want)
    assert cutoff != 0.87 or ("falwennolpororchestrathe", "thefalwennolpororchestra") in want


def test_fuzzy_cascade_by_brute_force(spark):
    left = ["The Falwennolpor Orchestra", "Abxcd", "?", "A", "No One Near"]
    right = ["Falwennolpor Orchestra, The", "abcd", "!", "a.", "a", "Quite Another"]
    key = lambda t: re.sub("[^a-z0-9]", "", t.lower())
    want = {t: (m[1], round(m[0], 6)) for t in left if (m := closest((t, key(t)), [(o, key(o)) for o in right], 0.85))}
    a, b = (spark.createDataFrame([(t,) for t in v], f"{c} string") for v, c in ((left, "a"), (right, "b")))
    assert {r["a"]: (r["b"], r["score"]) for r in matching.best_fuzzy(a, b, "a", "b", 0.85).collect()} == want and len(want) == 4


def test_best_within_a_date_by_brute_force(spark, small):
    letters = lambda t: re.sub("[^a-z0-9]", "", (t or "").lower())
    said = lambda r: " ".join(x for x in (r["artist"], r["date"]) if x is not None).lower()
    r = [x for x in release_fields(spark, small).select("id", "artist", "date").collect() if x["date"] and letters(x["artist"])]
    s = [x for x in show_fields(spark, small).select("show_id", "artist", "date").collect()]
    want = {}
    for x in r:
        found = [(SequenceMatcher(None, said(x), said(y)).ratio(), -y["show_id"], letters(x["artist"]) == letters(y["artist"])) for y in s if y["date"] == x["date"]]
        if good := [(n, i) for n, i, kin in found if n >= 0.85 or kin and n >= 0.6]:
            want[x["id"]] = (-max(good)[1], round(max(good)[0], 6))
    assert want and {x["id"]: (x["show_id"], x["score"]) for x in joins.fuzzy_within_date(spark, small).collect()} == want


def test_guarded_lookup(spark):
    kind = "id long, city string, date string, venue string, songs array<string>"
    left = spark.createDataFrame([(1, "c", "d", "Orvan Hall", ["a", "b", "c"]), (2, "c", "d", "Elsewhere", ["a", "b", "x"]), (3, "c", "d", None, ["a"]), (4, "", "d", "Orvan Hall", ["a"]), (5, "e", "d", "", ["p", "q"]), (6, "c", None, "Orvan Hall", None), (7, "f", "d", "Kesten Arena", None)], kind)
    right = spark.createDataFrame([(10, "c", "d", "The Orvan Hall", ["a"]), (11, "c", "d", "Somewhere Other", ["a", "b", "c"]), (12, "e", "d", None, ["p", "q"]), (13, "e", "d", None, ["q", "p"]), (14, "f", "d", "Kesten Arenas", None), (15, "", "d", "Orvan Hall", ["a"])], kind).withColumnRenamed("id", "other")
    got = {tuple(r) for r in matching.guarded_lookup(left, right, ["city", "date"], "venue", "songs", "id", "other").collect()}
    # 1: its venue outweighs more songs elsewhere. 2: by songs. 3: one song is too few. 5: two are equal. 7: by venue alone.
    assert got == {(1, 10, 1, "venue"), (2, 11, 2, "songs"), (7, 14, 0, "venue")}


@pytest.mark.parametrize("sizes, limit, taken", [([6, 5, 4], 10, [True, False, True]), ([11, 10], 10, [False, True]), ([5, 5], 0, [True, True]), ([None, 10], 10, [True, True])])
def test_budget(spark, sizes, limit, taken):
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate(sizes)], "k string, o long, s long")
    assert [r["taken"] for r in sorted(sequences.budget(df, "k", "o", "s", limit).collect())] == taken


def files(*labels, seconds=200.0, disc=1):
    return [dict(pos=i, name=f"t{i:02d}.flac", seconds=seconds, label=x, disc=disc) for i, x in enumerate(labels, 1)]


def songs(*titles, **more):
    return [dict(pos=i, num=i, title=t, disc=1, set_no=1, segue=False) | more for i, t in enumerate(titles, 1)]


def short(*labels, at=(), n=20.0):
    f = files(*labels)
    for i in at:
        f[i]["seconds"] = n
    return f


def breaks(file_disc, song_disc):
    f, s = short("a", "", "b", at=[1], n=10.0), songs("A", "B")
    f[1]["disc"] = f[2]["disc"] = file_disc
    s[1]["disc"] = song_disc
    return f, s


def segue():
    s = songs("Alpha", "Beta", "Gamma")
    s[0]["segue"] = True
    return s


# files, songs, typed titles: how, settled, titles
ALIGNED = [
    (files("x", "y"), songs("A", "B"), None, ("count", True, ["A", "B"])),
    (files("Tuning", "a", "b"), songs("A", "B"), None, ("named", True, ["Tuning", "A", "B"])),
    (files("- crowd & the TUNING -", "a", "b"), songs("A", "B"), None, ("named", True, ["Crowd & the tuning", "A", "B"])),
    (files("Tuning", "a", "Crowd"), songs("A", "B"), None, ("named", False, ["Tuning", "A", "B"])),
    (files("Intro", "Tuning", "b"), songs("Intro", "B"), None, ("named", True, ["Intro", "Tuning", "B"])),
    (short("", "", "", at=[2]), songs("A", "B"), None, ("short", True, ["A", "B", "Crowd"])),
    (short("", "", "", at=[0]), songs("A", "B"), None, ("short", True, ["Tuning", "A", "B"])),
    (short("", "", "", "", at=[0, 3]), songs("A", "B", "C"), None, ("short", False, ["Tuning", "A", "B", "C"])),
    (files("", "", ""), songs("A", "B"), None, ("none", False, ["A", "B", ""])),
    (*breaks(2, 99), None, ("short", True, ["A", "Encore Break", "B"])),
    (*breaks(2, 2), None, ("short", True, ["A", "Set Break", "B"])),
    (files("Alpha > Beta", "Delta"), songs("Alpha", "Beta", "Gamma", "Delta"), None, ("labels", True, ["Alpha > Beta", "Delta"])),
    (files("Alphaa -> Gamma", "banter", "Deltas Song"), songs("Alpha", "Beta", "Gamma", "The Deltas Song"), None, ("labels", True, ["Alpha > Beta > Gamma", "banter", "The Deltas Song"])),
    (files("Alpha", "Nowhere"), songs("Alpha", "Beta", "Gamma"), None, ("number", False, ["Alpha", "Beta"])),
    (files("Alpha", "Last"), songs("Alpha", *"bcdefgh", "Last"), None, ("number", False, ["Alpha", "b"])),  # eight ahead
    (files("Beta", "Alpha"), songs("Alpha", "Beta", "Gamma"), None, ("number", False, ["Alpha", "Beta"])),  # out of order
    (files("1", "2"), segue(), None, ("segues", True, ["Alpha > Beta", "Gamma"])),
    (files("?", "?"), songs("Alpha", "Beta", "Gamma"), None, ("number", False, ["Alpha", "Beta"])),
    (files("?", "?"), songs("Alpha", "Beta", "Gamma"), {"t01.flac": "Mine", "t02.flac": "Yours"}, ("typed", True, ["Mine", "Yours"])),
    (files("x", "y"), songs("A", "B"), {"t02.flac": "Yours", "gone": "No", "t01.flac": " "}, ("count", True, ["A", "Yours"])),
    (files(*"abcdef"), songs("Alpha"), None, ("number", False, ["Alpha", "", "", "", "", ""])),
    (files("a"), [], None, ("none", True, [""])),
    ([], songs("A"), None, None),
    ([dict(pos=1, name=None, seconds=None, label=None, disc=None)], [dict(pos=1, num=None, title="A", disc=None, set_no=None, segue=None)], None, ("count", True, ["A"])),
    (files("a"), [dict(pos=1, num=1, title=None, disc=1, set_no=1, segue=False)], None, ("count", True, [""])),
]


def test_alignment(spark):
    f = [(i, *x.values()) for i, (fs, *_) in enumerate(ALIGNED) for x in fs]
    s = [(i, *x.values()) for i, (_, ss, *_) in enumerate(ALIGNED) for x in ss]
    t = [(i, n, x) for i, (*_, typed, _) in enumerate(ALIGNED) for n, x in (typed or {}).items()]
    fdf = spark.createDataFrame(f, "show_id long, pos long, name string, seconds double, label string, disc long")
    sdf = spark.createDataFrame(s, "show_id long, pos long, num long, title string, disc long, set_no long, segue boolean")
    got = {}
    for r in sorted(align(fdf, sdf, spark.createDataFrame(t, "show_id long, name string, title string")).collect(), key=lambda r: r["pos"]):
        got.setdefault(r["show_id"], (r["how"], r["ok"], []))[2].append(r["title"])
    for i, (*_, want) in enumerate(ALIGNED):
        assert got.get(i) == want, i
    assert align(fdf.filter("false"), sdf).count() == 0 and align(fdf, sdf.filter("false")).filter("kind <> 'unmatched'").count() == 0


def test_places(spark):
    p = spark.createDataFrame([(1, "Orvan", "AA", "X", 900), (2, "Orvan", "BB", "X", 10), (3, "Kesten", "CC", "Y", 5), (4, "Kesten", "DD", "Y", 4)], "gid long, name string, admin string, cc string, pop long")
    s = spark.createDataFrame([("AA", "Aland", "X"), ("BB", "Beland", "X"), ("CC", "Celand", "Y"), ("DD", "Deland", "Y")], "code string, name string, cc string")
    c = spark.createDataFrame([("X", "Xonia", ["XON", None]), ("Y", "Yonia", None)], "code string, name string, aliases array<string>")
    v = spark.createDataFrame([("kesten", "DD")], "city_key string, state string")
    rows = [(1, "Orvan", "aa"), (2, "Orvan", "Beland"), (3, "Orvan", "Xon"), (4, "Kesten", ""), (5, "Orvan", None), (6, "Nowhere", "CC"), (7, None, None), (8, "Kesten", "zz")]
    got = {r["id"]: (r["region"], r["how"]) for r in places.resolve(spark.createDataFrame(rows, "id long, city string, state string"), p, s, c, v).collect()}
    assert got == {1: ("AA", "code"), 2: ("BB", "name"), 3: ("AA", "country"), 4: ("DD", "library"), 5: ("AA", "dominant"), 6: ("CC", "code"), 7: (None, None), 8: (None, None)}
    t = spark.createDataFrame([(1, "@ Orvan Hall (main room) ", "Kesten (near)", "a.a."), (2, "Orvan Hall - Kesten", "Kesten", "?"), (3, "Live at Orvan", "Kesten, ST", None), (4, "unknown", "", " ")], "id long, venue string, city string, state string")
    assert {r["id"]: (r["venue"], r["city"], r["state"]) for r in places.tidy(t).collect()} == {1: ("Orvan Hall", "Kesten", "AA"), 2: ("Orvan Hall", "Kesten", None), 3: ("Orvan", "Kesten", "ST"), 4: (None, None, None)}


# venue, city, state as typed, and as tidied
TIDIED = [
    ("House Of Orvan - Kesten", "Kesten", "IL", "House Of Orvan", "Kesten", "IL"),
    ("Orvan County Coliseum, Kesten, Wisconsin", "Kesten", "WI", "Orvan County Coliseum", "Kesten", "WI"),
    ("Orvan - Delmar Hall, Kesten", "Kesten", "WI", "Orvan - Delmar Hall", "Kesten", "WI"),
    ("75-06-06", "San Kesten", "CA", None, "San Kesten", "CA"),
    ("06/14/08 (Sat)  Orvan Center For The Arts", "Bay Kesten", "NY", "Orvan Center For The Arts", "Bay Kesten", "NY"),
    ("175488.Sam Orvan's Home Studio", "Kesten", "CA", "Sam Orvan's Home Studio", "Kesten", "CA"),
    ("SBD", "Kesten", "CA", None, "Kesten", "CA"),
    ("THE ORVAN THEATRE", "ST. KESTEN", "MO", "The Orvan Theatre", "St. Kesten", "MO"),
    ("WXYZ 93.1 FM", "KESTEN", "IL", "WXYZ 93.1 FM", "Kesten", "IL"),
    ("Orvan East, NYC", "New York", "NY", "Orvan East", "New York", "NY"),
    ("Orvan Pub", "Kesten", "Kesten", "Orvan Pub", "Kesten", None),
    ("Orvan Memorial Field", "Ann Kesten", "MI rm", "Orvan Memorial Field", "Ann Kesten", "MI"),
    ("Music Hall Kesten City", "Kesten City", "MO", "Music Hall Kesten City", "Kesten City", "MO"),
    ("The Orvan Matrix", "Kesten", "CA", "The Orvan Matrix", "Kesten", "CA"),
    ("Kesten", "Kesten", "", "Kesten", "Kesten", None),
    (None, "Kesten, ST", None, None, "Kesten", "ST"),
    (" ", None, "?", None, None, None),
]


def test_tidied_places(spark):
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(TIDIED)], "id long, venue string, city string, state string")
    got = {r["id"]: (r["venue"], r["city"], r["state"]) for r in places.tidy(df).collect()}
    assert got == {i: r[3:] for i, r in enumerate(TIDIED)}


NO_ACTS = """faults: none|Santa Kesten, California.|Banned tracks removed.|; generated on November 14, 2009, at 19:17:00|Shared by Orvan(a.k.a. Kesten), Friesland|reward for all the work involved in this project.
'Orvan Man'. But hey, it's better than nothing!|Here's the club's tribute to Sam Orvan ...|Bean Kesten, Indiana|Gathering Of Orvans - Bridgeport, CT|The Kesten Pop Festival was held June 16|April, 26th, 1977, Kesten, Georgia, The Omni
Sam Orvan1986-04-15.nak300.Kesten,CT info|x|12|<b>Orvan</b>"""
ACTS = "O.R.V.|orv.|Orvan, Kesten, Nash & Young|Doc Orvan, Jack Kesten & T. Michael Colm|Earth, Wind & Orvan|Dr. Orvan|The 1975|Enjoy|Sam Orvan/ Dick Kesten Band"


def test_plausible_acts(spark):
    rows = [(t, False) for t in NO_ACTS.replace("\n", "|").split("|")] + [(t, True) for t in ACTS.split("|")]
    got = spark.createDataFrame(rows, "t string, want boolean").select("t", "want", predicates.plausible_artist(F.col("t")).alias("ok")).collect()
    assert [r["t"] for r in got if r["ok"] != r["want"]] == []


def test_changes(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, v string, keep string")
    new = spark.createDataFrame([(2, None, "no"), (3, "c", "no")], base.schema)
    for _ in range(2):  # the same batch again changes nothing
        base = changes.upsert(base, new, ["id"], ["v"])
    assert {tuple(r) for r in base.collect()} == {(1, "a", "x"), (2, None, "y"), (3, "c", None)}
    with pytest.raises(ValueError):
        changes.migrate(base, [(1, lambda t: t)], 2)


def test_torrents_and_bytes(spark):
    good = b"d8:announce3:abc4:infod4:name4:show6:lengthi5eee"
    rows = [(1, good), (2, good[:-3]), (3, b"<html>"), (4, None), (5, b"d4:info" + b"l" * 100 + b"e" * 100 + b"e"), (6, b"")]
    got = {r["id"]: r for r in texts.torrents(spark.createDataFrame(rows, "id long, content binary")).collect()}
    assert got[1]["name"] == "show" and len(got[1]["hash"]) == 40 and all(got[i]["error"] and got[i]["hash"] is None for i in range(2, 7))
    b = spark.createDataFrame([(1, "Été\n".encode()), (2, b"\xff\xfe" + "Été".encode("utf-16-le")), (3, "plain text".encode("utf-16-be")), (4, b"a\xffb"), (5, None)], "id long, c binary")
    out = {r["id"]: r["t"] for r in b.select("id", texts.decoded(F.col("c")).alias("t")).collect()}
    assert out[1] == "Été\n" and out[2] == "Été" and out[3] == "plain text" and out[4].startswith("a") and out[5] is None


def test_all_documents_are_decoded(spark, tmp_path):
    rows = ["plain", "<p>a<br>b &amp; c</p>", "a < b", "R & B", "x\0y", None, "", "Śnieg Głos is cut", "“Quiet” <b>Hall</b>", "\ufeffmark"]
    df = spark.createDataFrame([(2 * i + k, t) for i, t in enumerate(rows) for k in (0, 1)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in inputs.decoded_texts(spark, str(tmp_path)).collect()) == [(i, True) for i in range(2 * len(rows))]
    b = df.select("doc_id", texts.decoded(F.encode("text", "UTF-16BE")).alias("t"))
    assert {r["doc_id"] // 2: r["t"] for r in b.collect()} == {0: "plain", 1: "a\nb & c\n", 2: "a < b", 3: "R & B", 4: "xy", 5: None, 6: "", 7: rows[7], 8: "“Quiet” Hall", 9: "mark"}


def test_gazetteer_has_the_saints(spark, tmp_path):
    rows = [(1, "Saint Mary", "AA", "X", 5), (2, "St. Mary", "BB", "X", 9), (3, "Stanmore", "CC", "X", 1), (4, "Orvan", "AA", "X", 2)]
    spark.createDataFrame(rows, "gid long, name string, admin string, cc string, pop long").write.parquet(f"{tmp_path}/places.parquet")
    assert {(r["key"], r["gid"]) for r in inputs.gazetteer_roundtrip(spark, str(tmp_path)).collect()} == {("stmary", "2"), ("stanmore", "3"), ("orvan", "4")}


def test_ledger_takes_every_key_once(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    assert sinks.append_new(df, f"{tmp_path}/l", "k").count() == 2 and sinks.append_new(df, f"{tmp_path}/l", "k").count() == 0
    assert spark.read.parquet(f"{tmp_path}/l").count() == 2
