import json

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import nested, shows
from tapeloom.plans import problems

TRACK = {"num": 1, "title": "One"}
FORMS = {
    1: {"tracks": [TRACK, "Two", None, {"title": "Four", "num": "4", "segue": "true"}]},
    2: {"tracks": json.dumps([TRACK])},
    3: {"tracks": {"2": {"title": "B"}, "1": {"title": "A"}, "10": None}},
    4: {"tracks": TRACK, "parts": {"dir": "x", "tracks": ["P"]}},
    5: {"tracks": None, "parts": [None, {"tracks": json.dumps({"1": "Q"})}, "name", 3]},
    6: {"tracks": [], "parts": json.dumps([{"disc": 2, "tracks": [None, {"title": "R"}]}])},
    7: {"tracks": "no list", "parts": {}},
    8: {"artist": None, "venue": ["list"], "date": 1999},
}


def frame(spark):
    rows = [(i, f"f{i}", json.dumps(m)) for i, m in FORMS.items()] + [(9, "f9", '{"tracks": ['), (10, "f10", None), (11, "f11", ""), (12, None, "[1]"), (1, "f1", json.dumps(FORMS[1]))]
    df = spark.createDataFrame(rows, "id long, folder_name string, meta string")
    return nested.parse_documents(df.distinct(), "meta").filter("doc is not null and schema_of_variant(doc) like 'OBJECT%'")


def test_every_form_of_a_list(spark):
    got = {(r["show_id"], r["part_no"], r["track_no"]): r["title"] for r in shows.track_rows(frame(spark)).collect()}
    assert got == {(1, 0, 1): "One", (1, 0, 2): "Two", (1, 0, 4): "Four", (2, 0, 1): "One", (3, 0, 1): "A", (3, 0, 2): "B", (4, 0, 1): "One", (4, 1, 1): "P", (5, 2, 1): "Q", (6, 1, 2): "R"}


def test_links_and_lenient_types(spark):
    docs = frame(spark)
    tracks = {r["sk"]: r for r in shows.track_rows(docs).collect()}
    assert tracks["1/tracks:4"]["num"] == 4 and tracks["1/tracks:4"]["segue"] is True and tracks["4/parts:1/tracks:1"]["parent_sk"] == "4/parts:1"
    keys = {r["sk"] for r in shows.part_rows(docs).collect()} | {r["sk"] for r in shows.show_rows(docs).collect()}
    assert {r["parent_sk"] for r in tracks.values()} <= keys
    s = {r["show_id"]: r for r in shows.show_rows(docs).collect()}
    assert s[8]["artist"] is None and s[8]["venue"] is None and s[8]["date"] == "1999"


def test_inferred_levels(spark):
    levels = {lv.name: [c.name for c in lv.children] for lv in nested.infer_levels(frame(spark))}
    assert levels == {"tracks": [], "parts": ["tracks"], "venue": []}


def test_fields_without_a_column_are_kept(spark, tmp_path):
    meta = {"artist": "A", "extras": [{"t": 1}], "empty": None, "tracks": [{"title": "One", "rating": 5}, "Two"], "parts": {"dir": "x", "mood": {"a": "b"}, "tracks": [{"num": 1, "x y": True}]}}
    spark.createDataFrame([(1, "f", json.dumps(meta)), (2, "g", "{"), (3, "h", None)], "id long, folder_name string, meta string").write.parquet(f"{tmp_path}/shows.parquet")
    got = {(r["level"], r["sk"], r["field"], r["value"]) for r in problems.p1_others(spark, str(tmp_path)).collect()}
    assert got == {("", "1", "extras", '[{"t":1}]'), ("parts", "1/parts:1", "mood", '{"a":"b"}'), ("tracks", "1/tracks:1", "rating", "5"), ("parts.tracks", "1/parts:1/tracks:1", "x y", "true")}


def docs_of(spark, *docs):
    return nested.parse_documents(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs, 1)], "id long, meta string"), "meta")


@pytest.mark.parametrize(
    "docs, want",
    [
        ([{"t": json.dumps([{"a": 1}])}, {"t": "no list"}], {"t": ["1/t:1"]}),  # only as JSON text
        ([{"t": {"1": {"a": 1}, "12345678901": {"a": 2}}}], {"t": ["1/t:1", "1/t:12345678901"]}),  # only as an object of ordinals
        ([{"m": [[{"a": 1}, {"a": 2}], [{"a": 3}]]}], {"m": ["1/m:1", "1/m:2"], "m.[]": ["1/m:1/[]:1", "1/m:1/[]:2", "1/m:2/[]:1"]}),  # lists of lists
        ([{"a": {"b": {"tracks": [{"x": 1}]}}}], {"a.b.tracks": ["1/a.b.tracks:1"]}),  # inside objects
        ([{"t": ["One", "Two"]}], {"t": ["1/t:1", "1/t:2"]}),  # of plain values
        ([{"t": ["One", {"l": [1]}]}, {"t": {"l": [2]}}], {"t": ["1/t:1", "1/t:2", "2/t:1"], "t.l": ["1/t:2/l:1", "2/t:1/l:1"]}),
        ([{"a b'c": [{"x.y": [1]}]}], {"a b'c": ["1/a b'c:1"], "a b'c.x.y": ["1/a b'c:1/x.y:1"]}),  # odd names
        ([{"o": {"x": 1}, "n": "[1]", "m": "[4:33]", "s": None}], {}),
        ([[{"a": 1}], {"b": 1}], {"[]": ["1/[]:1", "2/[]:1"]}),
        ([{"d": [{"d": [{"d": [{"d": [{"d": [{"d": [{"d": [{"d": [{"d": [{"d": [7]}]}]}]}]}]}]}]}]}]}], {".".join(["d"] * n): ["1" + "/d:1" * n] for n in range(1, 11)}),  # ten deep
    ],
)
def test_every_kind_of_level_is_inferred(spark, docs, want):
    tables = nested.flatten(docs_of(spark, *docs), "id")
    assert {name: sorted(r["sk"] for r in t.select("sk").collect()) for name, t in tables.items() if name} == want


def test_schema_fields():
    assert nested.schema_fields("OBJECT<a: STRING, b: ARRAY<OBJECT<c: BIGINT, d: ARRAY<STRING>>>, `x y`: VARIANT, e: ARRAY<STRING>>") == [("a", "STRING"), ("b", "ARRAY<OBJECT<c: BIGINT, d: ARRAY<STRING>>>"), ("x y", "VARIANT"), ("e", "ARRAY<STRING>")]
    assert nested.schema_fields("VOID") == []


def test_known_lists_stored_as_one_object(spark):
    docs = docs_of(spark, {"parts": {"dir": "x", "tracks": {"title": "One"}}}, {"other": 1})
    assert nested.level_names(nested.infer_levels(docs, known=shows.LEVELS)) == ["parts", "parts.tracks"]
    assert nested.infer_levels(docs_of(spark, {"a": 1}), known=shows.LEVELS) == nested.infer_levels(docs.filter("false"), known=shows.LEVELS) == ()


def test_long_whole_numbers(spark):
    rows = docs_of(spark, {"n": 1234567890123456789}, {"n": " 9223372036854775807 "}, {"n": "9223372036854775808"}, {"n": "1.5"}, {"n": -3}, {"n": None})
    assert [r["n"] for r in rows.orderBy("id").select(nested.whole_of(F.col("doc"), "n").alias("n")).collect()] == [1234567890123456789, 9223372036854775807, None, None, -3, None]


def test_invalid_and_empty(spark):
    df = spark.createDataFrame([(1, "{"), (2, None), (3, "{}")], "id long, meta string")
    assert [r["id"] for r in nested.invalid_documents(df, "meta").collect()] == [1]
    none = nested.parse_documents(df.filter("false"), "meta")
    assert nested.infer_levels(none) == () and nested.flatten(none, "id", levels=shows.LEVELS)["parts.tracks"].count() == 0


def test_deep_nesting_and_long_text(spark):
    doc = {"a": [{"b": [{"c": [{"t": "x" * 200_000}]}]}]}
    df = nested.parse_documents(spark.createDataFrame([(1, json.dumps(doc))], "id long, meta string"), "meta")
    tables = nested.flatten(df, "id")
    assert set(tables) == {"", "a", "a.b", "a.b.c"}
    assert [r["sk"] for r in tables["a.b.c"].collect()] == ["1/a:1/b:1/c:1"]
