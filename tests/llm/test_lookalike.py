import unicodedata

import pytest
from hypothesis import given, settings, strategies as st

from tapeloom.llm import lookalike


@pytest.mark.parametrize(
    "text, form",
    [
        ("Ｆｕｌｌ　Ｗｉｄｔｈ", "Full Width"),
        ("ﬁne oﬃce", "fine office"),
        ("Fête", "Fête"),
        ("ze​ro wid­th﻿", "zero width"),
        ("odd bl anks", "odd bl anks"),
        ("Τhе Βаnd οf Rеply", "The Band of Reply"),
        ("Части IV ΙΙ", "Части IV ΙΙ"),
        ("Dusty Needle Ⅳ", "Dusty Needle IV"),
        ("e​́", "é"),
        ("Ꭺce Hall", "Ace Hall"),
        ("PꓲNK Room", "PINK Room"),
        ("Ⲟld Hall", "Old Hall"),
        ("ſhow", "show"),
        ("\u1112\u1161\u11ab\u1100\u116e\u11a8", "한국"),
        ("\u09ac\u09c7\u09be", "\u09ac\u09cb"),
        ("Тhe Ѕсоре РАМ", "The Scope PAM"),
        ("Сон Весны / Scope", "Сон Весны / Scope"),
        ("Hall סס", "Hall סס"),
    ],
)
def test_forms(text, form):
    assert lookalike.canonical(text) == form


@pytest.mark.parametrize("text", ["Café", "Don’t – “Stop” …", "Весна Город", "Νύχτα, Saint Mary", "x² ½ ™", "Ångström", "می‌خواهم", "", "plain"])
def test_no_cases(text):
    assert lookalike.inspect(text) == (False, text)


def test_table_of_confusables():
    table = lookalike.read_confusables()
    assert table["\u0430"] == "a" and table["\u041e"] == "O" and table["m"] == "rn" and len(table) > 6000
    with pytest.raises(FileNotFoundError):
        lookalike.read_confusables("/nowhere/icu4j.jar")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(categories=["L", "M", "N", "Zs"]), max_size=8))
def test_segments_give_what_the_whole_text_gives(text):
    # Without look-only forms the form is the canonical composition, whatever the script.
    quick, _, simple = lookalike._classes()
    if not any(c in simple for c in text) and lookalike._latin_words(unicodedata.normalize("NFC", text)) == unicodedata.normalize("NFC", text):
        assert lookalike.canonical(text) == unicodedata.normalize("NFC", text)


def test_garbled_text_is_no_case():
    assert not lookalike.inspect("déjà".encode().decode("latin-1"))[0]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=30))
def test_form_is_stable_and_composed(text):
    once = lookalike.canonical(text)
    assert unicodedata.is_normalized("NFC", once) or unicodedata.is_normalized("NFC", lookalike.canonical(once))


def test_frame(spark):
    df = spark.createDataFrame([(1, "ﬁne", "a"), (2, None, "b"), (3, "", "c"), (4, "ok", "d"), (1, "ﬁne", "a")], "id long, text string, form string")
    assert [(r["id"], r["form"]) for r in lookalike.changed(df, "text").collect()] == [(1, "fine")] * 2
    assert {(r["id"], r["form2"]) for r in lookalike.in_form(df, "text", "form2").collect()} == {(1, "fine"), (2, None), (3, ""), (4, "ok")}
    assert lookalike.changed(df.filter("false"), "text").count() == 0
