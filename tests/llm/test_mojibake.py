import pytest
from hypothesis import given, settings, strategies as st

from tapeloom.llm import mojibake

WORDS = ["Mañana", "Café & Thé", "“Quiet” River", "Don’t Wake", "Žlutý Kůň", "Весна Город", "Νύχτα Δρόμος", "Übermut – Part 2"]


@pytest.mark.parametrize("text", WORDS)
@pytest.mark.parametrize("wrong", ["latin-1", "mac_roman", "cp437", "cp850"])
def test_utf8_read_wrongly_is_restored(text, wrong):
    bad = text.encode().decode(wrong)
    hit, got, whole = mojibake.diagnose(bad)
    assert (hit, got, whole) == (True, text, True)


def sloppy(text):
    return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in text.encode())


@pytest.mark.parametrize("text", WORDS)
def test_windows_and_nested_layers(text):
    once = sloppy(text)
    assert mojibake.diagnose(once) == (True, text, True)
    assert mojibake.diagnose(sloppy(once)) == (True, text, True)


@pytest.mark.parametrize("right", ["cp1251", "koi8-r", "cp866"])
def test_single_byte_confusion(right):
    assert mojibake.diagnose("Весна Город".encode(right).decode("latin-1"))[:2] == (True, "Весна Город")


@pytest.mark.parametrize("layers", [1, 3, 6, 9])
def test_any_number_of_layers(layers):
    bad = "Mañana"
    for _ in range(layers):
        bad = bad.encode().decode("latin-1")
    assert mojibake.diagnose(bad) == (True, "Mañana", True)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abÉéÃÂ®”’žŠœ°ñØ ", max_size=12))
def test_every_change_lowers_the_cost(text):
    got = mojibake.repair(text)
    assert got == text or mojibake.cost(got, 2) < mojibake.cost(text, 2)


def test_part_of_a_text():
    assert mojibake.diagnose("Мельница / " + sloppy("Señal"))[:2] == (True, "Мельница / Señal")


@pytest.mark.parametrize("text", ["Caf�", "M\x96x"])
def test_what_cannot_be_restored_is_still_found(text):
    assert mojibake.diagnose(text)[0]


@pytest.mark.parametrize("text", [*WORDS, "", None, "plain", "ÉTÉ À L’ÎLE", "KSIĘŻYC", "SÃO JOÃO", "MAÇÃ", "Süß & Äöü", "Тhе Bаnd", "naïve", "CLICHÉ® live", "“ÉTÉ”", "CAFÉ’S", "ÚŽASNÝ", "BÍŽE", "Țara Șarpelui", "Vadcresk\xa0Rev.\xa0–\xa0ÉTÉ\xa0FORÊT", "ČEKÁNÍ\xa0KVĚTINA", "l’été – 30°"])
def test_proper_text_is_no_case(text):
    assert not mojibake.diagnose(text)[0]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_never_fails(text):
    hit, got, _ = mojibake.diagnose(text)
    assert isinstance(got, str) and (hit or got == text)


def test_frame(spark):
    rows = [(1, sloppy("Señal"), "x"), (2, None, "y"), (3, "", "z"), (4, "plain " * 20000, "w"), (1, sloppy("Señal"), "x")]
    df = spark.createDataFrame(rows, "id long, title string, restored string")
    got = mojibake.affected(df, "title").collect()
    assert [(r["id"], r["restored"]) for r in got] == [(1, "Señal")] * 2
    assert mojibake.affected(df.filter("false"), "title").count() == 0
