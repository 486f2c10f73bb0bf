"""Problem 2: text decoded with the wrong encoding.

Method: round-trip repair. The text is encoded again with each legacy encoding that it may have been read
with, and decoded strictly as each encoding it may have been written in; the result is kept when the
garbling cost drops, and the step repeats for nested layers. First the whole text is tried; if no step
helps, each run of suspicious words by itself, since a text may be garbled in part only.

The garbling cost knows no words: it counts what written language does not do. Control characters,
replacement characters, symbols that touch letters, letters of different scripts side by side, capitals
after small letters, words made of accented Latin letters only, phonetic letters and other rare ones. UTF-8
proves itself when a strict decode of several bytes succeeds, so any drop will do; single-byte encodings decode
anything, so what they give must be free of garbling. A text whose cost is 0 is left alone, and every change
lowers the cost of the whole text, so the layers end by themselves however many there are.

A text is affected when a repair is found or when it holds what no repair can remove: replacement and
control characters, or the remains of sequences whose bytes were lost. Null, empty and ASCII texts are
never affected.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeloom.operators import shows
from tapeloom.tables import table

#: Encodings a text may have been read with by mistake. "latin-1" and the Windows ones keep undefined bytes as controls.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859-2", "iso8859-15", "koi8-r", "cp866")
#: Single-byte confusions: encodings it may have been read with, and those it may then have been written in.
CONFUSED = (
    (("cp1252", "latin-1", "mac_roman", "cp437", "cp850"), ("cp1251", "koi8-r", "cp1253", "cp866", "mac_cyrillic")),
    (("cp1252", "latin-1"), ("cp1250", "iso8859-2")),
    (("cp1251", "koi8-r", "cp866"), ("cp1251", "koi8-r", "cp866")),
)

# Signs that the bytes of a sequence are shown as; the letters among them, in Windows-1252; quotes and dashes.
_SYMBOLS = set("¡¢£¤¥¦§¨©ª«¬®¯°±²³´¶·¸¹»¼½¾¿×÷‚„†‡•…‰‹›€™ƒˆ˜⌐₧\xa0\xad")
_SHOWN_LETTERS = set("ŠŒŽšœžŸ")
_QUOTES = set("“”‘’–—")
# Of the letters from U+0180 to U+02AF those that alphabets in use have (Azeri, Vietnamese, Pinyin, Romanian); the rest is rare.
_IN_USE = {0x18F, 0x192, 0x1A0, 0x1A1, 0x1AF, 0x1B0, *range(0x1CD, 0x1DD), 0x1E6, 0x1E7, *range(0x1FA, 0x200), *range(0x218, 0x21C), 0x259}
# Of the marks from U+0300 to U+036F those that such alphabets put on letters.
_MARKS = {*range(0x300, 0x30D), 0x30F, 0x311, 0x31B, *range(0x323, 0x329), 0x331}


def _table(encoding: str) -> dict[str, int]:
    out = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


@lru_cache(maxsize=1)
def _tables() -> dict[str, dict[str, int]]:
    return {e: _table(e) for e in READ_AS}


@lru_cache(maxsize=1 << 12)
def _kind(c: str) -> str:
    """What a character counts as: l and U for small and capital Latin letters of ASCII, a and A for others of
    Latin-1, e and E for further Latin ones, r for rare letters and marks, g/c with G/C for Greek and Cyrillic, s for a suspicious symbol, b for
    box drawing and mathematics, x for controls and replacements, - for the rest."""
    o = ord(c)
    if o < 128:
        return "l" if c.islower() else "U" if c.isupper() else "-"
    if 0x80 <= o < 0xA0 or c == "�" or 0xE000 <= o < 0xF900:
        return "x"
    if c in _SYMBOLS or c in "ºµ":
        return "s"
    if 0x2190 <= o < 0x2600:
        return "b"
    if 0x180 <= o < 0x2B0 and o not in _IN_USE or 0x300 <= o < 0x370 and o not in _MARKS:
        return "r"
    if unicodedata.category(c).startswith("L"):
        big = c.isupper()
        if o < 0x100:
            return "A" if big else "a"
        name = unicodedata.name(c, "")
        base = "g" if name.startswith("GREEK") else "c" if name.startswith("CYRILLIC") else "e" if name.startswith("LATIN") else "o"
        return base.upper() if big and base != "o" else base
    if c in _QUOTES:
        return "q"
    return "-"


_SCRIPT = {"l": "L", "U": "L", "a": "L", "A": "L", "e": "L", "E": "L", "g": "G", "G": "G", "c": "C", "C": "C", "o": "O"}
_WORD = re.compile(r"[^-]+")


def cost(text: str, strange_from: int = 4) -> float:
    """How garbled a text looks; 0 for ordinary text in any language. Words of accented letters only count from that length on."""
    kinds = "".join(map(_kind, text))
    total = 4.0 * kinds.count("x") + 2.0 * kinds.count("b") + 1.0 * kinds.count("r")
    for m in _WORD.finditer(kinds):
        w = m[0]
        letters = sum(k in _SCRIPT for k in w)
        for i, k in enumerate(w):
            after = w[i + 1] if i + 1 < len(w) else ""
            if k == "s":
                total += 1.0 if letters else 0.5
            elif k in _SCRIPT:
                if k == "A" and text[m.start() + i + 1 : m.start() + i + 2] in _SHOWN_LETTERS:
                    total += 0.5
                if after in _SCRIPT:
                    if _SCRIPT[k] != _SCRIPT[after]:
                        total += 1.0
                    elif k.islower() and after.isupper() and k + after != "lU":
                        total += 1.0
                elif after == "q" and (k not in "lU" or i + 2 < len(w) and w[i + 2] not in "lq"):
                    total += 0.25
        strange = sum(k in "aA" for k in w)
        if letters >= strange_from and strange == letters:
            total += letters
        elif strange >= 4 and strange * 3 >= letters * 2:
            total += strange / 2
    return total


def _recode(text: str, read_as: str) -> bytes | None:
    codes = _tables()[read_as]
    try:
        return bytes([codes[c] for c in text])
    except KeyError:
        return None


def step(text: str) -> str | None:
    """The text with one layer of garbling removed, or None."""
    now, best, kept = cost(text, 2), None, None
    for wrong in READ_AS:
        raw = _recode(text, wrong)
        if raw is None:
            continue
        try:
            got = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if len(got) < len(text):
            c = cost(got, 2)
            if c < now and (best is None or c < best):
                best, kept = c, got
    if kept is not None:
        return kept
    # Single bytes prove nothing: here a word must be longer ("été" and "Äöü" are words), a hard blank is no sign of
    # anything, and the result flawless.
    now = cost(text.replace("\xa0", " "))
    if now < 2:
        return None
    kinds = "".join(map(_kind, text))
    mixed = any(len({_SCRIPT[k] for k in m[0] if k in _SCRIPT}) > 1 for m in _WORD.finditer(kinds))
    inner = re.search(r"[lUaAeE]s[lUaAeE]", kinds)
    for reads, rights in CONFUSED:
        if mixed or "cp1250" in rights and not inner:
            continue  # a letter of another script inside a Latin word is a disguise, not an encoding
        for wrong in reads:
            raw = _recode(text, wrong)
            for right in rights if raw else ():
                try:
                    got = raw.decode(right)
                except UnicodeDecodeError:
                    continue
                c = cost(got)
                if got != text and c < 0.5 and (best is None or c < best):
                    best, kept = c, got
    return kept if best is not None and best < now - 1.5 else None


def _layers(text: str) -> str:
    while True:
        better = step(text)
        if better is None:
            return text
        text = better


_RUN = re.compile(r"\S*[^\x00-\x7f]\S*(?:[ \xa0]\S*[^\x00-\x7f]\S*)*")
_SINGLE = re.compile(r"\S*[^\x00-\x7f](?:\S|\xa0)*")
#: A UTF-8 sequence of two or three bytes inside a word, as any of the encodings shows its lead byte.
_ATOM = re.compile(r"[^\x00-\x7f]{2,}")


def repair(text: str) -> str:
    """The text with its garbling undone as far as it can be: as a whole, else its runs, words and sequences."""
    now = cost(text, 2)
    while now:
        for attempt in (_layers, *(lambda t, p=p: p.sub(lambda m: _layers(m[0]), t) for p in (_RUN, _SINGLE, _ATOM))):
            got = attempt(text)
            if got != text and (c := cost(got, 2)) < now:
                text, now = got, c
                break
        else:
            break
    return text


#: What stays behind where some bytes of a sequence were lost.
_REMAINS = re.compile(r"[\x80-\x9f�]|[ÃÂ](?=[\s?]|$)(?<![A-ZÀ-Þ][ÃÂ])(?<!^[ÃÂ])|â€|Ã[\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")


def diagnose(text: str) -> tuple[bool, str, bool]:
    """(affected, text as restored, wholly restored)."""
    if not text or text.isascii():
        return False, text, True
    got = repair(text)
    left = bool(_REMAINS.search(got)) or any(_kind(c) == "b" for c in got)
    return got != text or left, got, not left


def affected(df: DataFrame, text: str) -> DataFrame:
    """Only the affected rows, with restored and complete; columns of those names are replaced. Null texts are never affected, and ASCII ones never leave the JVM."""
    df = df.drop("restored", "complete")

    @F.pandas_udf("affected boolean, restored string, complete boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        seen: dict[str, tuple] = {}
        rows = [seen[t] if t in seen else seen.setdefault(t, diagnose(t)) for t in texts]
        return pd.DataFrame(rows, columns=["affected", "restored", "complete"])

    odd = df.filter(F.col(text).rlike(r"[^\x00-\x7f]"))
    return odd.withColumn("__d", judge(text)).filter("__d.affected").select(*df.columns, "__d.restored", "__d.complete")


def _no_place() -> list[Column]:
    return [F.lit(0).cast("long").alias("part_no"), F.lit(0).cast("long").alias("track_no")]


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All titles with their places: tbl, rec_id, part_no, track_no, title."""
    tracks = shows.track_rows(shows.documents(spark, sf_dir))
    return (
        tracks.select(F.lit("shows").alias("tbl"), F.col("show_id").alias("rec_id"), "part_no", "track_no", "title")
        .unionByName(table(spark, sf_dir, "releases").select(F.lit("releases").alias("tbl"), F.col("id").alias("rec_id"), *_no_place(), F.col("data.title").alias("title")))
        .unionByName(table(spark, sf_dir, "song_titles").select(F.lit("song_titles").alias("tbl"), F.col("rid").alias("rec_id"), *_no_place(), "title"))
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every garbled title's place."""
    return affected(titles(spark, sf_dir), "title").select("tbl", "rec_id", "part_no", "track_no").distinct()


def p2_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every garbled title with what could be restored."""
    return affected(titles(spark, sf_dir), "title").distinct()


QUERIES = {q.__name__: q for q in (p2_found, p2_repair)}
