"""Problem 4: text that looks ordinary but is made of other characters.

Method: Unicode's quick-check properties tell which characters a normal form leaves alone in any
surroundings. A text of such characters only is returned as it is. In others, the unstable segments are
isolated: each unstable character with the starter before it and the marks after it, since normalisation
can reach no further. Only those segments are normalised, and spliced into the unchanged rest. The classes
are computed from Python's Unicode data, not listed; a letter that may be drawn to the one before it (quick check
"maybe": vowels and ends of Hangul syllables, vowel signs of Indic scripts) counts as unstable.

The form: canonical composition everywhere; compatibility forms that only change a letter's look (full and
half width, ligatures, letter-like and enclosed letters) decomposed; invisible characters removed; odd
blanks made blanks; letters of other scripts that stand inside Latin words for a Latin letter of the same look
replaced by it. Which letters look alike is read from Unicode's own table of confusable characters, in the form in
which Spark ships it. A word wholly of such letters is taken for Latin where the rest of the text is. Typographic quotes, dashes and the ellipsis, superscripts and
ordinals, and words wholly written in another script stay as they are; joiners stay between letters of
scripts that need them.

Garbled text (problem 2) is looked at as restored, so that the blanks and soft hyphens that garbling makes
are no cases. Null and empty texts are in form.
"""

from __future__ import annotations

import glob
import itertools
import os
import re
import struct
import unicodedata
import zipfile
from functools import lru_cache
from pathlib import Path

import pandas as pd
import pyspark
from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.llm import mojibake
from tapeloom.operators import shows
from tapeloom.tables import table

#: Where the table of confusable characters lies: in the ICU library in the folder "jars" of Spark's own home, or a path to it.
CONFUSABLES = ""
_IN_JAR = "com/ibm/icu/impl/data/icudata/confusables.cfu"
# Letters that only resemble a Latin one, which that table leaves out. They count inside a Latin word only.
RESEMBLE = {
    "γ": "y", "τ": "t", "η": "n", "ω": "w", "ε": "e", "κ": "k", "χ": "x", "υ": "u", "ι": "i", "З": "3", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "п": "n",
    "Ԛ": "Q", "Ү": "Y", "У": "Y", "ѵ": "v", "ց": "g", "զ": "q", "հ": "h", "һ": "h",
}
#: Scripts in whose words joiners and non-joiners are spelling.
_JOINED = ("ARABIC", "SYRIAC", "DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA", "MONGOLIAN", "KHMER")
#: Compatibility forms that are only another look of the same letters.
_LOOK_TAGS = ("<wide>", "<narrow>", "<font>", "<circle>", "<square>", "<compat>")


#: Scripts whose letters are not looked for in Latin words: Latin itself, and those that are not set letter by letter. Nor are letters written from right to left.
_APART = ("LATIN", "CJK", "HIRAGANA", "KATAKANA", "HANGUL")


def read_confusables(path: str = CONFUSABLES) -> dict[str, str]:
    """Every character and what it is confused with, from ICU's compiled table, in its library or by itself."""
    # Workers import pyspark out of an archive deep inside the home folder.
    homes = [os.environ.get("SPARK_HOME", ""), *map(str, Path(pyspark.__file__).parents)]
    found = [path] if path else [j for home in homes if home for j in sorted(glob.glob(os.path.join(home, "jars", "icu4j-*.jar")))]
    if not found or not os.path.exists(found[0]):
        raise FileNotFoundError(f"no table of confusable characters at {path or 'jars/icu4j-*.jar'}")
    if found[0].endswith(".jar"):
        with zipfile.ZipFile(found[0]) as z:
            data = z.read(_IN_JAR)
    else:
        data = Path(found[0]).read_bytes()
    body = data[int.from_bytes(data[:2], "big") :]
    keys_at, n, values_at, _, strings_at, _ = struct.unpack(">6i", body[12:36])
    out = {}
    for key, value in zip(struct.unpack(f">{n}i", body[keys_at : keys_at + 4 * n]), struct.unpack(f">{n}H", body[values_at : values_at + 2 * n])):
        # A key is a code point and, above it, the length less one; a value of length one is the character itself.
        length = (key >> 24 & 0xFF) + 1
        raw = value.to_bytes(2, "big") if length == 1 else body[strings_at + 2 * value : strings_at + 2 * (value + length)]
        out[chr(key & 0xFFFFFF)] = raw.decode("utf-16-be", "surrogatepass")
    return out


@lru_cache(maxsize=1)
def looks() -> tuple[dict[str, str], dict[str, str], re.Pattern]:
    """Letters of other scripts with the Latin letter of the same look; the same with those that only resemble one; any of both."""
    same = {}
    for c, other in read_confusables().items():
        if unicodedata.category(c)[0] == "L" and len(other) == 1 and other.isascii() and other.isalpha() and _script(c) not in _APART and unicodedata.bidirectional(c) == "L":
            # The table has one form for I and l, and for a letter whose capital is only larger the small one.
            twin = other.upper() if c.isupper() else other.lower() if c.islower() and c.upper() != c else other
            same[c] = "I" if other == "l" and not c.islower() else "i" if other == "l" and c.islower() and "IOTA" in unicodedata.name(c, "") else twin
    every = same | RESEMBLE
    return same, every, re.compile(f"[{''.join(map(re.escape, every))}]")


@lru_cache(maxsize=1)
def _classes() -> tuple[re.Pattern, re.Pattern, dict[str, str]]:
    """Quick check, segments and the look-only decompositions."""
    compat: dict[str, str] = {}
    loose, blanks, unseen = [], [], []
    # Quick check "maybe": what may be the second of a composed pair, and the vowels and ends of Hangul syllables.
    maybe = {chr(o) for o in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for o in range(0x80, 0x20000):
        pair = unicodedata.decomposition(chr(o)).split()
        if len(pair) == 2 and not pair[0].startswith("<") and unicodedata.is_normalized("NFC", chr(o)):
            maybe.add(chr(int(pair[1], 16)))
    # Nothing is assigned, or unstable, between these ranges.
    for o in itertools.chain(range(0x80, 0x20000), range(0x2F800, 0x2FA20), range(0xE0000, 0xE0200)):
        c = chr(o)
        kind = unicodedata.category(c)
        if kind in ("Cs", "Cn", "Co"):
            continue
        if kind == "Zs" or o in (0x2028, 0x2029, 0x85):
            blanks.append(c)
        elif (kind == "Cf" and not 0x600 <= o <= 0x605 and not 0x110BD <= o <= 0x110CD) or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= o <= 0xFE0F or 0x180B <= o <= 0x180F:
            unseen.append(c)
        else:
            d = unicodedata.decomposition(c)
            if d.startswith(_LOOK_TAGS) and o >= 0x2100 or d.startswith("<compat>") and unicodedata.name(c, "").startswith("LATIN") and o >= 0x17F:
                n = unicodedata.normalize("NFKC", c)
                if n != c and (kind[0] == "L" or kind == "Nl" or 0xFF00 <= o <= 0xFFEF or d.startswith(("<font>", "<circle>"))):
                    compat[c] = n
            if c not in compat and (c in maybe or unicodedata.combining(c) or not unicodedata.is_normalized("NFC", c)):
                loose.append(c)
    every = lambda s: "".join(map(re.escape, s))
    # \x85 is a control that garbling makes; it is no blank that anyone meant.
    blanks = [b for b in blanks if b != "\x85"]
    quick = re.compile(f"[{every(compat)}{every(loose)}{every(blanks)}{every(unseen)}]")
    segment = re.compile(f"[{every(compat)}{every(blanks)}{every(unseen)}]|[^{every(loose)}]?[{every(loose)}]+")
    return quick, segment, compat | {b: " " for b in blanks} | {u: "" for u in unseen}


_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1 << 12)
def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0]


def _latin_words(text: str) -> str:
    """Replaces letters of other scripts that stand for Latin ones."""
    same, every, any_look = looks()
    if not any_look.search(text):
        return text
    words = list(_WORD.finditer(text))
    scripts = [{_script(c) for c in m[0]} for m in words]
    if not any("LATIN" in s for s in scripts):
        return text
    # A word wholly of look-alikes stands for a Latin one only where no word is truly foreign.
    foreign = any(s - {"LATIN"} and "LATIN" not in s and any(c not in same for c in m[0]) for m, s in zip(words, scripts))
    out, at = [], 0
    for m, s in zip(words, scripts):
        w = m[0]
        fits = every if "LATIN" in s else {} if foreign else same
        if s - {"LATIN"} and all(c in fits or _script(c) == "LATIN" for c in w):
            out += [text[at : m.start()], "".join(fits.get(c, c) for c in w)]
            at = m.end()
    return "".join([*out, text[at:]])


def canonical(text: str) -> str:
    """The text in its one form; the very same text where it is in form already."""
    if text.isascii():
        return text
    quick, segment, simple = _classes()
    if quick.search(text):

        def splice(m: re.Match) -> str:
            s = m[0]
            if s in simple:
                if s in "‌‍" and 0 < m.start() and m.end() < len(text) and _script(text[m.start() - 1]) in _JOINED and _script(text[m.end()]) in _JOINED:
                    return s
                return simple[s]
            return unicodedata.normalize("NFC", s)

        # Removing what is unseen can bring a mark beside its letter, hence the second pass over what is left.
        first = segment.sub(splice, text)
        text = segment.sub(splice, first) if first != text else first
    return _latin_words(text)


def inspect(text: str) -> tuple[bool, str]:
    """(needed a change, the text in form). Garbled text is restored first."""
    if not text or text.isascii():
        return False, text
    damaged, restored, _ = mojibake.diagnose(text)
    base = restored if damaged else text
    form = canonical(base)
    return form != base, form


def changed(df: DataFrame, text: str) -> DataFrame:
    """Rows whose text needed it, with ``form`` (a column of that name is replaced). ASCII and null texts never leave the JVM."""
    df = df.drop("form")

    @F.pandas_udf("hit boolean, form string")
    def judge(texts: pd.Series) -> pd.DataFrame:
        seen: dict[str, tuple] = {}
        return pd.DataFrame([seen[t] if t in seen else seen.setdefault(t, inspect(t)) for t in texts], columns=["hit", "form"])

    odd = df.filter(F.col(text).rlike(r"[^\x00-\x7f]")).withColumn("__d", judge(text))
    return odd.filter("__d.hit").select(*df.columns, F.col("__d.form").alias("form"))


def in_form(df: DataFrame, text: str, into: str = "form") -> DataFrame:
    """Adds every text's form; null for null. ASCII texts never leave the JVM."""

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else inspect(t)[1])

    odd = F.coalesce(F.col(text).rlike(r"[^\x00-\x7f]"), F.lit(False))
    return df.filter(odd).withColumn(into, form(text)).unionByName(df.filter(~odd).withColumn(into, F.col(text)))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of problem 4: tbl, rec_id, text."""
    venues = shows.show_rows(shows.documents(spark, sf_dir)).select(F.lit("shows").alias("tbl"), F.col("show_id").alias("rec_id"), F.col("venue").alias("text"))
    return venues.unionByName(table(spark, sf_dir, "releases").select(F.lit("releases").alias("tbl"), F.col("id").alias("rec_id"), F.col("data.title").alias("text"))).unionByName(
        table(spark, sf_dir, "song_titles").select(F.lit("song_titles").alias("tbl"), F.col("rid").alias("rec_id"), F.col("title").alias("text"))
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text that needed a change."""
    return changed(texts(spark, sf_dir), "text").select("tbl", "rec_id").distinct()


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text that needed a change, with its form."""
    return changed(texts(spark, sf_dir), "text").distinct()


def p4_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its form, changed or not."""
    return in_form(texts(spark, sf_dir).distinct(), "text")


QUERIES = {q.__name__: q for q in (p4_found, p4_forms, p4_texts)}
