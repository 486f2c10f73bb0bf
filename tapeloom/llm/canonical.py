"""Problem 5: values typed freely, mapped to the entries of a reference list.

Method: a multi-pattern automaton (Aho-Corasick) over the folded names and their aliases finds the mentions
embedded in a value, at word boundaries; the longest non-overlapping ones win. What has no mention goes to
token-set similarity: every word of the entry must have its own word in the value, equal, one typing
error away, or its abbreviation. Candidates come from an index of the entries' rarest words and of what is left of
them with one letter taken out: an entry is never meant without its rarest word, so a word that thousands of
names have brings up only those entries that have no rarer one.

Of entries with one name, the record's other fields (city, state) choose. Values without an entry map to ''.
Only distinct values are mapped, whatever the number of rows. The list is sent to all tasks; its size is
checked, and a list beyond ``MOST_ENTRIES`` is mapped shard by shard. Every shard gives its best entry with what
it is the best by (kind of match, length or score, place, region, weight), and the least of all shards wins, as
it would in one list.

Null and blank values give no rows. Values are equal to an entry only character for character.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.llm import lookalike
from tapeloom.operators import shows
from tapeloom.tables import cut, table

#: Entries of a list that every task may hold (some 100 bytes each).
MOST_ENTRIES = 200_000
# Letters that no decomposition reduces to ASCII.
LETTERS = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "đ": "d", "Đ": "D", "ð": "d", "þ": "th", "ı": "i", "’": "'"})
# Short forms of words in names of places.
SHORT = {"st": "saint", "ste": "saint", "ft": "fort", "mt": "mount", "hts": "heights", "fls": "falls"}


def plain(text: str) -> str:
    """The text in its one form, with accents taken off."""
    s = unicodedata.normalize("NFKD", lookalike.canonical(text).translate(LETTERS))
    return "".join(c for c in s if not unicodedata.combining(c))


def fold(text: str) -> str:
    """Lower-case ASCII words with single blanks between."""
    s = plain(text).lower().replace("'", "")
    s = re.sub(r"\b([a-z])\.(?=[a-z]\b)", r"\1", s)
    return re.sub(r"[^a-z0-9]+", " ", s).strip()


def near(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    a, b = sorted((a, b), key=len)
    return a[i:] == b[i + 1 :]


def short_for(a: str, b: str) -> bool:
    """Whether a is an abbreviation of b: shorter, the same first letter, its letters in b's order."""
    if not 1 <= len(a) < len(b) or a[0] != b[0] or len(a) > 1 and len(b) - len(a) < 1:
        return False
    it = iter(b)
    return all(c in it for c in a)


def _less(w: str) -> set[str]:
    return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} if len(w) >= 4 else {w}


#: What an entry is the best by, least first: kind of match, then length or score, place in the text, agreement of place and region, weight.
_BY = "kind int, by double, start int, place_apart int, region_apart int, lightness double"
_NONE = (9, 0.0, 0, 0, 0, 0.0)


class Lexicon:
    """A reference list made ready: entries of (ref, name, place, region) and maybe weight and core (the name's rarest
    word in the whole list, if this is a part of it), with further names by ref."""

    def __init__(self, entries: Iterable[tuple], aliases: dict[str, list[str]] | None = None, codes: bool = False):
        import ahocorasick

        self.codes = codes
        given = [(*e, *(0.0, None)[len(e) - 4 :]) for e in entries]
        self.entries = [(ref, fold(name), fold(place or ""), (region or "").lower(), float(weight)) for ref, name, place, region, weight, _ in given]
        self.names: dict[str, list[int]] = defaultdict(list)
        self.exact: dict[str, list[int]] = defaultdict(list)
        for i, (ref, name, *_) in enumerate(self.entries):
            for alias in {a for n in (name, *map(fold, (aliases or {}).get(ref, ()))) for a in self._forms(n)}:
                self.names[alias].append(i)
                self.exact[alias.replace(" ", "")].append(i)
            if codes:
                self.exact[ref.lower()].append(i)
        self.automaton = ahocorasick.Automaton()
        for alias in self.names:
            self.automaton.add_word(f" {alias} ", alias)
        if len(self.automaton):
            self.automaton.make_automaton()
        counts = Counter(w for _, name, *_ in self.entries for w in set(name_words(name)))
        self.cores = [core if core is not None else core_of(name_words(name), counts) for (_, name, *_), (*_, core) in zip(self.entries, given)]
        self.words: dict[str, set[str]] = defaultdict(set)
        self.heads: dict[str, set[str]] = defaultdict(set)
        self.of: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(self.cores):
            if w:
                self.of[w].append(i)
                self.heads[w[:4]].add(w)
                for v in _less(w):
                    self.words[v].add(w)

    @staticmethod
    def _forms(name: str) -> set[str]:
        """A name as it may be written: without article, with its last words first, without "city"."""
        bare = re.sub(r"^the | the$", "", name)
        w = bare.split()
        forms = {name, bare} | {" ".join(w[-k:] + w[:-k]) for k in (1, 2) if len(w) > k}
        if len(w) > 1 and w[-1] == "city":
            forms.add(" ".join(w[:-1]))
        return {f for f in forms if f}

    def mentions(self, text: str) -> list[tuple[str, int]]:
        """The longest non-overlapping names in a folded text, with their places."""
        found = [(len(a), end - len(a) - 1, a) for end, a in self.automaton.iter(f" {text} ")] if len(self.automaton) else []
        taken, out = [], []
        for n, start, a in sorted(found, key=lambda f: (-f[0], f[1])):
            if all(start + n < s or e < start for s, e in taken):
                taken.append((start, start + n))
                out.append((a, start))
        return out

    def similar(self, text: str) -> list[tuple[float, int]]:
        """Entries whose every word has its own in the text."""
        words = [SHORT.get(w, w) for w in text.split()]
        met = {full for w in words for v in _less(w) for full in self.words.get(v, ()) if near(w, full)}
        met |= {full for w in words if len(w) >= 4 for full in self.heads.get(w[:4], ()) if full.startswith(w)}
        out = []
        for core in met:
            for i in self.of[core]:
                name = name_words(self.entries[i][1])
                left, score = list(words), 0.0
                for w in sorted(name, key=len, reverse=True):
                    best, which = 0.0, None
                    for x in left:
                        s = 1.0 if x == w else 0.9 if len(w) >= 4 and len(x) >= 3 and near(x, w) else 0.8 if len(x) >= 4 and w.startswith(x) else 0.7 if w != core and short_for(x, w) else 0.0
                        if s > best:
                            best, which = s, x
                    if which is None:
                        break
                    left.remove(which)
                    score += best * len(w)
                else:
                    out.append((round(score / sum(map(len, name)) - 0.01 * len(left), 9), i))
        return out

    def choose(self, found: Iterable[int], place: str, region: str) -> tuple[int, int, float, str]:
        """Of namesakes, the one that the record's place or region means, else the one of most weight, else the least ref:
        (how far its place is, its region, lightness, ref)."""

        def apart(i: int) -> tuple[int, int, float, str]:
            ref, _, own_place, own_region, weight = self.entries[i]
            where = 0 if not place or own_place == place else 1 if own_place and near(own_place.replace(" ", ""), place.replace(" ", "")) else 2
            return where, int(bool(region) and own_region != region), -weight, ref

        return min(map(apart, set(found)))

    def best(self, value: str, place: str = "", region: str = "") -> tuple[tuple, str, float]:
        """(what it is the best by, ref or '', similarity)."""
        text, where = fold(value), fold(place)
        whole = self.exact.get(text.replace(" ", ""))
        if whole:
            *far, ref = self.choose(whole, where, region)
            return (0, 0.0, 0, *far), ref, 1.0
        if self.codes and len(text.replace(" ", "")) <= 2:
            return _NONE, "", 0.0
        for kind, said in enumerate((text, " ".join(SHORT.get(w, w) for w in text.split())), 1):
            if named := self.mentions(said):
                alias, start = named[0]
                *far, ref = self.choose(self.names[alias], where, region)
                return (kind, -float(len(alias)), start, *far), ref, 0.95
        for kind, part in enumerate(dict.fromkeys((fold(re.sub(r"\([^)]*\)?", " ", value)), fold(re.split(r" [-–—@|/] |,|\(", value)[0]), text)), 3):
            if near_ones := self.similar(part):
                score = max(s for s, _ in near_ones)
                *far, ref = self.choose([i for s, i in near_ones if s == score], where, region)
                return (kind, -score, 0, *far), ref, score
        return _NONE, "", 0.0

    def resolve(self, value: str, place: str = "", region: str = "") -> tuple[str, float]:
        """(ref or '', similarity)."""
        return self.best(value, place, region)[1:]


def name_words(name: str) -> list[str]:
    return [w for w in name.split() if w != "the"]


def core_of(words: list[str], counts: dict[str, int]) -> str:
    """The word that fewest names have; of those the longest, then the first."""
    return max(words, key=lambda w: (-counts[w], len(w)), default="")


def _with_cores(listed: DataFrame) -> DataFrame:
    """The same by Spark, for lists of any length: adds ``core``."""

    @F.pandas_udf("array<string>")
    def words(names: pd.Series) -> pd.Series:
        return names.map(lambda n: name_words(fold(n)))

    named = cut(listed.select("name").distinct().withColumn("words", words("name")))
    each = named.select("name", F.posexplode("words").alias("at", "word"))
    counts = listed.join(each, "name").groupBy("word").agg(F.count_distinct("ref", "name").alias("n"))
    cores = each.join(counts, "word").groupBy("name").agg(F.max_by("word", F.struct(-F.col("n"), F.length("word"), -F.col("at"))).alias("core"))
    return listed.join(cores, "name", "left").fillna("", ["core"])


_LEXICONS: dict[str, Lexicon] = {}


def _lexicon(pdf: pd.DataFrame, codes: bool) -> Lexicon:
    text = lambda x: x if isinstance(x, str) else ""
    cols = ["ref", "name", "place", "region", "weight", *(["core"] if "core" in pdf else [])]
    rows = [(*map(text, r[:4]), *r[4:]) for r in pdf[cols].itertuples(index=False, name=None)]
    return Lexicon(rows, {r: [a for a in al if a] for r, al in zip(pdf["ref"], pdf["aliases"]) if al is not None}, codes)


def _sent_lexicon(name: str, sent, codes: bool) -> Lexicon:
    """The lexicon of a list sent to all, built once for each worker process and not for each task."""
    if name not in _LEXICONS:
        while len(_LEXICONS) > 3:
            _LEXICONS.pop(next(iter(_LEXICONS)))
        _LEXICONS[name] = _lexicon(sent.value, codes)
    return _LEXICONS[name]


def _resolved(lexicon: Lexicon, pdf: pd.DataFrame) -> pd.DataFrame:
    text = lambda x: x if isinstance(x, str) else ""
    got = [lexicon.best(v, text(p), text(r)) for v, p, r in zip(pdf["value"], pdf["place"], pdf["region"])]
    same = {c: pd.Series([x if isinstance(x, str) else None for x in pdf[c]], dtype=object) for c in ("value", "place", "region")}
    by = {c.split()[0]: pd.Series([g[0][k] for g in got], dtype="float64" if c.endswith("double") else "int32") for k, c in enumerate(_BY.split(", "))}
    return pd.DataFrame(same | by | {"ref": pd.Series([g[1] for g in got], dtype=object), "similarity": pd.Series([g[2] for g in got], dtype="float64")})


def map_values(values: DataFrame, entries: DataFrame, codes: bool = False, most: int = MOST_ENTRIES) -> DataFrame:
    """Maps distinct (value, place, region) to ``ref``, with ``similarity``.

    ``entries`` has ref, name, place, region and may have aliases (array of strings), all read as strings, and
    weight: where nothing tells namesakes apart, the one of most weight is meant, then the least ref.
    """
    spark = values.sparkSession
    n = entries.count()
    cols = [F.col(c).cast("string").alias(c) for c in ("ref", "name", "place", "region")] + [F.col("aliases") if "aliases" in entries.columns else F.lit(None).cast("array<string>").alias("aliases")]
    cols.append(F.coalesce((F.col("weight") if "weight" in entries.columns else F.lit(0)).cast("double"), F.lit(0.0)).alias("weight"))
    listed = entries.filter("name is not null and ref is not null").select(*cols)
    # Few bytes but much work for each value: as many tasks as there are cores, where coalescing by size would make one.
    tasks = 2 * spark.sparkContext.defaultParallelism
    distinct = values.filter("value is not null").select("value", "place", "region").distinct().repartition(tasks)
    schema = f"value string, place string, region string, {_BY}, ref string, similarity double"
    out = ["value", "place", "region", "ref", "similarity"]
    if n <= most:
        sent, name = spark.sparkContext.broadcast(listed.toPandas()), uuid.uuid4().hex

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lexicon = _sent_lexicon(name, sent, codes)
            for pdf in batches:
                yield _resolved(lexicon, pdf)

        return distinct.mapInPandas(each, schema).select(*out)
    shards = -(-n // most)
    salts = spark.sparkContext.defaultParallelism
    left = distinct.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(salts))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = _with_cores(listed).withColumn("shard", F.pmod(F.xxhash64("ref", "name"), F.lit(shards)).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    both = left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInPandas(lambda a, b: _resolved(_lexicon(b, codes), a), schema)
    best = F.min(F.struct(*[c.split()[0] for c in _BY.split(", ")], "ref", "similarity")).alias("m")
    return both.groupBy("value", "place", "region").agg(best).select("value", "place", "region", "m.ref", "m.similarity")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All typed values: tbl, field, rec_id, value, place, region. A region is a code where it can be read as one."""
    s = cut(shows.fields(spark, sf_dir, "venue", "city", "state"))
    states = mapped_states(spark, sf_dir, s.select("state"))
    s = s.join(states, "state", "left")
    venues = s.select(F.lit("shows").alias("tbl"), F.lit("venue").alias("field"), F.col("show_id").alias("rec_id"), F.col("venue").alias("value"), F.col("city").alias("place"), F.col("code").alias("region"))
    codes = s.select(F.lit("shows").alias("tbl"), F.lit("state").alias("field"), F.col("show_id").alias("rec_id"), F.col("state").alias("value"), F.lit(None).cast("string").alias("place"), F.lit(None).cast("string").alias("region"))
    learned = table(spark, sf_dir, "venues").select(F.lit("venues").alias("tbl"), F.lit("city").alias("field"), F.col("rid").alias("rec_id"), F.col("city").alias("value"), F.lit(None).cast("string").alias("place"), F.lower("state").alias("region"))
    return venues.unionByName(codes).unionByName(learned).filter("value is not null and value <> ''")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "countries").select(F.col("code").alias("cc"), F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("lands"))
    states = table(spark, sf_dir, "ref_states").join(names, "cc", "left")
    return states.select(F.col("code").alias("ref"), "name", F.lit("").alias("place"), F.lit("").alias("region"), F.transform("lands", lambda c: F.concat_ws(" ", F.col("name"), c)).alias("aliases"))


def mapped_states(spark: SparkSession, sf_dir: str, states: DataFrame) -> DataFrame:
    """Distinct typed states with the code they mean, in lower case; only those that mean one."""
    values = states.filter("state is not null").select(F.col("state").alias("value"), F.lit("").alias("place"), F.lit("").alias("region"))
    got = map_values(values, _states(spark, sf_dir), codes=True)
    return got.filter("ref <> ''").select(F.col("value").alias("state"), F.lower("ref").alias("code"))


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = cut(_typed(spark, sf_dir).distinct())
    lists = {
        "venue": (table(spark, sf_dir, "ref_venues").select(F.col("venue_id").alias("ref"), F.col("venue").alias("name"), F.col("city").alias("place"), F.col("state").alias("region")), False),
        "state": (_states(spark, sf_dir), True),
        "city": (table(spark, sf_dir, "places").select(F.col("gid").alias("ref"), "name", F.lit("").alias("place"), F.col("admin").alias("region"), F.col("pop").alias("weight")), False),
    }
    out = None
    for field, (entries, codes) in lists.items():
        mine = typed.filter(F.col("field") == field)
        # An entry's own spelling is no case. The list's distinct names are as few as its entries.
        names = entries.select(F.col("ref" if codes else "name").alias("value")).distinct()
        cases = mine.join(names, "value", "left_anti")
        got = map_values(cases, entries, codes)
        rows = cases.join(got, (cases["value"] == got["value"]) & cases["place"].eqNullSafe(got["place"]) & cases["region"].eqNullSafe(got["region"])).select("tbl", "field", "rec_id", cases["value"], "ref", "similarity")
        out = rows if out is None else out.unionByName(rows)
    return out


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value that is no entry, with the entry meant or ''."""
    return _mapped(spark, sf_dir).select("tbl", "field", "rec_id", "ref").distinct()


def p5_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the value and the similarity of the match."""
    return _mapped(spark, sf_dir).distinct()


QUERIES = {q.__name__: q for q in (p5_found, p5_mapped)}
