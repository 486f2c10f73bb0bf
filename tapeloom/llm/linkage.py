"""Problem 6: matching shows and releases of one performance without a common key.

Method: label-model linkage. Candidates share an act (problem 3's classes, or the code that folder and
release id both begin with) and a night, or for incomplete dates a month or a place. Many heuristic
functions vote on each candidate: match, no match, or nothing. A generative model learns from the votes
alone how often each function is right and wrong in either class, and which of them depend on each other:
functions whose votes correlate beyond what the classes explain are joined to one factor. Its posterior is
the candidate's confidence, shared out where a release fits several performances, since it is of one.

The model sees counts of vote patterns over all candidates. There are at most 3^(number of functions)
patterns, so that summary, and the posterior by pattern that comes back, do not grow with the data.
Candidates are formed between distinct profiles, not rows: repeated rows and recordings with the same
particulars are compared once and expanded at the end.

A show without act or date matches nothing. Nulls and blanks in other fields abstain.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tapeloom.llm import canonical, names
from tapeloom.llm.canonical import fold, near
from tapeloom.operators import shows
from tapeloom.tables import cut, table

FUNCTIONS = ("night", "part_of_date", "venue_entry", "venue_words", "city", "region", "title", "spelling", "owned")
#: Residual correlation from which two functions are one factor.
DEPENDENT = 0.2
#: Pseudo-counts of each vote.
SMOOTH = 1.0
#: Confidence above which a candidate is a match: two equal claims on a release are both too weak.
ENOUGH = 0.5
#: Confidence from which a candidate is reported at all.
REPORTED = 0.05
#: Candidates that one task forms of a block, about; larger blocks are split.
BLOCK_PAIRS = 200_000
_DATE = r"(?<!\d)(\d{4}-\d\d-\d\d|\d{4}\.\d\d\.\d\d|\d\d-\d\d-\d\d)(?!\d)"


class LabelModel:
    """Two latent classes and factors of one or two voters, fitted by expectation maximisation over vote patterns."""

    def __init__(self, rounds: int = 200):
        self.rounds = rounds
        self.factors: list[tuple[int, ...]] = []

    def _codes(self, votes: np.ndarray) -> list[np.ndarray]:
        return [sum((votes[:, j] + 1) * 3**k for k, j in enumerate(f)) for f in self.factors]

    def _em(self, votes: np.ndarray, counts: np.ndarray, post: np.ndarray, never: np.ndarray) -> np.ndarray:
        codes = self._codes(votes)
        for _ in range(self.rounds):
            self.prior = float(np.clip((counts * post).sum() / counts.sum(), 1e-4, 1 - 1e-4))
            self.tables = []
            score = np.full(len(votes), np.log(self.prior) - np.log(1 - self.prior))
            for f, c in zip(self.factors, codes):
                n = 3 ** len(f)
                digits = np.arange(n)[:, None] // 3 ** np.arange(len(f)) % 3
                # Whether a function votes says nothing about the class; only how it votes does.
                _, silent = np.unique((digits == 1) @ (2 ** np.arange(len(f))), return_inverse=True)
                yes = np.bincount(c, counts * post, n) + SMOOTH
                no = np.bincount(c, counts * (1 - post), n) + SMOOTH
                ratio = np.log(yes / np.bincount(silent, yes)[silent]) - np.log(no / np.bincount(silent, no)[silent])
                self.tables.append(ratio)
                score += ratio[c]
            new = np.where(never, 0.0, 1 / (1 + np.exp(-np.clip(score, -40, 40))))
            if np.abs(new - post).max() < 1e-7:
                return new
            post = new
        return post

    def fit(self, votes: np.ndarray, counts: np.ndarray, weight: np.ndarray, never: np.ndarray) -> np.ndarray:
        """Posterior of each pattern. ``weight`` tells which functions the first guess is taken from; patterns in
        ``never`` are no match by definition, and teach the model what such candidates look like."""
        m = votes.shape[1]
        joined: list[tuple[int, int]] = []
        while True:
            free = [j for j in range(m) if not any(j in p for p in joined)]
            self.factors = [*joined, *((j,) for j in free)]
            # Two dependent functions say one thing twice: each has half the weight in the first guess.
            half = np.array([1.0 if j in free else 0.5 for j in range(m)])
            post = self._em(votes, counts, 1 / (1 + np.exp(-(votes * weight * half).sum(axis=1).astype(float))), never)
            rest = np.abs(self._unexplained(votes, counts, post))
            rest[[j for j in range(m) if j not in free]] = 0
            rest[:, [j for j in range(m) if j not in free]] = 0
            a, b = divmod(int(rest.argmax()), m)
            # One pair at a time: what two functions share can make others look dependent too.
            # Three factors at least must remain, or the classes can't be told from the votes.
            if rest[a, b] < DEPENDENT or len(self.factors) <= 3:
                return post
            joined.append((a, b))

    @staticmethod
    def _unexplained(votes: np.ndarray, counts: np.ndarray, post: np.ndarray) -> np.ndarray:
        """Correlations of the votes within the classes."""
        rest = np.zeros((votes.shape[1],) * 2)
        for p in (post, 1 - post):
            w = counts * p
            mean = (votes * w[:, None]).sum(axis=0) / max(w.sum(), 1e-9)
            rest += ((votes - mean) * w[:, None]).T @ (votes - mean)
        sd = np.sqrt(np.clip(np.diag(rest), 1e-9, None))
        rest = rest / sd[:, None] / sd[None, :]
        np.fill_diagonal(rest, 0)
        return rest


def likeness(a: str, b: str) -> float:
    """How alike two folded names of places are: 1 if every word of the shorter has its own in the longer, else by their longest words."""
    x, y = ([w for w in t.split() if w not in ("the", "at", "live")] for t in sorted((a, b), key=lambda t: len(t.split())))
    if not x:
        return 0.0
    hit = sum(any(near(w, v) and len(w) > 3 or w == v or canonical.short_for(w, v) or canonical.short_for(v, w) for v in y) for w in x)
    if hit == len(x) and any(near(w, v) and len(w) > 4 for w in x for v in y):
        return 1.0
    return max(SequenceMatcher(None, w, v, False).ratio() for w in x for v in y if len(w) > 4 or len(v) > 4 or len(x) == 1) if any(len(w) > 4 for w in x + y) or len(x) == 1 else 0.0


def _compared(f, kind: str):
    """A function of two texts over columns: once for each pair of texts in a batch, null where either is null."""

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple, object] = {}
        out = []
        for pair in zip(a, b):
            if pair[0] is None or pair[1] is None:
                out.append(None)
                continue
            if pair not in known:
                known[pair] = f(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype=object)

    return run


def votes() -> dict[str, Column]:
    """The functions' votes on a candidate: 1, -1 or 0. Only texts that differ are compared in Python."""
    alike, close = _compared(likeness, "double"), _compared(near, "boolean")
    c = F.col
    said = lambda *names: [c(n) != "" for n in names]
    both = lambda a, b: (c(a) != "") & (c(b) != "")
    yes_no = lambda test: F.when(test, 1).otherwise(-1)
    venues = F.when(both("s_venue", "r_venue"), F.when(c("s_venue") == c("r_venue"), 1.0).otherwise(alike(*[F.when(both("s_venue", "r_venue") & (c("s_venue") != c("r_venue")), c(v)) for v in ("s_venue", "r_venue")])))
    title = F.concat(F.lit(" "), c("r_title"), F.lit(" "))
    named = lambda v: (c(v) != "") & F.contains(title, F.concat(F.lit(" "), c(v), F.lit(" ")))
    told = named("s_venue") | named("s_city")
    place = F.substring_index(F.expr("substring(concat(' ', r_title, ' '), locate(' live at ', concat(' ', r_title, ' ')) + 9)"), " on ", 1)
    asks = ~told & F.contains(title, F.lit(" live at ")) & both("s_venue", "s_city")
    of_title = F.greatest(*[alike(F.when(asks, c(v)), F.when(asks, place)) for v in ("s_venue", "s_city")])
    cities = both("s_city", "r_city") & ~both("s_city_ref", "r_city_ref")
    found = {
        "night": F.when(c("r_night").isNotNull(), yes_no(c("r_night") == c("s_night"))),
        "part_of_date": F.when(c("r_night").isNull() & c("r_part").isNotNull() & (c("r_part") != ""), yes_no(c("s_night").startswith(c("r_part")))),
        "venue_entry": F.when(both("s_venue_ref", "r_venue_ref"), yes_no(c("s_venue_ref") == c("r_venue_ref"))),
        # A listed name against one that is not listed may be a name against a remark.
        "venue_words": F.when(venues >= 0.75, 1).when((venues < 0.6) & (said("s_venue_ref")[0] == said("r_venue_ref")[0]), -1),
        "city": F.when(both("s_city_ref", "r_city_ref"), yes_no(c("s_city_ref") == c("r_city_ref"))).when(cities, yes_no(close(*[F.when(cities, c(v)) for v in ("s_city", "r_city")]))),
        "region": F.when(both("s_region", "r_region"), yes_no(c("s_region") == c("r_region"))),
        "title": F.when(c("r_title") != "", F.when(told, 1).when(of_title >= 0.75, 1).when(of_title < 0.6, -1)),
        "spelling": F.when((c("s_key") != "") & (c("s_key") == c("r_key")), 1),
        "owned": F.when(c("owned"), 1).when(~c("owned"), -1),
    }
    return {f: F.coalesce(found[f], F.lit(0)) for f in FUNCTIONS}


def _keyed(name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), F.lit("")), F.nullif(F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " ")), F.lit("")))


def _folded(c: Column) -> Column:
    @F.pandas_udf("string")
    def folded(s: pd.Series) -> pd.Series:
        return s.map(lambda x: fold(x) if x else "")

    return folded(c)


def _show_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """show_id, name, code, night, venue, city, state: from the meta, or from the folder name where the meta says nothing."""
    told = ("artist", "date", "venue", "city", "state")
    meta = shows.fields(spark, sf_dir, *told).select("show_id", *[F.nullif(F.trim(c), F.lit("")).alias(c) for c in told])
    folder = table(spark, sf_dir, "shows").select(F.col("id").alias("show_id"), F.coalesce("folder_name", F.lit("")).alias("folder")).distinct()
    found = F.replace(F.regexp_extract("folder", _DATE, 1), F.lit("."), F.lit("-"))
    full = F.when(F.length(found) == 8, F.concat(F.when(F.substring(found, 1, 2) > "40", "19").otherwise("20"), found)).when(F.length(found) == 10, found)
    head = F.regexp_extract("folder", names._HEAD.pattern, 1)
    letters = F.regexp_replace(head, "[^A-Za-z]", "")
    # "… 1998-11-06 Some Hall, Some City, ST [SBD]"
    after = F.trim(F.regexp_replace(F.regexp_extract("folder", r"\d\d[-.]\d\d\s+([^\[]+)", 1), r"\s+$", ""))
    bits = F.split(after, r"\s*,\s*")
    n = F.size(bits)
    from_folder = lambda at, least: F.when(F.contains(after, F.lit(",")) & (n >= least), F.try_element_at(bits, F.lit(at)))
    s = folder.join(meta, "show_id", "left")
    return s.select(
        "show_id",
        F.coalesce("artist", F.when(F.length(letters) > 5, head)).alias("name"),
        F.when((F.length(letters) <= 5) & (letters != ""), F.lower(letters)).alias("code"),
        F.coalesce(F.when(F.col("date").rlike(r"^\d{4}-\d\d-\d\d$"), F.col("date")), full).alias("night"),
        F.coalesce("venue", from_folder(1, 2), F.lit("")).alias("venue"),
        F.coalesce("city", from_folder(-2, 3), F.lit("")).alias("city"),
        F.coalesce("state", from_folder(-1, 3), F.lit("")).alias("state"),
    ).filter("night is not null")


def _release_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel_id, name, code, night or part (the date's known beginning), venue, city, state, title, owned."""
    r = table(spark, sf_dir, "releases").select("id", "release_id", "data.title", "data.artist", "data.date", "data.venue", "data.location", "data.owned").distinct()
    d = F.trim(F.coalesce("date", F.lit("")))
    us = lambda k: F.regexp_extract(d, r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})$", k)
    year = F.when(F.length(us(3)) == 2, F.concat(F.when(us(3) > "40", "19").otherwise("20"), us(3))).otherwise(us(3))
    night = F.when(d.rlike(r"^\d{4}-\d\d-\d\d"), F.substring(d, 1, 10)).when(us(1) != "", F.concat_ws("-", year, F.lpad(us(1), 2, "0"), F.lpad(us(2), 2, "0")))
    # "1995-05-00" and "1995-00-00" say no night: only a day of the calendar does.
    day = lambda c: F.date_format(F.try_to_date(c), "yyyy-MM-dd")
    told = F.coalesce("title", F.lit(""))
    said = F.regexp_extract(told, r"(?<!\d)(\d{4}-\d\d-\d\d)(?!\d)", 1)
    in_id = F.regexp_extract(F.coalesce("release_id", F.lit("")), r"^[a-z]+(\d{4}-\d\d-\d\d)", 1)
    night = F.coalesce(day(night), day(F.nullif(said, F.lit(""))), day(F.nullif(in_id, F.lit(""))))
    known_part = F.regexp_extract(d, r"^(\d{4}(?:-(?:0[1-9]|1[0-2]))?)(?:$|-00)", 1)
    part = F.when(known_part != "", known_part).otherwise(F.nullif(F.regexp_extract(told, r"\((\d{4})\)", 1), F.lit("")))
    place = F.split(F.trim(F.coalesce("location", F.lit(""))), r"\s*,\s*")
    return r.select(
        F.col("id").alias("rel_id"),
        F.nullif(F.trim("artist"), F.lit("")).alias("name"),
        F.nullif(F.regexp_extract(F.coalesce("release_id", F.lit("")), r"^([a-z]{1,5})(?:\d|-)", 1), F.lit("")).alias("code"),
        night.alias("night"),
        F.when(night.isNull(), part).alias("part"),
        F.trim(F.coalesce("venue", F.lit(""))).alias("venue"),
        F.coalesce(F.try_element_at(place, F.lit(1)), F.lit("")).alias("city"),
        F.coalesce(F.try_element_at(place, F.lit(2)), F.lit("")).alias("state"),
        told.alias("title"),
        "owned",
    )


def _resolved(spark: SparkSession, sf_dir: str, typed: DataFrame) -> DataFrame:
    """Of every distinct venue, city, state as typed (on either side): region (a code), venue_ref, meant_city, city_ref; '' if none."""
    states = canonical.mapped_states(spark, sf_dir, typed.filter("state <> ''").select("state")).withColumnRenamed("code", "region")
    typed = cut(typed.distinct().join(states, "state", "left").fillna("", ["region"]))
    venues = table(spark, sf_dir, "ref_venues").select(F.col("venue_id").alias("ref"), F.col("venue").alias("name"), F.col("city").alias("place"), F.col("state").alias("region"))
    places = table(spark, sf_dir, "places").select(F.col("gid").alias("ref"), "name", F.lit("").alias("place"), F.col("admin").alias("region"), F.col("pop").alias("weight"))
    by_venue = canonical.map_values(typed.filter("venue <> ''").select(F.col("venue").alias("value"), F.col("city").alias("place"), "region"), venues)
    by_city = canonical.map_values(typed.filter("city <> ''").select(F.col("city").alias("value"), F.lit("").alias("place"), "region"), places)
    by_venue = by_venue.select(F.col("value").alias("venue"), F.col("place").alias("city"), "region", F.col("ref").alias("venue_ref"))
    by_city = by_city.select(F.col("value").alias("city"), "region", F.col("ref").alias("city_ref"))
    got = typed.join(by_venue, ["venue", "city", "region"], "left").join(by_city, ["city", "region"], "left").fillna("", ["venue_ref", "city_ref"])
    # An entry's own place says more than what was typed beside it, or nothing was.
    own = table(spark, sf_dir, "ref_venues").select(F.col("venue_id").cast("string").alias("venue_ref"), F.col("city").alias("own_city"), F.lower("state").alias("own_region"), F.col("gid").cast("string").alias("gid"), F.count("*").over(W.partitionBy("venue")).alias("namesakes"))
    got = got.join(own, "venue_ref", "left")
    # Where neither city nor state was given, a name that several places have tells none of them.
    unclear = F.coalesce((F.col("namesakes") > 1) & (F.col("city") == "") & (F.col("region") == ""), F.lit(False))
    told = lambda c, otherwise: F.coalesce(F.when(~unclear, F.col(c)), otherwise)
    return cut(
        got.select(
            "venue",
            "city",
            "state",
            told("own_region", F.col("region")).alias("region"),
            F.when(unclear, "").otherwise(F.col("venue_ref")).alias("venue_ref"),
            told("own_city", F.col("city")).alias("meant_city"),
            told("gid", F.col("city_ref")).alias("city_ref"),
        )
    )


def link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """show_id, rel_id, confidence of every candidate."""
    s, r = cut(_show_side(spark, sf_dir)), cut(_release_side(spark, sf_dir))
    every = names.all_names(spark, sf_dir).unionByName(s.select("name")).filter("name is not null").distinct()
    acts = cut(names.link_names(every))
    classed = acts.select("key", F.col("class").alias("act"))
    typed = ["venue", "city", "state"]
    meant = _resolved(spark, sf_dir, s.select(typed).unionByName(r.select(typed)))
    placed = lambda side: side.join(meant, typed, "left").drop("city").withColumnRenamed("meant_city", "city")
    s = placed(s).withColumn("key", _keyed("name")).join(classed, "key", "left").withColumn("act", F.coalesce("act", "key"))
    r = placed(r).withColumn("key", _keyed("name")).join(classed, "key", "left").withColumn("act", F.coalesce("act", "key"))
    # A show of which only the code is known has the code for an act; releases are found under both.
    s = s.withColumn("act", F.coalesce("act", F.concat(F.lit("#"), "code"))).filter("act is not null")
    plain = ["key", "night", "venue", "city", "region", "venue_ref", "city_ref"]
    s = cut(s.select("show_id", "act", *plain).withColumn("s_id", F.xxhash64("act", *plain)))
    r = cut(r.select("rel_id", "act", "code", "part", "title", "owned", *plain).withColumn("r_id", F.xxhash64("act", "code", "part", "title", "owned", *plain)))
    sp = s.select("s_id", "act", *plain).distinct()
    rp = r.drop("rel_id").distinct()
    sp = sp.select("s_id", "act", F.col("key").alias("s_key"), F.col("night").alias("s_night"), _folded("venue").alias("s_venue"), _folded("city").alias("s_city"), F.col("region").alias("s_region"), F.col("venue_ref").alias("s_venue_ref"), F.col("city_ref").alias("s_city_ref"))
    rp = rp.select(
        "r_id", "act", "code", "owned", F.col("key").alias("r_key"), F.col("night").alias("r_night"), F.col("part").alias("r_part"), _folded("venue").alias("r_venue"), _folded("city").alias("r_city"),
        F.col("region").alias("r_region"), F.col("venue_ref").alias("r_venue_ref"), F.col("city_ref").alias("r_city_ref"), _folded("title").alias("r_title"),
    )
    sp, rp = cut(sp), cut(rp)
    # Blocks: the act's night, and the nights beside it, from which the model learns what no match looks like; for
    # incomplete dates the act's month, or its place.
    around = [F.concat_ws("|", F.lit("n"), "act", F.coalesce(F.date_format(F.date_add(F.try_to_date("s_night"), k), "yyyy-MM-dd"), "s_night")) for k in (-1, 0, 1)]
    sb = sp.select("*", F.explode(F.array(*around, F.concat_ws("|", F.lit("m"), "act", F.substring("s_night", 1, 7)), F.concat_ws("|", F.lit("v"), "act", F.nullif("s_venue_ref", F.lit(""))), F.concat_ws("|", F.lit("c"), "act", F.nullif("s_city", F.lit(""))))).alias("block"))
    known = F.col("r_night").isNotNull()
    rb = rp.select(
        "*",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(known & F.col("act").isNotNull(), F.concat_ws("|", F.lit("n"), "act", "r_night")),
                    F.when(known & F.col("code").isNotNull(), F.concat(F.lit("n|#"), F.col("code"), F.lit("|"), F.col("r_night"))),
                    F.when(~known & (F.length("r_part") == 7), F.concat_ws("|", F.lit("m"), "act", "r_part")),
                    F.when(~known & (F.col("r_venue_ref") != ""), F.concat_ws("|", F.lit("v"), "act", "r_venue_ref")),
                    F.when(~known & (F.col("r_city") != ""), F.concat_ws("|", F.lit("c"), "act", "r_city")),
                )
            )
        ).alias("block"),
    ).drop("act")
    sb, rb = cut(sb), cut(rb)
    # A block with many candidates is split among several tasks: its releases by their hash, with its shows in each.
    sizes = sb.groupBy("block").agg(F.count("*").alias("a")).join(rb.groupBy("block").agg(F.count("*").alias("b")), "block")
    big = sizes.select("block", F.ceil(F.col("a") * F.col("b") / BLOCK_PAIRS).alias("parts")).filter("parts > 1")
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    sb = sb.join(big, "block", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    rb = rb.join(big, "block", "left").withColumn("part", F.pmod(F.xxhash64("r_id"), parts)).drop("parts")
    pairs = sb.join(rb, ["block", "part"]).drop("block", "part", "act", "code").dropDuplicates(["s_id", "r_id"])
    said = votes()
    pattern = F.concat(*[F.when(said[f] > 0, "+").when(said[f] < 0, "-").otherwise("0") for f in FUNCTIONS])
    place = F.when(F.col("s_city_ref") != "", F.col("s_city_ref")).otherwise(F.col("s_city"))
    judged = cut(pairs.select("s_id", "r_id", place.alias("place"), F.col("s_night").alias("night"), F.col("r_night").isNull().alias("open"), pattern.alias("pattern")))
    patterns = judged.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3 ** len(FUNCTIONS)
    if not patterns:
        return spark.createDataFrame([], "show_id long, rel_id long, confidence double")
    cast = np.array([["-0+".index(c) - 1 for c in p["pattern"]] for p in patterns])
    counts = np.array([p["count"] for p in patterns], float)
    # Another night is another performance, whatever else agrees.
    post = LabelModel().fit(cast, counts, np.array([1, 1, 2, 1, 1, 0.5, 1, 0, 0]), cast[:, FUNCTIONS.index("night")] < 0)
    learned = spark.createDataFrame([(p["pattern"], float(c)) for p, c in zip(patterns, post)], "pattern string, posterior double")
    scored = cut(judged.join(F.broadcast(learned), "pattern"))
    # A release is of one performance: what speaks for several is shared out between their nights and places.
    # A place that a show leaves blank is none of its own.
    each = scored.filter("posterior >= 0.05").groupBy("r_id", "night", F.col("place").alias("where")).agg(F.max("posterior").alias("p"))
    nights = each.groupBy("r_id", "night").agg(F.max("p").alias("p"), F.sum(F.when(F.col("where") != "", F.col("p"))).alias("of_places"), F.max(F.when(F.col("where") != "", F.col("p"))).alias("most"))
    total = nights.groupBy("r_id").agg(F.sum("p").alias("of_nights"))
    shared = scored.join(nights.select("r_id", "night", "of_places"), ["r_id", "night"], "left").join(total, "r_id", "left")
    of = F.greatest(F.lit(1.0), F.when(F.col("open"), F.coalesce("of_nights", F.lit(1.0))).otherwise(F.lit(1.0)), F.coalesce("of_places", F.lit(1.0)))
    best = shared.select("s_id", "r_id", F.round(F.col("posterior") * F.when(F.col("posterior") >= 0.05, F.col("posterior") / F.greatest("posterior", of)).otherwise(1.0), 6).alias("confidence"))
    return best.join(s.select("show_id", "s_id").distinct(), "s_id").join(r.select("rel_id", "r_id").distinct(), "r_id").groupBy("show_id", "rel_id").agg(F.max("confidence").alias("confidence"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shows and releases of one performance."""
    return link(spark, sf_dir).filter(F.col("confidence") > ENOUGH).select("show_id", "rel_id")


def p6_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of some confidence, with it."""
    return link(spark, sf_dir).filter(F.col("confidence") >= REPORTED)


QUERIES = {q.__name__: q for q in (p6_found, p6_scored)}
