"""Problem 9: long exact spans shared between records.

Method: a compressed FM-index per shard, through which the shard's texts are streamed by backward search over its
wavelet tree; the matching statistics, cut at the threshold, give the intervals that stand elsewhere too (see
:mod:`tapeloom.llm.fmindex`). What a shard holds, and what comes of it:

1. Every text's windows of the threshold's length are fingerprinted (winnowing: the least hash of the
   window's k-grams). Equal windows choose equal k-grams, so two texts with a common run share a
   fingerprint. Texts are whole; no fingerprint is dropped. Copies of a text count as one here.
2. Fingerprints of one text only can be part of no shared run. Around the others, the text that a run could
   cover is cut out. Equal cuttings are one piece with several places, so a notice that many texts repeat is
   indexed as often as its surroundings differ. Only pieces go on: the index grows with what is repeated.
3. A fingerprint that stands in more texts than a shard can hold is hot (a notice in a third of all records, or
   a beginning that such records share). Its windows are counted by their hash, in partial aggregates; windows
   of one text leave, and what remains is cut where the count changes, so that it comes out as the same
   few pieces in all those texts. The hash only chooses the pieces; they are indexed and searched like the others.
4. A fingerprint's label is the least fingerprint of any piece that holds it, and a piece goes to all labels of
   its fingerprints: pieces with a common run meet in a label. One aggregate, no iteration. Labels are hashed
   to shards. A label whose pieces exceed a shard is split into blocks, and each pair of blocks is a shard.
5. A shard's search gives spans, not pairs: one class for all windows of one set of places, and a row for each
   place. A record's coverage is the union of its spans; nothing is ever listed pair by pair.

Spans with their places are the result, with the classes of equal texts; :func:`document_pairs` expands both to
pairs of documents where a list of them is wanted, once for every set of texts however many spans it shares.

Nulls and texts shorter than the threshold share nothing. Repeated rows of a key count once; a key has one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tapeloom.llm import fmindex
from tapeloom.tables import cut, table, whole_rows

LEAST = 200
#: Characters of a shard, about.
SHARD_CHARS = 1_000_000
#: Characters fingerprinted at once, about.
CHUNK = 1 << 18
#: Keys (16 bytes each, about) that are broadcast at most; more are shuffled.
MOST_KEYS = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(n + 1, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.cumprod(a)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _sliding(x: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def _hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams."""
    n = len(points)
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * up[:n], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * down[: n - k + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def winnow(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of the texts: (text, position of the k-gram, hash), in the order of the texts.

    Any window of ``least`` characters holds at least one, chosen by the window's content alone.
    """
    k = least // 2
    w = least - k + 1
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _hashes(points, k)
    least_of = _sliding(h, w, np.minimum)
    ends = np.cumsum(lengths)
    inside = np.zeros(n + 1, np.int32)  # windows of the full length inside one text
    fits = lengths >= least
    np.add.at(inside, (ends - lengths)[fits], 1)
    np.add.at(inside, (ends - least + 1)[fits], -1)
    least_of = np.where(np.cumsum(inside)[: len(least_of)] > 0, least_of, np.uint64(0))
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least_of, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(_sliding(padded, w, np.maximum) == h)
    text = np.searchsorted(ends, at, side="right")
    return text, at - (ends - lengths)[text], h[at].view(np.int64)


def _fingerprints(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys, texts = batch.iloc[:, 0].to_numpy(), batch.iloc[:, 1].tolist()
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            part = texts[at:end]
            text, pos, h = winnow(part, least)
            cuts = np.searchsorted(text, np.arange(1, len(part)))
            yield pd.DataFrame(
                {
                    "key": keys[at:end],
                    "class": [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in part],
                    "n_chars": [len(t) for t in part],
                    "fps": np.split(h, cuts),
                    "at": np.split(pos.astype(np.int32), cuts),
                }
            )
            at = end


def _piece(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


_PIECES = "piece binary, text string, marks array<long>, begin long"


def _regions(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Cuts the regions around shared fingerprints out of the texts: key, piece, text, marks (the fingerprints), begin."""
    k = least // 2
    for batch in batches:
        rows = []
        for key, text, hits in zip(batch["key"], batch["text"], batch["hits"]):
            found = sorted((int(x["at"]), int(x["fp"])) for x in hits if not x["hot"])
            begin, end, fps = None, 0, []
            for at, fp in [*found, (1 << 60, 0)]:
                if begin is not None and at + k - least > end:
                    rows.append((key, _piece(text[begin:end]), text[begin:end], sorted(set(fps)), begin))
                    begin, fps = None, []
                if begin is None:
                    begin = max(0, at + k - least)
                end = min(len(text), at + least)
                fps.append(fp)
        yield pd.DataFrame(rows, columns=["key", "piece", "text", "marks", "begin"])


def _window_hashes(text: str, least: int) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _hashes(points, least)


def _hot_windows(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """All windows that may have chosen a hot fingerprint: key, at, hash."""
    k = least // 2
    for batch in batches:
        keys, ats, hashes = [], [], []
        for key, text, hits in zip(batch["key"], batch["text"], batch["hits"]):
            near = [range(max(0, int(x["at"]) + k - least), min(int(x["at"]), len(text) - least) + 1) for x in hits if x["hot"]]
            at = np.unique(np.concatenate([np.fromiter(r, np.int64) for r in near])) if near else np.zeros(0, np.int64)
            if len(at):
                keys += [key] * len(at)
                ats.append(at)
                hashes.append(_window_hashes(text, least)[at])
        yield pd.DataFrame({"key": keys, "at": np.concatenate(ats) if ats else [], "h": np.concatenate(hashes).view(np.int64) if hashes else []})


def _hot_pieces(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Cuts the runs of windows that other texts hold too, where the number of places stays the same; their marks are the windows' hashes."""
    for batch in batches:
        rows = []
        for key, text, windows in zip(batch["key"], batch["text"], batch["windows"]):
            found = sorted((int(w["at"]), int(w["n"]), int(w["h"])) for w in windows)
            starts = [i for i, (at, n, _) in enumerate(found) if not i or found[i - 1][:2] != (at - 1, n)]
            for i, j in zip(starts, [*starts[1:], len(found)]):
                begin = found[i][0]
                part = text[begin : found[j - 1][0] + least]
                rows.append((key, _piece(part), part, sorted({h for _, _, h in found[i:j]}), begin))
        yield pd.DataFrame(rows, columns=["key", "piece", "text", "marks", "begin"])


def _search(shard: pd.DataFrame, least: int) -> pd.DataFrame:
    """The spans that the pieces of one shard share, with their places."""
    pieces = shard["piece"].to_numpy()
    text, at, of, length, hashes = fmindex.classes(shard["text"].tolist(), least)
    return pd.DataFrame({"span": [hashes[c] for c in of], "length": length[of], "piece": pieces[text], "at": at})


def by_keys(df: DataFrame, keys: DataFrame, how: str, most: int = MOST_KEYS) -> DataFrame:
    """Semi or anti join on ``key``: the keys are broadcast if they were counted and are few, else both sides are shuffled."""
    few = keys.limit(most + 1).count() <= most
    return df.join(F.broadcast(keys) if few else keys.hint("shuffle_merge"), "key", how)


def shared_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, shard_chars: int = SHARD_CHARS) -> tuple[DataFrame, DataFrame]:
    """The spans of at least ``least`` characters shared by different texts, and the classes of equal texts.

    Spans: span (a hash of its characters), length, key, begin; one row for every place in the representatives
    (least key) of different texts. Two spans of a text may overlap, and every window of ``least`` characters that
    another text holds is in one. Classes: key, class_key (the representative), n_chars; one row per document.
    """
    if least < 8:
        raise ValueError("least must be 8 or more")
    kind = dict(documents.dtypes)[key]
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marks = cut(rows.mapInPandas(lambda it: _fingerprints(it, least), f"key {kind}, class binary, n_chars long, fps array<long>, at array<int>"))
    reps = marks.groupBy("class").agg(F.min("key").alias("rep"))
    classes = cut(marks.select("key", "class", "n_chars").join(reps, "class").select("key", F.col("rep").alias("class_key"), "n_chars").distinct())
    first = by_keys(marks.select("key", "fps", "at"), classes.filter("key <> class_key").select("key"), "left_anti")
    each = first.select("key", F.explode(F.arrays_zip("fps", "at")).alias("m")).select("key", F.col("m.fps").alias("fp"), F.col("m.at").alias("at"))
    most = max(2, shard_chars // (2 * least))
    shared = each.groupBy("fp").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count("*").alias("n")).filter("a <> b").select("fp", (F.col("n") > most).alias("hot"))
    hits = cut(each.join(shared, "fp").groupBy("key").agg(F.collect_list(F.struct("at", "fp", "hot")).alias("hits"), F.bool_or("hot").alias("some_hot")))
    some = by_keys(rows, hits.select("key"), "left_semi").join(hits, "key")
    placed = some.mapInPandas(lambda it: _regions(it, least), f"key {kind}, {_PIECES}")
    if not hits.filter("some_hot").isEmpty():
        hot = cut(some.filter("some_hot"))
        windows = cut(hot.mapInPandas(lambda it: _hot_windows(it, least), f"key {kind}, at int, h long").dropDuplicates(["key", "at"]))
        counts = windows.groupBy("h").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count("*").alias("n")).filter("a <> b").select("h", "n")
        kept = windows.join(counts, "h").groupBy("key").agg(F.collect_list(F.struct("at", "n", "h")).alias("windows"))
        placed = placed.unionByName(hot.select("key", "text").join(kept, "key").mapInPandas(lambda it: _hot_pieces(it, least), f"key {kind}, {_PIECES}"))
    placed = cut(placed)
    members = placed.select("piece", "key", "begin").distinct()
    pieces = placed.select("piece", "text", "marks").dropDuplicates(["piece"])
    # Labels. A mark of one piece only needs no search: equal pieces are one already.
    sizes = pieces.select("piece", "marks", F.array_min("marks").alias("least_mark"), F.length("text").cast("long").alias("chars"))
    spots = sizes.select("piece", "least_mark", "chars", F.explode("marks").alias("mark"))
    label = spots.groupBy("mark").agg(F.min("least_mark").alias("label"), F.min("piece").alias("a"), F.max("piece").alias("b")).filter("a <> b").select("mark", "label")
    routes = cut(spots.join(label, "mark").select("piece", "label", "chars").distinct())
    total = routes.agg(F.sum("chars")).first()[0] or 0
    shards = max(1, -(-total // shard_chars))
    big = routes.groupBy("label").agg(F.sum("chars").alias("sum")).filter(F.col("sum") > shard_chars).select("label", F.ceil(F.col("sum") / shard_chars).alias("blocks"))
    sent = routes.join(big, "label", "left")
    one = sent.filter("blocks is null").select("piece", F.concat(F.lit("s"), F.pmod(F.xxhash64("label"), F.lit(shards))).alias("shard")).distinct()
    # A split label's piece in block i meets every block j in the shard of (i, j).
    mine = F.pmod(F.xxhash64("piece"), F.col("blocks"))
    cells = sent.filter("blocks is not null").withColumn("i", mine).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    split = cells.select("piece", F.concat_ws("-", F.lit("c"), "label", F.least("i", "j"), F.greatest("i", "j")).alias("shard"))
    loads = one.unionByName(split).join(pieces.select("piece", "text"), "piece")
    found = loads.groupBy("shard").applyInPandas(lambda pdf: _search(pdf, least), "span binary, length long, piece binary, at long").distinct()
    inner = found.join(members, "piece").select("span", "length", "key", (F.col("begin") + F.col("at")).alias("begin"))
    # What several texts have as one piece is a span as it stands.
    whole = members.join(pieces.select("piece", F.length("text").cast("long").alias("length")), "piece").select(F.col("piece").alias("span"), "length", "key", "begin")
    spans = cut(inner.unionByName(whole).distinct())
    several = spans.groupBy("span").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b").select("span")
    return spans.join(several, "span", "left_semi"), classes


def document_pairs(spans: DataFrame, classes: DataFrame, least: int = LEAST) -> DataFrame:
    """All pairs of documents that share a run: key_a < key_b. Copies are expanded.

    Spans with the same texts are expanded once: a set of texts is known by its size, least and greatest key and the sum of its keys' hashes.
    """
    texts = spans.select("span", "key").distinct()
    sets = texts.groupBy("span").agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64(F.lit(1), "key").cast("decimal(38,0)")).alias("t"))
    once = texts.join(sets.groupBy("n", "a", "b", "s", "t").agg(F.min("span").alias("span")).select("span"), "span", "left_semi")
    pairs = once.withColumnRenamed("key", "key_a").join(once.withColumnRenamed("key", "key_b"), "span").filter("key_a < key_b").select("key_a", "key_b").distinct()
    a = classes.select(F.col("key").alias("a"), F.col("class_key").alias("key_a"))
    b = classes.select(F.col("key").alias("b"), F.col("class_key").alias("key_b"))
    across = pairs.join(a, "key_a").join(b, "key_b").select("a", "b")
    many = classes.filter(F.col("n_chars") >= least)
    copies = many.select(F.col("key").alias("a"), "class_key").join(many.select(F.col("key").alias("b"), "class_key"), "class_key").filter("a < b").select("a", "b")
    return across.unionByName(copies).select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()


def shared_lengths(spans: DataFrame, classes: DataFrame, least: int = LEAST) -> DataFrame:
    """Of each document: key, class_key, n_chars, n_links (spans it shares with other texts), shared_chars and shared_part.

    A text with copies stands elsewhere as a whole, if it has the least length.
    """
    ends = spans.groupBy(F.col("key").alias("class_key"), "begin").agg(F.max(F.col("begin") + F.col("length")).alias("to"), F.count("*").alias("n"))
    seen = F.coalesce(F.max("to").over(W.partitionBy("class_key").orderBy("begin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    covered = ends.withColumn("seen", seen).groupBy("class_key").agg(F.sum(F.greatest(F.col("to") - F.greatest("begin", "seen"), F.lit(0))).alias("covered"), F.sum("n").alias("n_links"))
    copies = classes.groupBy("class_key").agg(F.count("*").alias("copies"))
    out = classes.join(copies, "class_key").join(covered, "class_key", "left")
    chars = F.when((F.col("copies") > 1) & (F.col("n_chars") >= least), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return out.select(
        "key", "class_key", "n_chars", F.coalesce("n_links", F.lit(0)).alias("n_links"), chars.alias("shared_chars"), F.coalesce(F.round(F.try_divide(chars, "n_chars"), 6), F.lit(0.0)).alias("shared_part")
    )


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return shared_spans(whole_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with a common run of 200 or more characters."""
    return document_pairs(*_spans(spark, sf_dir)).select(F.col("key_a").alias("doc_a"), F.col("key_b").alias("doc_b"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document stands elsewhere too; one row per document."""
    return shared_lengths(*_spans(spark, sf_dir)).withColumnRenamed("key", "doc_id")


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans that different texts share, a row for each of their places in the texts' representatives."""
    return _spans(spark, sf_dir)[0].withColumn("span", F.hex("span")).withColumnRenamed("key", "doc_id")


QUERIES = {q.__name__: q for q in (p9_found, p9_report, p9_spans)}
