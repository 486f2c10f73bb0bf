"""Which file of a show is which song of its list: R-7 to R-10, J-19, as relations.

Files and songs are two relations, each in the order of play within a show. All that tells them apart is a column of
a file's row: whether its label names a filler, whether it stands where fillers stand, whether it is short for its
show. Ranks among those columns say which files are set aside; the others are numbered, and the number is the song's.
Where there are fewer files than songs, the files' labels, the chains of segues and the numbers in the files' names
are three further readings, of which the first that holds is taken. Everything is windows, joins and higher-order
functions over one show's short list; only titles that nearly agree go to Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tapeloom.functions import fuzzy, parse
from tapeloom.operators import predicates, sequences

# Fixed values of the rule: surplus files up to which a list is thought complete; how short a filler is, in seconds and
# as a share of the show's middle length; how far ahead of the last song a label is looked for; the disc of encores.
MOST_EXTRAS, SHORT_SECONDS, SHORT_SHARE, AHEAD, ENCORE = 4, 90, 0.4, 6, 99
# From how many letters a title may be part of another, and how alike two titles are that are the same.
PART_LETTERS, ALIKE = 6, 0.85
_ARROWS = r"\s*(?:-*>|→|»)\s*"


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def _lists(songs: DataFrame, key: str) -> DataFrame:
    """One row for each show: its songs in order, their letters, and the titles of its chains."""
    numbered = songs.withColumn("no", F.row_number().over(W.partitionBy(key).orderBy("pos"))).withColumn("segue", F.coalesce("segue", F.lit(False)))
    chained = sequences.chains(numbered, [key], ["no"], "segue")
    song = F.struct("no", "num", "title", F.coalesce("disc", F.lit(1)).alias("disc"), F.coalesce("set_no", F.lit(0)).alias("set_no"))
    chains = chained.groupBy(key, "chain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "title"))), lambda s: F.coalesce(s["title"], F.lit(""))), " > ").alias("t"))
    chains = chains.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("chain", "t"))), lambda s: s["t"]).alias("chains"))
    lists = chained.groupBy(key).agg(F.array_sort(F.collect_list(song)).alias("songs"), F.collect_set(_letters(F.col("title"))).alias("listed"))
    return lists.join(chains, key)


def _marked(files: DataFrame, key: str) -> DataFrame:
    """Adds what tells of a filler: ``own`` (its label says so), ``brief`` (short, where fillers stand), ``aside`` (set aside), and the counts."""
    line, show = W.partitionBy(key).orderBy("pos"), W.partitionBy(key)
    upto = line.rowsBetween(W.unboundedPreceding, W.currentRow)
    c = F.col
    f = files.withColumn("surplus", F.count("*").over(show) - F.size("songs"))
    f = f.withColumn("said", F.array_contains("listed", _letters(c("label")))).withColumn("own", predicates.filler(F.coalesce("label", F.lit(""))) & ~c("said"))
    beside = lambda test: F.coalesce(test(F.lag), F.lit(True)) | F.coalesce(test(F.lead), F.lit(True))
    # The first and the last file have no neighbour on one side, which counts as a border like a change of disc or a filler.
    border = beside(lambda next_to: (next_to("disc").over(line) != c("disc")) | next_to("own").over(line))
    short = c("seconds") < F.least(F.lit(float(SHORT_SECONDS)), SHORT_SHARE * F.median(F.when(c("seconds") > 0, c("seconds"))).over(show))
    f = f.withColumn("brief", F.coalesce(border & short, F.lit(False)) & ~c("own") & ~c("said"))
    f = f.withColumn("n_own", F.count_if("own").over(show)).withColumn("n_brief", F.count_if("brief").over(show))
    f = f.withColumn("own_no", F.count_if("own").over(upto)).withColumn("brief_no", F.row_number().over(show.orderBy(c("brief").desc(), "seconds", "pos")))
    named = c("own") & (c("own_no") <= c("surplus"))
    either = c("own") | (c("brief") & (c("brief_no") <= c("surplus") - c("n_own")))
    return f.withColumn("aside", F.when(c("surplus").between(1, MOST_EXTRAS) & (F.size("songs") > 0), F.when(c("n_own") >= c("surplus"), named).otherwise(either)).otherwise(False))


def _gap(f: DataFrame, key: str) -> Column:
    """R-9: what stands between songs is called by where it stands, unless it says what it is."""
    line = W.partitionBy(key).orderBy("pos")
    song = F.when(~F.col("aside"), F.get("songs", F.col("song_no") - 1))
    before, after = F.last(song, ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, -1)), F.first(song, ignorenulls=True).over(line.rowsBetween(1, W.unboundedFollowing))
    discs = lambda step: F.coalesce(step("disc").over(line) != F.col("disc"), F.lit(False))
    broken = (before["set_no"] != after["set_no"]) | (before["disc"] != after["disc"]) | discs(F.lag) | discs(F.lead)
    place = F.when(before.isNull(), "Tuning").when(after.isNull(), "Crowd").when((after["disc"] == ENCORE) & (before["disc"] != ENCORE), "Encore Break").when(broken, "Set Break").otherwise("Tuning")
    said = F.regexp_replace(F.coalesce("label", F.lit("")), r"^[ \-–—*>~]+|[ \-–—*>~]+$", "")
    return F.when(predicates.filler(F.coalesce("label", F.lit(""))), F.concat(F.upper(F.substring(said, 1, 1)), F.lower(F.expr("substring(__said, 2)")))).otherwise(place)


def same_title(a: Column, b: Column) -> Column:
    """Whether two titles' letters are one song's: equal, one inside the other, or alike. Only pairs whose edit distance allows it are compared in Python."""
    n = F.length(a) + F.length(b)
    inside = (F.least(F.length(a), F.length(b)) >= PART_LETTERS) & (F.contains(a, b) | F.contains(b, a))
    sure = (a == b) | inside
    # Letters outside the matching blocks are edits: there are at most n - ALIKE * n of them.
    ask = ~sure & (F.levenshtein(a, b) <= (1 - ALIKE) * n)
    return (a != "") & (b != "") & (sure | F.coalesce(fuzzy.ratio(F.when(ask, a), F.when(ask, b)) >= ALIKE, F.lit(False)))


def _by_labels(files: DataFrame, key: str) -> DataFrame:
    """R-8, J-19: key, pos, first and last song of each file of the shows in which every label is found in order, a few places ahead at most."""
    named = files.filter(~predicates.filler(F.coalesce("label", F.lit(""))))
    parts = F.filter(F.split(F.trim(F.coalesce("label", F.lit(""))), _ARROWS), lambda p: F.trim(p) != "")
    each = named.select(key, "pos", "songs", F.posexplode_outer(F.when(F.size(parts) > 0, parts)).alias("part", "said"))
    pairs = each.select(key, "pos", "part", _letters(F.col("said")).alias("a"), F.explode("songs").alias("song")).select(key, "pos", "part", "a", F.col("song.no").alias("no"), _letters(F.col("song.title")).alias("b"))
    hits = pairs.withColumn("hit", same_title(F.col("a"), F.col("b"))).groupBy(key, "pos", "part").agg(F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("no")))).alias("places"))
    shows = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "part", "places"))).alias("parts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(so_far: Column, part: Column) -> Column:
        ahead = F.get(F.filter(part["places"], lambda p: (p > so_far["at"]) & (p <= so_far["at"] + AHEAD)), F.lit(0))
        # Once a label is not found, no later one can be.
        lost = (so_far["at"] < 0) | ahead.isNull()
        return F.struct(F.when(lost, -1).otherwise(ahead).alias("at"), F.when(lost, so_far["found"]).otherwise(F.array_append(so_far["found"], ahead)).alias("found"))

    held = shows.withColumn("f", F.aggregate("parts", start, step)).filter("f.at > 0")
    placed = held.select(key, F.explode(F.arrays_zip(F.transform("parts", lambda p: p["pos"]).alias("pos"), F.col("f.found").alias("no"))).alias("e"))
    return placed.groupBy(key, F.col("e.pos").alias("pos")).agg(F.min("e.no").alias("from"), F.max("e.no").alias("to"))


def align(files: DataFrame, songs: DataFrame, typed: DataFrame | None = None, key: str = "show_id") -> DataFrame:
    """key, pos, name, kind (song, extra, unmatched), title, how and ok, one row for each file.

    Files: key, pos, name, seconds, label, disc. Songs: key, pos, num, title, disc, set_no, segue. ``typed``: key, name
    and title, which win (R-10). Positions give the order and are distinct within a show. Nulls: no disc is disc 1, no
    length is not short, no label says nothing. A show without songs is settled and all its files are unmatched; songs
    without files give no rows.
    """
    c = F.col
    f = files.select(key, "pos", "name", "seconds", "label", F.coalesce("disc", F.lit(1)).alias("disc")).join(_lists(songs, key), key, "left")
    f = f.withColumn("listed", F.coalesce("listed", F.array().cast("array<string>")))
    f = f.withColumn("songs", F.coalesce("songs", F.array().cast(dict(f.dtypes)["songs"])))
    f = _marked(f, key).withColumn("song_no", F.count_if(~c("aside")).over(W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)))
    f = f.withColumn("__said", F.regexp_replace(F.coalesce("label", F.lit("")), r"^[ \-–—*>~]+|[ \-–—*>~]+$", "")).withColumn("gap", _gap(f, key)).drop("listed", "own_no", "brief_no", "brief", "own", "said")
    few = (c("surplus") < 0) & (F.size("songs") > 0)
    f = f.join(_by_labels(f.filter(few), key), [key, "pos"], "left")
    show, line = W.partitionBy(key), W.partitionBy(key).orderBy("pos")
    f = f.withColumn("labelled", F.count("from").over(show) > 0).withColumn("file_no", F.row_number().over(line)).withColumn("n", F.count("*").over(show))
    number = parse.track_number(c("name"))
    by_number = F.get(F.filter("songs", lambda s: s["num"] == c("__number")), F.lit(0))["title"]
    f = f.withColumn("__number", number)
    how = (
        F.when(F.size("songs") == 0, "none").when(c("surplus") == 0, "count").when(c("surplus") > MOST_EXTRAS, "number")
        .when(c("surplus") > 0, F.when(c("n_own") >= c("surplus"), "named").when(c("n_own") + c("n_brief") >= c("surplus"), "short").otherwise("none"))
        .when(c("labelled"), "labels").when(F.size("chains") == c("n"), "segues").otherwise("number")
    )
    f = f.withColumn("how", how)
    exact = F.when(c("how") == "named", c("n_own") == c("surplus")).when(c("surplus").between(1, MOST_EXTRAS), c("n_own") + c("n_brief") == c("surplus")).otherwise(c("how").isin("count", "labels", "segues"))
    f = f.withColumn("ok", F.when(F.size("songs") == 0, True).otherwise(exact))
    in_order = F.get("songs", c("song_no") - 1)["title"]
    spanned = F.array_join(F.transform(F.slice("songs", F.coalesce("from", F.lit(1)), F.coalesce(c("to") - c("from") + 1, F.lit(0))), lambda s: F.coalesce(s["title"], F.lit(""))), " > ")
    ordered = c("how").isin("count", "named", "short") | ((c("how") == "none") & (F.size("songs") > 0))
    title = (
        F.when(c("aside"), c("gap")).when(ordered, in_order)
        .when(c("how") == "labels", F.when(c("from").isNotNull(), spanned).otherwise(c("__said")))
        .when(c("how") == "segues", F.get("chains", c("file_no") - 1)).when(c("how") == "number", by_number)
    )
    kind = F.when(c("aside") | ((c("how") == "labels") & c("from").isNull()), "extra").when(F.coalesce(title, F.lit("")) != "", "song").otherwise("unmatched")
    out = f.select(key, "pos", "name", kind.alias("kind"), F.coalesce(title, F.lit("")).alias("title"), "how", "ok")
    if typed is None:
        return out
    own = typed.select(key, "name", F.nullif(F.trim("title"), F.lit("")).alias("typed")).filter("typed is not null").groupBy(key, "name").agg(F.min("typed").alias("typed"))
    out = out.join(own, [key, "name"], "left").withColumn("kind", F.when(c("typed").isNotNull() & (c("kind") == "unmatched"), "song").otherwise(c("kind"))).withColumn("title", F.coalesce("typed", "title"))
    settled = ~c("ok") & (F.count("typed").over(show) > 0) & (F.count_if(c("title") == "").over(show) == 0)
    return out.withColumn("__t", settled).select(key, "pos", "name", "kind", "title", F.when(c("__t"), "typed").otherwise(c("how")).alias("how"), (c("ok") | c("__t")).alias("ok"))
