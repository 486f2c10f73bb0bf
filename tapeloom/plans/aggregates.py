"""Aggregations (A-…): counts, votes, merges of repeated sightings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.functions import text
from tapeloom.operators import merging, shows
from tapeloom.plans.base import release_fields, show_fields, show_tracks
from tapeloom.plans.problems import P1_PARTS_SQL, P1_TRACKS_SQL
from tapeloom.plans.registry import SONG_KEY, Family
from tapeloom.tables import table

family = Family()
query = family.query


@query("A-1", sql="select status, count(*) as n from {RELEASES} group by status")
def release_status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Releases by status, repeated rows counted once."""
    return release_fields(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("A-2", sql="""select (select count(*) from (select distinct id from shows)) as shows, (select count(*) from artists) as artists,
 (select count(*) from venues) as venues, (select count(*) from song_titles) as songs""")
def global_counts(spark: SparkSession, d: str) -> DataFrame:
    """One row with the size of each learned table."""
    out = table(spark, d, "shows").agg(F.count_distinct("id").alias("shows"))
    for name, col in (("artists", "artists"), ("venues", "venues"), ("song_titles", "songs")):
        out = out.crossJoin(table(spark, d, name).agg(F.count("*").alias(col)))  # one row each
    return out


@query("A-3", sql="select max(rid) as version, count(*) as n from venues")
def highest_version(spark: SparkSession, d: str) -> DataFrame:
    """The greatest number, from the column statistics and a partial aggregate."""
    return table(spark, d, "venues").agg(F.max("rid").alias("version"), F.count("*").alias("n"))


@query("A-4", sql="""with v as (select show_id, f.field, left(regexp_replace(lower(f.value), '[^a-z0-9]', '', 'g'), 24) as k from (
  select show_id, unnest([{'field':'city','value':city},{'field':'venue','value':venue},{'field':'state','value':state}]) as f from (
   select show_id, venue, city, state from {SHOWS} union all
   select show_id, trim(regexp_extract(folder_name, '\\d\\d[-.]\\d\\d ([^,\\[]+),([^,\\[]+),([^,\\[]+)', 1)), trim(regexp_extract(folder_name, '\\d\\d[-.]\\d\\d ([^,\\[]+),([^,\\[]+),([^,\\[]+)', 2)), trim(regexp_extract(folder_name, '\\d\\d[-.]\\d\\d ([^,\\[]+),([^,\\[]+),([^,\\[]+)', 3)) from {SHOWS}))
  where f.value is not null and f.value <> ''),
 c as (select show_id, field, k, count(*) as n from v group by all) select show_id, field, max(n) as agreement from c group by all""")
def agreement(spark: SparkSession, d: str) -> DataFrame:
    """How many sources agree on a field, by the first 24 letters of its key (Q-10)."""
    s = show_fields(spark, d)
    p = r"\d\d[-.]\d\d ([^,\[]+),([^,\[]+),([^,\[]+)"
    said = [F.trim(F.regexp_extract("folder_name", p, k)) for k in (1, 2, 3)]
    rows = s.select("show_id", "venue", "city", "state").unionByName(s.select("show_id", said[0].alias("venue"), said[1].alias("city"), said[2].alias("state")))
    long = rows.unpivot("show_id", ["venue", "city", "state"], "field", "value")
    return merging.agreement(long, ["show_id"])


@query("A-6", "A-7", "A-24", sql="""with t as (select artist_norm, title from song_titles), c as (select artist_norm, title, count(*) as n from t group by all)
 select artist_norm, cast(sum(n) as bigint) as titles, count(*) as different, max(n) as top,
  (sum(n) > 3 and (count(*) = 1 or (max(n) >= 4 and max(n) >= 0.8 * sum(n)))) as mass_tagged,
  round(sum(case when length(regexp_replace(title, '[^0-9]', '', 'g')) >= 0.4 * greatest(length(title), 1) or length(title) < 4 then n else 0 end) / sum(n), 6) as junk_share
 from c group by artist_norm""")
def title_quality(spark: SparkSession, d: str) -> DataFrame:
    """Whether one title was written to all tracks, and the share of titles that are none."""
    t = table(spark, d, "song_titles").groupBy("artist_norm", "title").agg(F.count("*").alias("n"))
    junk = (text.digit_share(F.col("title")) >= 0.4) | (F.length("title") < 4)
    return t.groupBy("artist_norm").agg(F.sum("n").alias("titles"), F.count("*").alias("different"), F.max("n").alias("top"), F.sum(F.when(junk, F.col("n")).otherwise(0)).alias("junk")).select(
        "artist_norm",
        "titles",
        "different",
        "top",
        ((F.col("titles") > 3) & ((F.col("different") == 1) | ((F.col("top") >= 4) & (F.col("top") >= 0.8 * F.col("titles"))))).alias("mass_tagged"),
        F.round(F.col("junk") / F.col("titles"), 6).alias("junk_share"),
    )


@query("A-8", sql=f"""with c as (select distinct {SONG_KEY.format("title")} as k from song_titles), t as (select show_id, nullif({SONG_KEY.format("title")}, '') as k from ({P1_TRACKS_SQL}))
 select show_id, count(t.k) as checked, round(coalesce(avg(case when t.k is not null then case when c.k is not null then 1 else 0 end end), 1.0), 6) as recognised from t left join c on c.k = t.k group by show_id""")
def corpus_recognition(spark: SparkSession, d: str) -> DataFrame:
    """The share of a show's titles that the song corpus knows; 1 where there is nothing to check (Q-16)."""
    corpus = table(spark, d, "song_titles").select(text.song_norm(F.col("title")).alias("k")).filter("k <> ''").distinct()
    t = show_tracks(spark, d).select("show_id", text.song_norm(F.col("title")).alias("k")).withColumn("k", F.nullif("k", F.lit("")))
    known = t.join(corpus.withColumn("known", F.lit(1)), "k", "left")
    share = F.round(F.coalesce(F.avg(F.when(F.col("k").isNotNull(), F.coalesce("known", F.lit(0)))), F.lit(1.0)), 6)
    return known.groupBy("show_id").agg(F.count("k").alias("checked"), share.alias("recognised"))


_CITY_KEY = "regexp_replace(lower(city), '[^a-z0-9]', '', 'g')"


@query("A-9", "A-10", "A-22", sql=f"""with v as (select {_CITY_KEY} as city_key, state, count(*) as n from venues where city <> '' and state <> '' group by all),
 r as (select *, sum(n) over (partition by city_key) as total, row_number() over (partition by city_key order by n desc, state) as place from v)
 select city_key, state, n, cast(total as bigint) as total from r where place = 1 and n >= 2 and n >= 0.8 * total""")
def city_state_majority(spark: SparkSession, d: str) -> DataFrame:
    """Where the library puts a city: the state with at least two votes and four fifths of them."""
    v = table(spark, d, "venues").filter("city <> '' and state <> ''").select(text.norm_key(F.col("city")).alias("city_key"), "state")
    return merging.majority(v, ["city_key"], "state", least=2, share=0.8)


@query("A-11", sql="""with b as (select name, admin, max(pop) as pop from places group by all),
 r as (select *, row_number() over (partition by name order by pop desc, admin) as place, lead(pop) over (partition by name order by pop desc, admin) as next from b)
 select name, admin, pop, next as runner_up from r where place = 1 and (next is null or pop >= 3 * greatest(next, 1))""")
def dominant_place(spark: SparkSession, d: str) -> DataFrame:
    """The one place that a bare city name means: the only one, or three times its runner-up."""
    return merging.dominant(table(spark, d, "places"), ["name"], "admin", "pop", ratio=3.0).withColumnRenamed("next", "runner_up")


@query("A-12", sql="""with v as (select artist, regexp_extract(release_id, '^([a-z]+)', 1) as prefix, count(*) as n from {RELEASES} where artist is not null group by all),
 r as (select *, row_number() over (partition by artist order by n desc, prefix) as place from v where prefix <> '') select artist, prefix, n from r where place = 1""")
def modal_prefix(spark: SparkSession, d: str) -> DataFrame:
    """An artist's most common prefix of release ids; ties go to the first in order (Q-9: not mode())."""
    r = release_fields(spark, d).filter("artist is not null").select("artist", F.regexp_extract("release_id", "^([a-z]+)", 1).alias("prefix")).filter("prefix <> ''")
    n = r.groupBy("artist", "prefix").agg(F.count("*").alias("n"))
    return merging.top_by(n, ["artist"], [F.desc("n"), F.asc("prefix")])


@query("A-13", "M-3", sql="""with t as (select *, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') as k from song_titles)
 select artist_norm, k as song, cast(sum(seen) as bigint) as seen, max(confirmed) as confirmed,
 coalesce(arg_max(title, rid) filter (where confirmed = 1), arg_min(title, rid)) as title from t group by all""")
def song_corpus_merge(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by song: sightings add up; the title is the last confirmed spelling, else the first."""
    t = table(spark, d, "song_titles").withColumn("song", text.norm_key(F.col("title")))
    sure = F.when(F.col("confirmed") == 1, F.col("rid"))
    return t.groupBy("artist_norm", "song").agg(F.sum("seen").alias("seen"), F.max("confirmed").alias("confirmed"), F.coalesce(F.max_by("title", sure), F.min_by("title", "rid")).alias("title"))


@query("A-14", sql="""select regexp_replace(lower(venue), '[^a-z0-9]', '', 'g') as venue_key, arg_min(venue, rid) as venue, cast(sum(seen) as bigint) as seen,
 arg_max(city, rid) filter (where city <> '') as city, arg_max(state, rid) filter (where state <> '') as state from venues group by 1""")
def venue_merge(spark: SparkSession, d: str) -> DataFrame:
    """Venues by key: first spelling, last city and state that say something."""
    some = lambda c: F.max_by(c, F.when(F.col(c) != "", F.col("rid")))
    v = table(spark, d, "venues").withColumn("venue_key", text.norm_key(F.col("venue")))
    return v.groupBy("venue_key").agg(F.min_by("venue", "rid").alias("venue"), F.sum("seen").alias("seen"), some("city").alias("city"), some("state").alias("state"))


@query("A-15", "A-16", sql="""select regexp_replace(lower(artist), '[^a-z0-9]', '', 'g') as artist_key, arg_min(artist, id) as first_spelling, arg_max(artist, id) as last_spelling, count(*) as n
 from {RELEASES} where artist is not null group by 1""")
def first_and_last_spelling(spark: SparkSession, d: str) -> DataFrame:
    """By artist key, the spelling seen first (insert or ignore) and last (insert or replace)."""
    r = release_fields(spark, d).filter("artist is not null").withColumn("artist_key", text.norm_key(F.col("artist")))
    return r.groupBy("artist_key").agg(F.min_by("artist", "id").alias("first_spelling"), F.max_by("artist", "id").alias("last_spelling"), F.count("*").alias("n"))


@query("A-17", sql=f"select show_id, count(*) as tracks, count(*) filter (where trim(coalesce(title, '')) <> '') as titled, count(distinct disc) as discs, count(*) filter (where coalesce(segue, false)) as segues from ({P1_TRACKS_SQL}) group by show_id")
def show_stats(spark: SparkSession, d: str) -> DataFrame:
    """Tracks, titled tracks, discs and segues of every show."""
    t = show_tracks(spark, d)
    return t.groupBy("show_id").agg(F.count("*").alias("tracks"), F.count_if(F.coalesce(F.trim("title"), F.lit("")) != "").alias("titled"), F.count_distinct("disc").alias("discs"), F.count_if(F.coalesce("segue", F.lit(False))).alias("segues"))


@query("A-18", "A-19", sql="""select source, count(*) as n, median(n_chars) as median_chars, round(avg(n_chars), 4) as mean_chars, count(*) filter (where n_chars < 600) as short
 from documents where n_chars is not null and n_chars > 0 group by source""")
def median_and_mean(spark: SparkSession, d: str) -> DataFrame:
    """Median (mean of the middle two), mean and a conditional count; zero and null are left out."""
    return table(spark, d, "documents").filter("n_chars > 0").groupBy("source").agg(F.count("*").alias("n"), F.median("n_chars").alias("median_chars"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.count_if(F.col("n_chars") < 600).alias("short"))


@query("A-20", "O-8", sql="select artist, count(*) as n from {RELEASES} where artist is not null group by artist order by n desc, artist limit 5")
def top_creators(spark: SparkSession, d: str) -> DataFrame:
    """The five most frequent names."""
    return release_fields(spark, d).filter("artist is not null").groupBy("artist").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "artist").limit(5)


@query("A-21", sql="select indexer, count(*) as n, cast(sum(greatest(0, coalesce(downloads, 0) - 100)) as bigint) as beyond from {RELEASES} group by indexer")
def clamped_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sums that count nothing below a floor."""
    return release_fields(spark, d).groupBy("indexer").agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(0), F.coalesce("downloads", F.lit(0)) - 100)).alias("beyond"))


@query("A-23", "U-5", sql=f"with f as (select show_id, bracket, min(part_no) as n from ({P1_PARTS_SQL}) where bracket is not null group by all) select show_id, string_agg(bracket, ' & ' order by n) as bracket from f group by show_id")
def bracket_join(spark: SparkSession, d: str) -> DataFrame:
    """A show's parts' brackets, each once in the parts' order."""
    p = shows.part_rows(shows.documents(spark, d)).filter("bracket is not null")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("part_no", "bracket"))), lambda x: x["bracket"])
    return p.groupBy("show_id").agg(F.array_join(F.array_distinct(listed), " & ").alias("bracket"))


@query("A-25", "SRC-8", sql="""with s as (select doc_id, show_id, cast(0 as double) + 2.0 * (case when regexp_matches(text, '(19|20)[0-9][0-9]-[0-9][0-9]-[0-9][0-9]') then 1 else 0 end) + 2.0 * (case when regexp_matches(text, '(Hall|Theatre|Arena|Lounge|Tavern)') then 1 else 0 end)
  + 0.5 * least(10, len(string_split(text, chr(10))) - 1) as score from documents where show_id is not null),
 r as (select *, row_number() over (partition by show_id order by score desc, doc_id) as place from s) select show_id, doc_id, score from r where place = 1""")
def best_info_text(spark: SparkSession, d: str) -> DataFrame:
    """Of a show's texts the one that says most; the first of equals."""
    t = table(spark, d, "documents").filter("show_id is not null")
    score = 2.0 * F.col("text").rlike("(19|20)[0-9][0-9]-[0-9][0-9]-[0-9][0-9]").cast("int") + 2.0 * F.col("text").rlike("(Hall|Theatre|Arena|Lounge|Tavern)").cast("int") + 0.5 * F.least(F.lit(10), F.size(F.split("text", "\n", -1)) - 1)
    best = t.groupBy("show_id").agg(F.max(F.struct(score.alias("score"), (-F.col("doc_id")).alias("minus"))).alias("m"))
    return best.select("show_id", (-F.col("m.minus")).alias("doc_id"), "m.score")


QUERIES, ORACLE, COVERS = family.queries, family.oracle, family.covers
