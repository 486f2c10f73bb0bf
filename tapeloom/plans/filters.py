"""Filters and predicates (F-…)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.functions import parse
from tapeloom.operators import predicates
from tapeloom.plans.base import release_fields, show_fields
from tapeloom.plans.registry import FILLER_PARTS, Family
from tapeloom.tables import table

family = Family()
query = family.query


@query("F-2", "Q-7", sql="select distinct id from shows where status = 'filed' and (contains(lower(filed_path), '1998') or contains(lower(meta), '1998'))")
def substring_probe(spark: SparkSession, d: str) -> DataFrame:
    """Filed rows with a text in path or record, without regard to case, and without a cap."""
    return table(spark, d, "shows").filter("status = 'filed'").filter(F.contains(F.lower("filed_path"), F.lit("1998")) | F.contains(F.lower("meta"), F.lit("1998"))).select("id").distinct()


@query("F-4", "F-24", sql="select distinct id from shows where folder_name is not null and not regexp_matches(folder_name, '^[._]') and not regexp_matches(lower(folder_name), '^(sbd|aud|mtx|fm|live)[^a-z]')")
def visible_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that are not hidden and do not begin with a reserved word."""
    return table(spark, d, "shows").filter(predicates.visible(F.col("folder_name")) & ~predicates.reserved_prefix(F.col("folder_name"))).select("id").distinct()


_FILLERS = "[" + ", ".join("'" + f.replace("-", "") + "'" for f in predicates.FILLERS) + "]"
_PARTS = FILLER_PARTS.format("title")


@query("F-5", sql=f"select rid, len({_PARTS}) > 0 and len(list_filter({_PARTS}, lambda p: not list_contains({_FILLERS}, p))) = 0 as filler from song_titles")
def filler_titles(spark: SparkSession, d: str) -> DataFrame:
    """Whether a title is made of words for what is no song."""
    return table(spark, d, "song_titles").select("rid", predicates.filler(F.coalesce("title", F.lit(""))).alias("filler"))


_JUNK = "(regexp_matches(title, '(?i)^(set|disc|track|source|lineage)\\b') or ends_with(title, ':') or regexp_matches(title, '(?i)[.](flac|shn|mp3|wav)') or length(regexp_replace(title, '[^0-9]', '', 'g')) > 0.5 * greatest(length(title), 1))"


@query("F-7", sql=f"select rid, {_JUNK} or trim(title, ' ') = '' or regexp_matches(lower(trim(title, ' ')), '^(track|untitled|unknown|title|song)[ _-]?[0-9]*$') or regexp_matches(title, '^[0-9]{{1,2}}:[0-9]{{2}}') or regexp_matches(lower(title), '^d[0-9]+t[0-9]+') as junk from (select rid, coalesce(title, '') as title from song_titles)")
def junk_on_recheck(spark: SparkSession, d: str) -> DataFrame:
    """Titles that a re-check takes for none."""
    return table(spark, d, "song_titles").select("rid", predicates.junk_on_recheck(F.col("title")).alias("junk"))


@query("F-6", "X-24", sql=f"select rid, {_JUNK} as junk from song_titles where title is not null")
def junk_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles that are labels, file names or numbers."""
    return table(spark, d, "song_titles").filter("title is not null").select("rid", predicates.junk_title(F.col("title")).alias("junk"))


_WORDS = "list_filter(string_split_regex(trim({0}, ' '), '\\s+'), lambda w: w <> '')"
_TOLD = "len(list_filter(" + _WORDS + ", lambda w: regexp_matches(w, '^[a-z]{{3,}}[^A-Za-z]*$') and regexp_replace(w, '[^a-z]', '', 'g') not in " + str(predicates.SMALL) + "))"
ARTIST_OK = f"""(length(artist) between 2 and 60 and length(regexp_replace(artist, '[^A-Za-z]', '', 'g')) >= 2 and not regexp_matches(artist, '[<>{{}}@]') and not regexp_matches(artist, '^[;''"*#-]') and not regexp_matches(artist, '^[A-Za-z ]{{2,15}}:')
 and not regexp_matches(lower(artist), '{predicates.CREDIT}') and not ((ends_with(artist, '.') and len({_WORDS.format("artist")}) > 1 and not regexp_matches(artist, '\\b[A-Z]\\.$')) or contains(artist, '...') or regexp_matches(artist, '[!?]$') or regexp_matches(artist, '([a-z][''"]|[a-z]{{3,}})\\. [A-Z]') or {_TOLD.format("artist")} > 2)
 and not regexp_matches(artist, ', [A-Z]{{2}}$') and not regexp_matches(lower(artist), ', ({"|".join(predicates.STATES)})[.]?$') and not regexp_matches(artist, '{predicates.DATED}'))"""
VENUE_OK = f"(length(trim(venue)) between 2 and 90 and not regexp_matches(venue, '^[0-9 ./-]+$') and not regexp_matches(lower(venue), '^(sbd|aud|fm|mtx|unknown|tba|tbd)') and not (len({_WORDS.format('venue')}) > 5 and {_TOLD.format('venue')} > 2))"
CITY_OK = f"(length(trim(city)) between 2 and 40 and not regexp_matches(lower(city), '{predicates.NO_CITY}') and not regexp_matches(city, '[!?;:_/@#]') and length(regexp_replace(city, '[^0-9]', '', 'g')) <= 1 and len(string_split(trim(city), ' ')) <= 5 and regexp_matches(city, '[A-Za-z]{{2}}'))"


@query("F-8", "F-9", "F-10", sql=f"select show_id, {ARTIST_OK} as artist_ok, {VENUE_OK} as venue_ok, {CITY_OK} as city_ok from {{SHOWS}}")
def plausible_fields(spark: SparkSession, d: str) -> DataFrame:
    """Whether artist, venue and city look like what they should be."""
    s = show_fields(spark, d)
    return s.select("show_id", predicates.plausible_artist(F.col("artist")).alias("artist_ok"), predicates.plausible_venue(F.col("venue")).alias("venue_ok"), predicates.plausible_city(F.col("city")).alias("city_ok"))


@query("F-11", sql="select s.show_id from {SHOWS} s where upper(trim(s.state)) in (select code from ref_states) or lower(trim(s.state)) in (select lower(name) from countries union select lower(name) from ref_states)")
def valid_states(spark: SparkSession, d: str) -> DataFrame:
    """Shows whose state is a code, a state's name or a country's: a semi-join to the lists."""
    known = table(spark, d, "ref_states").select(F.lower("code").alias("k")).unionByName(table(spark, d, "ref_states").select(F.lower("name").alias("k"))).unionByName(table(spark, d, "countries").select(F.lower("name").alias("k"))).distinct()
    return show_fields(spark, d).withColumn("k", F.lower(F.trim("state"))).join(known, "k", "left_semi").select("show_id")


@query("F-13", "SRC-13", sql="""select id, case when length(release_id) between 8 and 200 and not regexp_matches(release_id, '[ ,()]') and regexp_matches(release_id, '[0-9]{4}-[0-9][0-9]-[0-9][0-9]') then 'item' when contains(release_id, '.') then 'maybe' else 'text' end as route from {RELEASES}""")
def input_router(spark: SparkSession, d: str) -> DataFrame:
    """What a typed text is: an item's id, perhaps one, or words to search for."""
    item = predicates.archive_id(F.col("release_id"))
    return release_fields(spark, d).select("id", F.when(item, "item").when(F.contains("release_id", F.lit(".")), "maybe").otherwise("text").alias("route"))


@query("F-15", sql="""with s as (select *, ltrim(regexp_extract(folder_name, '\\[[^\\]]*?([0-9]{6})\\]', 1), '0') as told, ltrim(coalesce(shnid, ''), '0') as own from {SHOWS})
 select show_id, contains(folder_name, date) and trim(coalesce(city, '')) <> '' and (told = '' or own = '' or told = own) as trusted from s where date is not null""")
def curated_agrees(spark: SparkSession, d: str) -> DataFrame:
    """Whether a record's date and number agree with its folder's and its place says something."""
    bare = lambda c: F.ltrim(F.coalesce(c, F.lit("")), F.lit("0"))
    told, own = bare(parse.shnid(F.col("folder_name"))), bare(F.col("shnid"))
    same = (told == "") | (own == "") | (told == own)
    return show_fields(spark, d).filter("date is not null").select("show_id", (F.contains("folder_name", "date") & (F.trim(F.coalesce("city", F.lit(""))) != "") & same).alias("trusted"))


_FLAGS = f"""list_filter([case when state is null or trim(state) = '' then 'no state' end, case when regexp_matches(city, ' - |, ') then 'dash city' end, case when not regexp_matches(folder_name, '[\\[]') then 'no bracket' end,
 case when regexp_matches(lower(venue), '(unknown|private|house|radio)') then 'suspect venue' end, case when date is null or date = '' then 'no date' end, case when lower(venue) = lower(city) then 'repeated part' end, case when not {ARTIST_OK} then 'odd artist' end], lambda x: x is not null)"""


@query("F-16", "R-28", sql=f"select show_id, array_to_string({_FLAGS}, ';') as flags from {{SHOWS}}")
def suspect_flags(spark: SparkSession, d: str) -> DataFrame:
    """All reasons to look at a record again, as one list."""
    s = show_fields(spark, d)
    return s.select("show_id", F.array_join(predicates.suspect_flags(), ";").alias("flags"))


@query("F-17", sql="""with c as (select artist_norm, title_norm, count(*) as n from song_titles group by all), a as (select artist_norm, sum(n) as total, max(n) as top, sum(case when length(title_norm) <= 2 then n else 0 end) as odd from c group by 1)
 select artist_norm, array_to_string(list_filter([case when top >= 4 and top >= 0.8 * total then 'one title' end, case when odd >= 2 then 'junk titles' end], lambda x: x is not null), ';') as flags from a""")
def title_problem_flags(spark: SparkSession, d: str) -> DataFrame:
    """Problems of a group's titles, as flags."""
    c = table(spark, d, "song_titles").groupBy("artist_norm", "title_norm").agg(F.count("*").alias("n"))
    a = c.groupBy("artist_norm").agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.sum(F.when(F.length("title_norm") <= 2, F.col("n")).otherwise(0)).alias("odd"))
    flags = F.array_compact(F.array(F.when((F.col("top") >= 4) & (F.col("top") >= 0.8 * F.col("total")), "one title"), F.when(F.col("odd") >= 2, "junk titles")))
    return a.select("artist_norm", F.array_join(flags, ";").alias("flags"))


@query("F-18", "F-19", sql="""with p as (select distinct id, current_path, regexp_extract(current_path, '[.]([A-Za-z0-9]{2,6})$', 1) as ext from shows where current_path is not null) select id, lower(ext) as ext, lower(ext) in ('exe', 'bat', 'scr', 'com', 'lnk', 'vbs') as unsafe from p""")
def file_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """Suffixes of names, and whether they are programs'."""
    p = table(spark, d, "shows").filter("current_path is not null").select("id", F.lower(F.regexp_extract("current_path", "[.]([A-Za-z0-9]{2,6})$", 1)).alias("ext")).distinct()
    return p.select("id", "ext", predicates.unsafe_suffix(F.col("ext")).alias("unsafe"))


@query("F-20", sql="select id from {RELEASES} where contains(lower(concat_ws(' ', artist, title, venue, location)), 'hall') and contains(lower(concat_ws(' ', artist, title, venue, location)), 'the')")
def token_search(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose joined text holds every word of a search."""
    hay = F.lower(F.concat_ws(" ", "artist", "title", "venue", "location"))
    return release_fields(spark, d).filter(predicates.holds_all(hay, "Hall the")).select("id")


@query("F-21", "F-25", sql="select distinct id from shows where error is null and contains(lower(coalesce(notes, '')), 'reel')")
def notes_contain(spark: SparkSession, d: str) -> DataFrame:
    """Live rows whose notes hold a word."""
    return table(spark, d, "shows").filter(F.col("error").isNull() & F.contains(F.lower(F.coalesce("notes", F.lit(""))), F.lit("reel"))).select("id").distinct()


@query("F-3", "T-8", sql="select distinct id from shows where status = 'pending' and created_at <= (select max(created_at) from shows) - interval 5 minute")
def settled_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a status that are older than a while, against the newest row."""
    s = table(spark, d, "shows").select("id", "status", "created_at")
    newest = s.agg(F.max("created_at").alias("newest"))
    return s.filter("status = 'pending'").crossJoin(F.broadcast(newest)).filter(F.expr("created_at <= newest - interval 5 minutes")).select("id").distinct()  # one row


@query("F-23", sql="""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents) select doc_id, count(*) as lines from l where regexp_matches(line, '(19|20)[0-9][0-9]') and not regexp_matches(lower(line), '(transfer|upload|checksum|overspielt|copied)')
  and cast(regexp_extract(line, '((19|20)[0-9][0-9])', 1) as int) <= (select max(year(written_at)) from documents) group by doc_id""")
def show_date_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a year, no later than the newest text's, that do not speak of transfers."""
    newest = table(spark, d, "documents").agg(F.max(F.year("written_at")).alias("newest"))
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.filter(F.col("line").rlike("(19|20)[0-9][0-9]") & ~F.lower("line").rlike("(transfer|upload|checksum|overspielt|copied)")).crossJoin(F.broadcast(newest)).filter(F.regexp_extract("line", "((19|20)[0-9][0-9])", 1).cast("int") <= F.col("newest")).groupBy("doc_id").agg(F.count("*").alias("lines"))


QUERIES, ORACLE, COVERS = family.queries, family.oracle, family.covers
