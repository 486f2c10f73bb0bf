"""Composites over what several sources say of a show: merging by trust, a score, halves combined, values that make no sense dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.functions import parse, text
from tapeloom.operators import matching, merging, predicates, shows
from tapeloom.plans.base import release_fields, show_fields, show_tracks
from tapeloom.plans.filters import CITY_OK, VENUE_OK
from tapeloom.plans.problems import P1_TRACKS_SQL
from tapeloom.plans.registry import Family
from tapeloom.tables import table

family = Family()
query = family.query

# Whom to trust first, and the order for dates.
TRUST = ["sidecar", "curated_tags", "info_file", "setlistfm", "archive_org", "tags", "folder_name", "filenames"]
DATE_TRUST = ["sidecar", "curated_tags", "setlistfm", "folder_name", "info_file", "archive_org", "filenames", "tags"]
FIELDS = ("artist", "venue", "city", "state", "date", "source_type")
# What each field is worth, and what agreement and knowledge from outside add.
WORTH = {"artist": 20, "date": 20, "venue": 15, "city": 10, "state": 10, "source_type": 5}
UNSUPPORTED_ARTIST, AGREEING, TRACKS, CURATED, OFFICIAL, OUTSIDE, KNOWN, MOST = 12, {"date": 5, "artist": 3, "venue": 5}, 5, 10, 10, 5, 5, 100
_N = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_FOLDER = r"[0-9][0-9][-.][0-9][0-9] ([^,\[]+),([^,\[]+),([^,\[]+)"
_DAY = "((19|20)[0-9][0-9]-[0-9][0-9]-[0-9][0-9])"


def info_files(spark: SparkSession, d: str) -> DataFrame:
    """The head of every show's first information text: show_id, doc_id and the fields."""
    t = table(spark, d, "documents").filter("kind = 'info' and show_id is not null").groupBy("show_id").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("t"))
    return t.select("show_id", "t.doc_id", parse.info_header(F.col("t.text")).alias("h")).select("show_id", "doc_id", "h.*").withColumn("day", parse.extract_date(F.col("date")))


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """What the sources say of a show, as a long table: show_id, source, field, value.

    The record itself (sidecar), its first information text, the first release of the act's night (archive) and the
    folder's name; the songs' and tags' own fields are not in the tables.
    """
    s = show_fields(spark, d)
    own = s.select("show_id", F.lit("sidecar").alias("source"), *FIELDS)
    info = info_files(spark, d).select("show_id", F.lit("info_file").alias("source"), "artist", "venue", "city", "state", F.col("day").alias("date"), F.lit(None).cast("string").alias("source_type"))
    r = release_fields(spark, d).filter("length(date) = 10").withColumn("k", text.norm_key(F.col("artist"))).filter("k <> ''")
    r = r.groupBy("k", "date").agg(F.min_by(F.struct("artist", "venue", "location", "source_type"), "id").alias("r"))
    place = F.split("r.location", ",")
    met = s.select("show_id", text.norm_key(F.col("artist")).alias("k"), "date").join(r, ["k", "date"])
    archive = met.select("show_id", F.lit("archive_org").alias("source"), "r.artist", "r.venue", F.trim(F.get(place, F.lit(0))).alias("city"), F.trim(F.get(place, F.lit(1))).alias("state"), "date", "r.source_type")
    told = [F.trim(F.regexp_extract("folder_name", _FOLDER, k)) for k in (1, 2, 3)]
    folder = s.select("show_id", F.lit("folder_name").alias("source"), F.lit(None).cast("string").alias("artist"), told[0].alias("venue"), told[1].alias("city"), told[2].alias("state"), F.regexp_extract("folder_name", _DAY, 1).alias("date"), F.lit(None).cast("string").alias("source_type"))
    every = own.unionByName(info).unionByName(archive).unionByName(folder)
    return every.unpivot(["show_id", "source"], list(FIELDS), "field", "value")


_LINES = "list_transform(string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)), lambda x: trim(x, ' '))"
_LABEL = "'(?i)^(artist|band|venue|date|city|location|source|lineage|src)\\s*[:=]\\s*(.*)$'"


def _told(*labels: str) -> str:
    return f"list_filter(list_transform(b, lambda x: case when lower(regexp_extract(x, {_LABEL}, 1)) in ({', '.join(repr(x) for x in labels)}) then trim(regexp_extract(x, {_LABEL}, 2), ' ') end), lambda x: x <> '')[1]"


_SEVERAL = "string_split_regex(regexp_replace(x, '(?i)^(?:set|encore)[^:]{0,12}:\\s*', ''), '\\s*[,>]\\s*')"
_ONE = "regexp_replace(regexp_replace(regexp_replace(x, '(?i)^(?:d\\d+t)?\\d{1,3}[.)]?\\s+', ''), '\\s+\\d{1,2}:\\d{2}$', ''), '\\s*>$', '')"
_CENTURY = "case when {0} > '40' then '19' else '20' end || {0}"
_A, _B, _C = (f"regexp_extract(date, '^(\\d\\d)([-.])(\\d\\d)([-.])(\\d\\d)$', {k})" for k in (1, 3, 5))
_SHORT = f"case when regexp_matches(date, '^\\d\\d-\\d\\d-\\d\\d$|^\\d\\d[.]\\d\\d[.]\\d\\d$') then coalesce(try_cast({_CENTURY.format(_A)} || '-' || {_B} || '-' || {_C} as date), try_cast({_CENTURY.format(_C)} || '-' || {_A} || '-' || {_B} as date)) end"
_LONG = "case when regexp_matches(date, '^\\d{1,2}([-/._ ])\\d{1,2}([-/._ ])(19|20)\\d\\d$') then try_cast(regexp_extract(date, '(\\d{4})$', 1) || '-' || lpad(regexp_extract(date, '^(\\d{1,2})', 1), 2, '0') || '-' || lpad(regexp_extract(date, '^\\d{1,2}.(\\d{1,2})', 1), 2, '0') as date) end"
INFO_SQL = f"""(with t as (select show_id, min(doc_id) as doc_id, arg_min(text, doc_id) as text from documents where kind = 'info' and show_id is not null group by show_id),
 l as (select show_id, doc_id, {_LINES} as l from t), k as (select *, case when list_position(l, '') > 0 then l[1:list_position(l, '') - 1] else l end as b from l),
 p as (select *, list_filter(b, lambda x: not regexp_matches(x, {_LABEL})) as plain, {_told("artist", "band")} as t_artist, {_told("venue")} as t_venue, {_told("date")} as t_date, {_told("city", "location")} as t_city, {_told("source", "lineage", "src")} as source from k),
 q as (select *, string_split(plain[1], ' / ') as three, coalesce(len(string_split(plain[1], ' / ')) = 3, false) as joined from p),
 r as (select *, case when joined then three[3] when t_artist is null and regexp_matches(plain[4], '^[^,:]+, [A-Z]{{2}}$') then plain[4] end as place from q),
 s as (select show_id, doc_id, coalesce(t_artist, case when joined then three[1] else plain[1] end) as artist, coalesce(t_date, case when joined then three[2] when t_artist is null then plain[2] end) as date,
  coalesce(t_venue, case when not joined and t_artist is null then plain[3] end) as venue, coalesce(t_city, trim(string_split(place, ',')[1], ' ')) as city, nullif(regexp_extract(place, ', ([A-Z]{{2}})$', 1), '') as state, source,
  list_filter(flatten(list_transform(plain[case when t_artist is not null then 1 when joined then 2 when place is not null then 5 else 4 end:], lambda x: case when regexp_matches(x, '(?i)^(?:set|encore)[^:]{{0,12}}:') then {_SEVERAL} else [{_ONE}] end)), lambda x: x <> '') as songs from r)
 select *, strftime(coalesce(case when regexp_matches(date, '^(19|20)\\d\\d-\\d\\d-\\d\\d$') then try_cast(date as date) end, {_LONG}, {_SHORT}), '%Y-%m-%d') as day from s)"""


@query("X-34", "W-7", "X-25", sql=f"select show_id, doc_id, artist, date, day, venue, city, state, source, array_to_string(songs, '|') as songs from {INFO_SQL}")
def info_heads(spark: SparkSession, d: str) -> DataFrame:
    """The heads of information texts: who, when, where, by which source, and the songs."""
    return info_files(spark, d).select("show_id", "doc_id", "artist", "date", "day", "venue", "city", "state", "source", F.array_join("songs", "|").alias("songs"))


def _fields_sql(**values: str) -> str:
    return "unnest([" + ", ".join(f"{{'field': '{f}', 'value': {v}}}" for f, v in values.items()) + "]) as f"


EVIDENCE_SQL = f"""s as (select * from {{SHOWS}}), a as (select {_N.format('artist')} as k, date, arg_min({{'artist': artist, 'venue': venue, 'location': location, 'source_type': source_type}}, id) as r from {{RELEASES}} where length(date) = 10 and {_N.format('artist')} <> '' group by all),
 e as (select show_id, 'sidecar' as source, {_fields_sql(artist='artist', venue='venue', city='city', state='state', date='date', source_type='source_type')} from s
  union all select show_id, 'info_file', {_fields_sql(artist='artist', venue='venue', city='city', state='state', date='day')} from {INFO_SQL}
  union all select show_id, 'archive_org', {_fields_sql(artist='a.r.artist', venue='a.r.venue', city="trim(string_split(a.r.location, ',')[1], ' ')", state="trim(string_split(a.r.location, ',')[2], ' ')", date='a.date', source_type='a.r.source_type')} from s join a on a.k = {_N.format('s.artist')} and a.date = s.date
  union all select show_id, 'folder_name', {_fields_sql(venue=f"trim(regexp_extract(folder_name, '{_FOLDER}', 1), ' ')", city=f"trim(regexp_extract(folder_name, '{_FOLDER}', 2), ' ')", state=f"trim(regexp_extract(folder_name, '{_FOLDER}', 3), ' ')", date=f"regexp_extract(folder_name, '{_DAY}', 1)")} from s),
 v as (select show_id, source, f.field as field, f.value as value, list_position(case when f.field = 'date' then {DATE_TRUST} else {TRUST} end, source) as place from e where f.value is not null and trim(f.value, ' ') <> ''),
 w as (select show_id, field, left({_N.format('value')}, 24) as k, count(*) as n from v group by all), g as (select show_id, field, max(n) as agreement from w group by all),
 m as (select v.show_id, v.field, arg_min(v.value, v.place) as value, arg_min(v.source, v.place) as source, min(g.agreement) as agreement from v join g on g.show_id = v.show_id and g.field = v.field group by v.show_id, v.field)"""


@query("R-1", "A-4", "Q-2", "Q-10", sql=f"with {EVIDENCE_SQL} select * from m")
def merge_trust_order(spark: SparkSession, d: str) -> DataFrame:
    """Every field of a show from the most trusted source that has it, with provenance and agreement."""
    return merging.merge_by_trust(evidence(spark, d), ["show_id"], TRUST, {"date": DATE_TRUST})


_SCORE = " + ".join(
    [f"coalesce(max(case when field = '{f}' then {w if f != 'artist' else f'case when agreement >= 2 then {w} else {UNSUPPORTED_ARTIST} end'} end), 0)" for f, w in WORTH.items()]
    + [f"coalesce(max(case when field = '{f}' and agreement >= 2 then {w} end), 0)" for f, w in AGREEING.items()]
)


@query("R-3", "A-5", sql=f"""with {EVIDENCE_SQL}, p as (select show_id, {_SCORE} as score, max(case when field = 'artist' then {_N.format('value')} end) as k from m group by show_id),
 x as (select distinct id as show_id, case when json_valid(provenance) then provenance->>'$.venue' end = 'curated_tags' as curated, coalesce(trim(meta->>'$.official', ' '), '') <> '' as official from shows where json_valid(meta)),
 t as (select distinct show_id from ({P1_TRACKS_SQL})), o as (select distinct show_id from e where source = 'archive_org')
 select p.show_id, cast(least({MOST}, p.score + case when t.show_id is not null then {TRACKS} else 0 end + case when coalesce(x.curated, false) then {CURATED} else 0 end + case when x.official then {OFFICIAL} else 0 end
  + case when o.show_id is not null then {OUTSIDE} else 0 end + case when n.norm is not null then {KNOWN} else 0 end) as bigint) as score
 from p join x on x.show_id = p.show_id left join t on t.show_id = p.show_id left join o on o.show_id = p.show_id left join artists n on n.norm = p.k""")
def weighted_score(spark: SparkSession, d: str) -> DataFrame:
    """How sure a show's fields are: what is there, what agrees, and what is known from outside, capped."""
    said = evidence(spark, d)
    m = merging.merge_by_trust(said, ["show_id"], TRUST, {"date": DATE_TRUST})
    agrees = F.col("agreement") >= 2
    worth = lambda f, w: F.coalesce(F.max(F.when(F.col("field") == f, w)), F.lit(0))
    parts = [worth(f, F.when(agrees, w).otherwise(UNSUPPORTED_ARTIST) if f == "artist" else F.lit(w)) for f, w in WORTH.items()]
    parts += [worth(f, F.when(agrees, w)) for f, w in AGREEING.items()]
    p = m.groupBy("show_id").agg(sum(parts[1:], parts[0]).alias("score"), F.max(F.when(F.col("field") == "artist", text.norm_key(F.col("value")))).alias("k"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    raw = table(spark, d, "shows").select(F.col("id").alias("show_id"), (F.get_json_object("provenance", "$.venue") == "curated_tags").alias("curated")).dropDuplicates(["show_id"])
    meta = show_fields(spark, d).select("show_id", (F.trim(F.coalesce("official", F.lit(""))) != "").alias("official"))
    tracks = show_tracks(spark, d).select("show_id", F.lit(True).alias("tracks")).distinct()
    outside = said.filter("source = 'archive_org'").select("show_id", F.lit(True).alias("outside")).distinct()
    known = table(spark, d, "artists").select(F.col("norm").alias("k"), F.lit(True).alias("known"))
    x = p.join(meta, "show_id").join(raw, "show_id", "left").join(tracks, "show_id", "left").join(outside, "show_id", "left").join(known, "k", "left")
    total = F.col("score") + TRACKS * flag("tracks") + CURATED * flag("curated") + OFFICIAL * flag("official") + OUTSIDE * flag("outside") + KNOWN * flag("known")
    return x.select("show_id", F.least(F.lit(MOST), total).cast("long").alias("score"))


_HALVES = ("venue", "city", "state", "recorder")


@query("R-26", "J-9", sql=f"""with h as (select show_id, {_N.format('artist')} as k, date, source_type, coalesce(confidence, 0) as sure, official, {", ".join(f"nullif(trim({f}, ' '), '') as {f}" for f in _HALVES)} from (select s.*, x.official from {{SHOWS}} s join (select distinct id, meta->>'$.official' as official from shows where json_valid(meta)) x on x.id = s.show_id)),
 n as (select k, date, count(*) filter (where source_type = 'AUD') as a, count(*) filter (where source_type = 'SBD') as b, max(show_id) filter (where source_type = 'AUD') as first, max(show_id) filter (where source_type = 'SBD') as second from h where k <> '' and source_type in ('AUD', 'SBD') group by k, date)
 select n.first, n.second, {", ".join(f"case when x.sure >= y.sure then coalesce(x.{f}, y.{f}) else coalesce(y.{f}, x.{f}) end as {f}" for f in _HALVES)}, cast(least(x.sure, y.sure) as bigint) as sure,
 coalesce(trim(x.official, ' '), '') <> '' and coalesce(trim(y.official, ' '), '') <> '' as official, 'first: ' || n.first || ', second: ' || n.second as provenance from n join h x on x.show_id = n.first join h y on y.show_id = n.second where n.a = 1 and n.b = 1""")
def combined_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Two recordings of a night as one record: the surer half's fields, the other's where it has none, and the lesser confidence; official only if both are."""
    s = show_fields(spark, d).withColumn("artist_key", text.norm_key(F.col("artist")))
    pairs = matching.pair_one_of_each(s.filter("source_type in ('AUD', 'SBD') and artist_key <> ''"), ["artist_key", "date"], "source_type", "AUD", "SBD", "show_id").select("first", "second")
    half = lambda p: F.struct(F.coalesce("confidence", F.lit(0)).alias("sure"), (F.trim(F.coalesce("official", F.lit(""))) != "").alias("official"), *[text.blank_to_null(F.col(f)).alias(f) for f in _HALVES]).alias(p)
    x = pairs.join(s.select(F.col("show_id").alias("first"), half("x")), "first").join(s.select(F.col("show_id").alias("second"), half("y")), "second")
    surer = F.col("x.sure") >= F.col("y.sure")
    fields = [F.when(surer, F.coalesce(f"x.{f}", f"y.{f}")).otherwise(F.coalesce(f"y.{f}", f"x.{f}")).alias(f) for f in _HALVES]
    return x.select("first", "second", *fields, F.least("x.sure", "y.sure").cast("long").alias("sure"), (F.col("x.official") & F.col("y.official")).alias("official"), F.concat(F.lit("first: "), "first", F.lit(", second: "), "second").alias("provenance"))


@query("R-15", "F-9", "F-10", "F-11", sql=f"""with c as (select code as k, code from ref_states union select lower(name), min(code) from ref_states group by 1), u as (select k, min(code) as code from c group by k)
 select s.show_id, case when {VENUE_OK} then venue end as venue, case when {CITY_OK} then city end as city, coalesce(a.code, b.code) as state, a.code is null and b.code is not null as retried
 from {{SHOWS}} s left join u a on a.k = case when length(trim(state, ' ')) = 2 then upper(trim(state, ' ')) else lower(trim(state, ' ')) end left join u b on b.k = nullif(regexp_extract(city, ',\\s*([A-Z]{{2}})$', 1), '')""".replace("{{2}}", "{2}"))
def sane_places(spark: SparkSession, d: str) -> DataFrame:
    """Venue, city and state blanked where they can be none; a state that is none is looked for behind the city."""
    r = table(spark, d, "ref_states").select("code", "name")
    codes = r.select(F.col("code").alias("k"), "code").unionByName(r.select(F.lower("name").alias("k"), "code")).groupBy("k").agg(F.min("code").alias("code"))
    typed = F.trim("state")
    s = show_fields(spark, d).select("show_id", "venue", "city", F.when(F.length(typed) == 2, F.upper(typed)).otherwise(F.lower(typed)).alias("k"), F.nullif(F.regexp_extract("city", r",\s*([A-Z]{2})$", 1), F.lit("")).alias("k2"))
    x = s.join(codes, "k", "left").join(codes.select(F.col("k").alias("k2"), F.col("code").alias("other")), "k2", "left")
    return x.select(
        "show_id",
        F.when(predicates.plausible_venue(F.col("venue")), F.col("venue")).alias("venue"),
        F.when(predicates.plausible_city(F.col("city")), F.col("city")).alias("city"),
        F.coalesce("code", "other").alias("state"),
        (F.col("code").isNull() & F.col("other").isNotNull()).alias("retried"),
    )


@query("F-12", sql=f"""with l as (select doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) as line from documents)
 select doc_id, count(*) as lines from l where length(trim(line)) between 3 and 60 and regexp_matches(trim(line), '^[A-Z0-9]') and not regexp_matches(trim(line), '{predicates.DATE_LIKE}') and not regexp_matches(lower(trim(line)), '{predicates.NO_VENUE}') and not regexp_matches(trim(line), '[:>=]') group by doc_id""")
def venue_lines(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of a text may name a venue."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n", -1)).alias("line"))
    return lines.filter(predicates.venue_line(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("lines"))


QUERIES, ORACLE, COVERS = family.queries, family.oracle, family.covers
