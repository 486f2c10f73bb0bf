"""Composite operators (R-…) that process data: merging, aligning, resolving, comparing, proposing.

The reference's business rules (what to file, when to grab, whom to let in) are left out; what they are
computed from is here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tapeloom.functions import fuzzy, parse, text
from tapeloom.operators import merging, nested, places, predicates, sequences, shows
from tapeloom.operators.alignment import align
from tapeloom.plans import problems
from tapeloom.plans.base import release_fields, show_fields, show_tracks
from tapeloom.plans.registry import FILLER_PARTS, STATED, TOLD, Family
from tapeloom.tables import table

family = Family()
query = family.query

_N = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
@query("R-2", "Q-22", sql="select show_id, case when regexp_extract(folder_name, '((19|20)[0-9][0-9]-[0-9][0-9]-[0-9][0-9])', 1) <> '' then regexp_extract(folder_name, '((19|20)[0-9][0-9]-[0-9][0-9]-[0-9][0-9])', 1) else date end as date, coalesce(nullif(regexp_extract(folder_name, '\\[[^\\]]*?([0-9]{6})\\]', 1), ''), nullif(shnid, '')) as shnid from {SHOWS}")
def overrides_after_merge(spark: SparkSession, d: str) -> DataFrame:
    """The folder's date and number win over the record's."""
    day = F.regexp_extract("folder_name", "((19|20)[0-9][0-9]-[0-9][0-9]-[0-9][0-9])", 1)
    return show_fields(spark, d).select("show_id", F.when(day != "", day).otherwise(F.col("date")).alias("date"), F.coalesce(parse.shnid(F.col("folder_name")), F.nullif("shnid", F.lit(""))).alias("shnid"))


@query("R-5", sql=f"""with n as (select distinct artist from {{RELEASES}} where artist is not null), s as (select artist, regexp_extract(artist, '^(.{{{{3,}}}}?) (feat[.]|featuring|with|w/) ', 1) as sure, regexp_extract(artist, '^(.{{{{3,}}}}?) (&|and|[+]) ', 1) as maybe from n)
 select artist, coalesce(nullif(sure, ''), a.name) as host from s left join artists a on a.norm = {_N.format('maybe')} and maybe <> '' where coalesce(nullif(sure, ''), a.name) is not null""".replace("{{{{3,}}}}", "{3,}").replace("{{3,}}", "{3,}"))
def split_host(spark: SparkSession, d: str) -> DataFrame:
    """The act before its guests: forms like "with" always split, "and" only where the head is a known act."""
    n = release_fields(spark, d).select("artist").filter("artist is not null").distinct()
    x = n.select("artist", F.nullif(F.regexp_extract("artist", r"^(.{3,}?) (feat[.]|featuring|with|w/) ", 1), F.lit("")).alias("sure"), F.nullif(F.regexp_extract("artist", r"^(.{3,}?) (&|and|[+]) ", 1), F.lit("")).alias("maybe"))
    a = table(spark, d, "artists").select(F.col("norm").alias("k"), F.col("name"))
    return x.withColumn("k", text.norm_key(F.col("maybe"))).join(a, "k", "left").select("artist", F.coalesce("sure", "name").alias("host")).filter("host is not null")


@query("R-6", sql="""with t as (select artist_norm, count(*) as n, count(*) filter (where confirmed = 1) as good from song_titles group by 1) select artist_norm, case when n < 5 then 'adopt' when good < 0.6 * n then 'adopt' else 'keep' end as choice from t""")
def setlist_choice(spark: SparkSession, d: str) -> DataFrame:
    """Whether a list is good enough or another should be taken, by the share that is recognised."""
    t = table(spark, d, "song_titles").groupBy("artist_norm").agg(F.count("*").alias("n"), F.count_if(F.col("confirmed") == 1).alias("good"))
    return t.select("artist_norm", F.when(F.col("n") < 5, "adopt").when(F.col("good") < 0.6 * F.col("n"), "adopt").otherwise("keep").alias("choice"))


def _files_and_songs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All lists of songs, of shows and of their parts, a list of files made of each, and the titles typed for files.

    A third of the lists has tuning before the songs, every second of them without saying so; of another third the last
    file is missing. The typed titles are the metas' own overrides, by file name.
    """
    c = F.col
    t = show_tracks(spark, d).withColumn("list_id", F.concat_ws("/", "show_id", "part_no")).withColumn("disc", F.coalesce("disc", F.lit(1).cast("long")))
    songs = t.select("list_id", c("track_no").alias("pos"), "num", "title", "disc", "set_no", "segue")
    last = F.max("track_no").over(W.partitionBy("list_id"))
    kept = t.withColumn("last", last).filter((c("show_id") % 3 != 1) | (c("track_no") < c("last")) | (c("last") == 1))
    files = kept.select("list_id", c("track_no").alias("pos"), F.format_string("t%02d.flac", "track_no").alias("name"), (F.lit(200.0) + c("track_no") * 7 % 180).alias("seconds"), c("title").alias("label"), "disc")
    tuning = t.filter("show_id % 3 = 0").select("list_id", "show_id").distinct()
    tuning = tuning.select("list_id", F.lit(0).cast("long").alias("pos"), F.lit("t00.flac").alias("name"), F.lit(31.0).alias("seconds"), F.when(c("show_id") % 2 == 0, "Tuning").otherwise("").alias("label"), F.lit(1).cast("long").alias("disc"))
    docs = shows.documents(spark, d)
    own = docs.select(F.concat(c("id").cast("string"), F.lit("/0")).alias("list_id"), F.explode(F.expr("try_variant_get(doc, '$.title_overrides', 'map<string,string>')")).alias("name", "title"))
    return files.unionByName(tuning), songs, own


@query("R-7", "R-8", "R-9", "R-10", "J-19", "A-18")
def alignment(spark: SparkSession, d: str) -> DataFrame:
    """Which file is which song: by count, by names, by short files at the edges, by labels, by segues, by numbers, or as typed."""
    return align(*_files_and_songs(spark, d), key="list_id")


_ALIGN_FILES = f"""t as (select show_id, part_no, track_no, show_id || '/' || part_no as list_id, title, coalesce(disc, 1) as disc, coalesce(set_no, 0) as set_no, num from ({problems.P1_TRACKS_SQL})),
 songs as (select list_id, row_number() over (partition by list_id order by track_no) as no, title, disc, set_no from t),
 files as (select list_id, track_no as pos, printf('t%02d.flac', track_no) as name, 200.0 + track_no * 7 % 180 as seconds, title as label, disc from (select *, max(track_no) over (partition by list_id) as last from t) where show_id % 3 <> 1 or track_no < last or last = 1
  union all select distinct list_id, 0, 't00.flac', 31.0, case when show_id % 2 = 0 then 'Tuning' else '' end, 1 from t where show_id % 3 = 0)"""
_KEYED = "regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]', '', 'g')"
_FILLED = FILLER_PARTS.format("label")
_WORDS = "[" + ", ".join("'" + f.replace("-", "") + "'" for f in predicates.FILLERS) + "]"
ALIGN_SQL = rf"""with {_ALIGN_FILES},
 listed as (select list_id, count(*) as n_songs, list({_KEYED.format('title')}) as keys from songs group by 1),
 a as (select f.*, n_songs, count(*) over (partition by f.list_id) - n_songs as surplus, list_contains(keys, {_KEYED.format('label')}) as said,
  len({_FILLED}) > 0 and len(list_filter({_FILLED}, lambda p: not list_contains({_WORDS}, p))) = 0 as filler from files f join listed using (list_id)),
 b as (select *, filler and not said as own from a),
 m as (select *, coalesce(lag(disc) over w <> disc or lag(own) over w, true) or coalesce(lead(disc) over w <> disc or lead(own) over w, true) as border, median(seconds) over (partition by list_id) as middle from b window w as (partition by list_id order by pos)),
 e as (select *, border and seconds < least(90, 0.4 * middle) and not own and not said as brief from m),
 g as (select *, count(*) filter (where own) over (partition by list_id) as n_own, count(*) filter (where brief) over (partition by list_id) as n_brief, count(*) filter (where own) over (partition by list_id order by pos) as own_no, row_number() over (partition by list_id order by brief desc, seconds, pos) as brief_no from e),
 h as (select *, case when surplus between 1 and 4 then case when n_own >= surplus then own and own_no <= surplus else own or (brief and brief_no <= surplus - n_own) end else false end as aside from g where surplus between 0 and 4),
 i as (select *, count(*) filter (where not aside) over (partition by list_id order by pos) as no from h),
 j as (select i.*, s.title as song, case when not aside then s.set_no end as s_set, case when not aside then s.disc end as s_disc from i left join songs s on s.list_id = i.list_id and s.no = i.no),
 k as (select *, last_value(s_disc ignore nulls) over (partition by list_id order by pos rows between unbounded preceding and 1 preceding) as d_before, first_value(s_disc ignore nulls) over (partition by list_id order by pos rows between 1 following and unbounded following) as d_after,
  last_value(s_set ignore nulls) over (partition by list_id order by pos rows between unbounded preceding and 1 preceding) as t_before, first_value(s_set ignore nulls) over (partition by list_id order by pos rows between 1 following and unbounded following) as t_after,
  coalesce(lag(disc) over w <> disc, false) or coalesce(lead(disc) over w <> disc, false) as turn, regexp_replace(coalesce(label, ''), '^[ \-–—*>~]+|[ \-–—*>~]+$', '', 'g') as bare from j window w as (partition by list_id order by pos)),
 r as (select list_id, pos, name, aside, case when surplus = 0 then 'count' when n_own >= surplus then 'named' when n_own + n_brief >= surplus then 'short' else 'none' end as how, case when surplus = 0 then true when n_own >= surplus then n_own = surplus else n_own + n_brief = surplus end as ok,
  case when not aside then coalesce(song, '') when filler then upper(left(bare, 1)) || lower(substr(bare, 2)) when d_before is null then 'Tuning' when d_after is null then 'Crowd' when d_after = 99 and d_before <> 99 then 'Encore Break' when t_before <> t_after or d_before <> d_after or turn then 'Set Break' else 'Tuning' end as title from k)
 select list_id, pos, name, case when aside then 'extra' when title <> '' then 'song' else 'unmatched' end as kind, title, how, ok from r"""


@query("R-7", "R-9", "A-18", sql=ALIGN_SQL)
def alignment_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The lists with as many files as songs or up to four more, before any typed title: counted, or with files set aside and called by their place."""
    files, songs, _ = _files_and_songs(spark, d)
    more = files.groupBy("list_id").count().join(songs.groupBy("list_id").agg(F.count("*").alias("n")), "list_id").filter("count between n and n + 4").select("list_id")
    return align(files.join(more, "list_id", "left_semi"), songs.join(more, "list_id", "left_semi"), key="list_id")


@query("R-7", sql="""with f as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as k, count(*) over (partition by user_id) as n from events where event_type in ('click', 'view')), s as (select user_id, event_id as song, row_number() over (partition by user_id order by ts, event_id) as k, count(*) over (partition by user_id) as n from events where event_type = 'signup')
 select f.user_id, f.event_id, s.song from f join s on s.user_id = f.user_id and s.k = f.k""")
def alignment_by_count(spark: SparkSession, d: str) -> DataFrame:
    """The plain leg, relational: two ordered lists side by side."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    f = e.filter("event_type in ('click', 'view')").withColumn("k", F.row_number().over(w))
    s = e.filter("event_type = 'signup'").withColumn("k", F.row_number().over(w)).select("user_id", "k", F.col("event_id").alias("song"))
    return f.join(s, ["user_id", "k"]).select("user_id", "event_id", "song")


@query("R-11", "X-26", "X-27", sql=f"""with s as (select show_id, {STATED.format("source_type")} as stated, {STATED.format("regexp_replace(folder_name, '[._\\[\\]]', ' ', 'g')")} as named from {{SHOWS}}),
 t as (select show_id, min({TOLD.format("text")}) as told from documents where show_id is not null group by show_id)
 select s.show_id, coalesce(stated, named, told, '') as kind, case when stated is not null then 'stated' when named is not null then 'folder' when told is not null then 'text' else '' end as how from s left join t on t.show_id = s.show_id""")
def source_resolution(spark: SparkSession, d: str) -> DataFrame:
    """A source's class: stated, else the folder's, else what the texts of the show suggest."""
    s = show_fields(spark, d).select("show_id", parse.source_type(F.col("source_type")).alias("stated"), parse.source_type(F.regexp_replace("folder_name", r"[._\[\]]", " ")).alias("named"))
    t = table(spark, d, "documents").filter("show_id is not null").select("show_id", parse.infer_source(F.col("text")).alias("k")).filter("k <> ''").groupBy("show_id").agg(F.min("k").alias("told"))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return s.join(t, "show_id", "left").select("show_id", F.coalesce(some("stated"), some("named"), "told", F.lit("")).alias("kind"), F.when(some("stated").isNotNull(), "stated").when(some("named").isNotNull(), "folder").when(F.col("told").isNotNull(), "text").otherwise("").alias("how"))


@query("R-12", "A-19", sql="""with g as (select user_id, count(*) filter (where value < 5) as silent, avg(value) as level, count(*) as n from events where value is not null group by user_id) select user_id, case when silent >= greatest(2, n - 1) then 'SBD' when level <= 15 then 'AUD' when level >= 26 or (level >= 20 and silent > 0) then 'SBD' else '' end as kind from g""")
def level_rule(spark: SparkSession, d: str) -> DataFrame:
    """A class from measured levels: counts below a floor and the mean."""
    g = table(spark, d, "events").filter("value is not null").groupBy("user_id").agg(F.count_if(F.col("value") < 5).alias("silent"), F.avg("value").alias("level"), F.count("*").alias("n"))
    kind = F.when(F.col("silent") >= F.greatest(F.lit(2), F.col("n") - 1), "SBD").when(F.col("level") <= 15, "AUD").when((F.col("level") >= 26) | ((F.col("level") >= 20) & (F.col("silent") > 0)), "SBD").otherwise("")
    return g.select("user_id", kind.alias("kind"))


_PLAIN = "strip_accents(lower({}))"
for _from, _to in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("ł", "l"), ("đ", "d"), ("ð", "d"), ("þ", "th")):
    _PLAIN = f"replace({_PLAIN}, '{_from}', '{_to}')"
_FOLD = "regexp_replace(regexp_replace(" + _PLAIN + ", '^\\s*(saint|st)[\\s.-]+', 'st'), '[^a-z0-9]', '', 'g')"
_CITY = _FOLD.replace("{}", "regexp_replace({}, '\\s*\\([^)]*\\)\\s*', ' ', 'g')")
_TOP = "(select {k}, admin, pop from (select *, row_number() over (partition by {k} order by pop desc, admin) as r, lead(pop) over (partition by {k} order by pop desc, admin) as next from (select {k}, admin, max(pop) as pop from h group by all)) where r = 1 and (next is null or pop >= 15 * greatest(next, 1)))"


@query("R-13", "J-16", "A-10", "A-11", sql=f"""with h as (select {_CITY.format('name')} as ck, admin, cc, pop from places), any_hit as (select ck, list(distinct admin) as admins from h group by 1), lone as (select * from {_TOP.format(k='ck')}), ins as (select * from {_TOP.format(k='ck, cc')}),
 n as (select {_FOLD.format('name')} as sk, min(code) as named from ref_states group by 1), l as (select {_FOLD.format('alias')} as sk, min(code) as land from (select code, unnest(list_concat([name], coalesce(aliases, []))) as alias from countries) where alias is not null group by 1),
 vs as (select city, state, count(*) as n from venues where city <> '' and state <> '' group by all), vr as (select *, sum(n) over (partition by city) as total, row_number() over (partition by city order by n desc, state) as r from vs),
 v as (select {_FOLD.format('city')} as ck, min(state) as vote, max(state) as other from vr where r = 1 and n >= 2 and n >= 0.8 * total group by 1),
 x as (select show_id, city, state, {_CITY.format("coalesce(city, '')")} as ck, {_FOLD.format("coalesce(state, '')")} as sk, upper(trim(coalesce(state, ''), ' ')) as up, coalesce(state, '') <> '' as known from {{SHOWS}}),
 j as (select x.*, admins, lone.admin as dominant, named, land, c.code is not null as is_code, case when v.vote = v.other then v.vote end as vote, ins.admin as in_country from x left join any_hit using (ck) left join lone using (ck) left join n using (sk) left join l using (sk) left join ref_states c on c.code = x.up left join v using (ck) left join ins on ins.ck = x.ck and ins.cc = l.land),
 k as (select *, case when is_code and (admins is null or list_contains(admins, up)) then 'code' when named is not null then 'name' when in_country is not null then 'country' when is_code then 'code' when not known and vote is not null then 'library' when not known and dominant is not null then 'dominant' end as how from j)
 select show_id, city, state, case how when 'code' then up when 'name' then named when 'country' then in_country when 'library' then vote when 'dominant' then dominant end as region, how from k""")
def resolved_places(spark: SparkSession, d: str) -> DataFrame:
    """The region of every show's place: by code, name, country, the library's vote, or the dominant city of that name."""
    votes = merging.majority(table(spark, d, "venues").filter("city <> '' and state <> ''").select(F.col("city").alias("city_key"), "state"), ["city_key"], "state")
    s = show_fields(spark, d).select("show_id", "city", "state")
    return places.resolve(s, table(spark, d, "places"), table(spark, d, "ref_states"), table(spark, d, "countries"), votes.groupBy("city_key").agg(F.min("state").alias("state")))


@query("R-14", sql=f"""with c as (select distinct {_CITY.format('name')} as k from places), r as (select distinct {_FOLD.format('name')} as k from ref_states),
 s as (select show_id, cast(null as varchar) as venue, venue as city, city as state from {{SHOWS}} union all select show_id, venue, city, state from {{SHOWS}}),
 x as (select *, {_CITY.format("coalesce(state, '')")} as sk, {_CITY.format("coalesce(city, '')")} as ck from s), y as (select *, sk in (select k from c) and ck not in (select k from c) and sk not in (select k from r) and coalesce(venue, '') = '' as moved from x)
 select show_id, case when moved then city else venue end as venue, case when moved then state else city end as city, case when not moved then state end as state, moved from y""")
def shifted_places(spark: SparkSession, d: str) -> DataFrame:
    """Every show's place twice: as it is, and with venue and city typed one field too low, which is put right."""
    s = show_fields(spark, d).select("show_id", "venue", "city", "state")
    s = s.select("show_id", F.lit(None).cast("string").alias("venue"), F.col("venue").alias("city"), F.col("city").alias("state")).unionByName(s)
    return places.shift(s, table(spark, d, "places"), table(spark, d, "ref_states"))


@query("R-17", "X-48", "Q-1", sql=f"""with r as (select {_N.format('artist')} as a, date, id, case source_type when 'SBD' then 6 when 'SBD.FM' then 5 when 'MTX' then 4 when 'AUD.FOB' then 3 when 'AUD' then 2 else 1 end as rank, coalesce(downloads, 0) as size from {{RELEASES}} where artist is not null and length(date) = 10),
 p as (select *, lead(id) over w as other, lead(rank) over w as orank, lead(size) over w as osize from r window w as (partition by a, date order by id))
 select id, other, case when orank > rank then 'better' when orank < rank then 'worse' when osize > 1.05 * size then 'larger' when osize < 0.95 * size then 'smaller' else 'equal' end as verdict from p where other is not null""")
def upgrade_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Each release against the act's next one of that night: rank, then size within a tolerance."""
    r = release_fields(spark, d).filter("artist is not null and length(date) = 10").select(text.norm_key(F.col("artist")).alias("a"), "date", "id", sequences.source_rank(F.col("source_type")).alias("rank"), F.coalesce("downloads", F.lit(0)).alias("size"))
    w = W.partitionBy("a", "date").orderBy("id")
    p = r.select("id", "rank", "size", F.lead("id").over(w).alias("other"), F.lead("rank").over(w).alias("orank"), F.lead("size").over(w).alias("osize")).filter("other is not null")
    verdict = F.when(F.col("orank") > F.col("rank"), "better").when(F.col("orank") < F.col("rank"), "worse").when(F.col("osize") > 1.05 * F.col("size"), "larger").when(F.col("osize") < 0.95 * F.col("size"), "smaller").otherwise("equal")
    return p.select("id", "other", verdict.alias("verdict"))


@query("R-18", "R-19", sql="""select id, len(list_filter(coalesce(formats, []), lambda f: regexp_matches(f, '(?i)flac|shorten|shn|24.?bit'))) > 0 as lossless, len(coalesce(formats, [])) > 0 as has_audio from (select distinct id, data.formats as formats from releases)""")
def lossless_releases(spark: SparkSession, d: str) -> DataFrame:
    """Whether any of a release's formats is lossless: predicates over an array."""
    f = table(spark, d, "releases").select("id", F.coalesce("data.formats", F.array().cast("array<string>")).alias("f")).distinct()
    return f.select("id", F.exists("f", lambda x: F.coalesce(x.rlike("(?i)flac|shorten|shn|24.?bit"), F.lit(False))).alias("lossless"), (F.size("f") > 0).alias("has_audio"))


@query("R-20", "R-22", "Q-20", sql=f"""with s as (select show_id, {_N.format('venue')} as k, venue, city, state from {{SHOWS}}), v as (select {_N.format('venue')} as k, arg_min(city, venue_id) as vcity, arg_min(state, venue_id) as vstate from ref_venues group by 1),
 j as (select show_id, unnest([{{'field': 'city', 'was': city, 'now': vcity}}, {{'field': 'state', 'was': state, 'now': vstate}}]) as c from s join v on v.k = s.k) select show_id, c.field as field, c.was as was, c.now as now from j where c.was is distinct from c.now""")
def proposed_changes(spark: SparkSession, d: str) -> DataFrame:
    """Where a record differs from the list's entry of its venue: one row per field."""
    v = table(spark, d, "ref_venues").groupBy(text.norm_key(F.col("venue")).alias("k")).agg(F.min_by("city", "venue_id").alias("vcity"), F.min_by("state", "venue_id").alias("vstate"))
    j = show_fields(spark, d).withColumn("k", text.norm_key(F.col("venue"))).join(v, "k")
    pair = lambda f: F.struct(F.lit(f).alias("field"), F.col(f).alias("was"), F.col(f"v{f}").alias("now"))
    return j.select("show_id", F.explode(F.array(pair("city"), pair("state"))).alias("c")).select("show_id", "c.field", "c.was", "c.now").filter(~F.col("was").eqNullSafe(F.col("now")))


@query("R-21", "SRC-19", "U-2", sql="select id, indexer as client, case status when 'wanted' then 'queued' when 'grabbed' then 'done' when 'skipped' then 'paused' when 'failed' then 'error' else 'unknown' end as state from {RELEASES}")
def mapped_states(spark: SparkSession, d: str) -> DataFrame:
    """Several systems' words for a state as shared ones, by a map."""
    known = F.create_map(*[F.lit(x) for p in {"wanted": "queued", "grabbed": "done", "skipped": "paused", "failed": "error"}.items() for x in p])
    return release_fields(spark, d).select("id", F.col("indexer").alias("client"), F.coalesce(F.try_element_at(known, F.col("status")), F.lit("unknown")).alias("state"))


@query("R-22", "X-36", "A-16")
def learned_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Rules learned from records: the folder's name wrong, the record's right; only related names, the last one wins."""
    s = show_fields(spark, d).select("show_id", "artist", parse.folder_name(F.col("folder_name"))["artist"].alias("head"))
    k = s.filter("artist is not null and head is not null").withColumn("wrong", text.norm_key(F.col("head"))).filter(F.col("wrong") != text.norm_key(F.col("artist")))
    rules = k.groupBy("wrong").agg(F.max_by("artist", "show_id").alias("right"), F.max_by("head", "show_id").alias("head"))
    return rules.filter(fuzzy.names_related(F.col("right"), F.col("head"))).select("wrong", "right")


@query("R-26", sql="""with s as (select distinct id, meta from shows where json_valid(meta)), p as (select id, json_array_length(meta->'$.parts') as n from s where json_type(meta->'$.parts') = 'ARRAY') select id as show_id, cast(n as bigint) as parts from p where n > 1""")
def shows_of_parts(spark: SparkSession, d: str) -> DataFrame:
    """Shows whose parts are stored as a list, and how many."""
    docs = shows.documents(spark, d)
    arr = F.try_variant_get(F.try_variant_get("doc", "$.parts", "variant"), "$", "array<variant>")
    return docs.select(F.col("id").alias("show_id"), F.size(arr).cast("long").alias("parts"), nested.is_null_item(F.try_variant_get("doc", "$.parts", "variant")).alias("none")).filter("not none and parts > 1").select("show_id", "parts")


@query("R-27", "W-1", "Q-11", "Q-21", sql="""with g as (select md5(text) as k, doc_id, n_chars, case lang when 'en' then 2 else 1 end as rank from documents where text is not null), b as (select k, max(rank) as rank, count(*) as n from g group by k)
 select g.k, min(g.doc_id) as keeper, any_value(b.n) as copies from g join b on b.k = g.k and b.rank = g.rank where b.n > 1 group by g.k""")
def dedupe_keep_best(spark: SparkSession, d: str) -> DataFrame:
    """Of equal texts the best-ranked, then the first: two aggregates, no ranking of a whole group in one task."""
    g = table(spark, d, "documents").filter("text is not null").select(F.md5("text").alias("k"), "doc_id", F.when(F.col("lang") == "en", 2).otherwise(1).alias("rank"))
    best = g.groupBy("k").agg(F.max(F.struct("rank", (-F.col("doc_id")).alias("minus"))).alias("m"), F.count("*").alias("copies")).filter("copies > 1")
    return best.select("k", (-F.col("m.minus")).alias("keeper"), "copies")


QUERIES, ORACLE, COVERS = family.queries, family.oracle, family.covers
