"""Scalar functions (X-…) over the catalogue's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tapeloom.functions import fuzzy, parse, text
from tapeloom.operators import matching, places
from tapeloom.plans.base import release_fields, show_fields
from tapeloom.plans.registry import TOLD, Family
from tapeloom.tables import table

family = Family()
query = family.query


@query("X-1", "Q-4", sql="select rid, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') as k from song_titles")
def normalise_key(spark: SparkSession, d: str) -> DataFrame:
    """The pervasive key."""
    return table(spark, d, "song_titles").select("rid", text.norm_key(F.col("title")).alias("k"))


@query("X-2", "X-3", sql="""select gid, regexp_replace(regexp_replace(strip_accents(lower(name)), '^\\s*(saint|st)[\\s.-]+', 'st'), '[^a-z0-9]', '', 'g') as k from places""")
def folded_key(spark: SparkSession, d: str) -> DataFrame:
    """The key of places: accents fold to their letters, a leading saint to st."""
    return table(spark, d, "places").select("gid", text.city_key(F.col("name")).alias("k"))


@query("X-4", sql="""select rid, regexp_replace(regexp_replace(trim(regexp_replace(regexp_extract(lower(title), '^([^>/→]*)', 1), '\\b(reprise|jam|tease|intro|outro|acoustic|electric)\\b', '', 'g')), '^the\\s+', ''), '[^a-z0-9]', '', 'g') as k from song_titles""")
def song_key(spark: SparkSession, d: str) -> DataFrame:
    """The key of songs."""
    return table(spark, d, "song_titles").select("rid", text.song_norm(F.col("title")).alias("k"))


_TOK = "regexp_extract_all(lower(name), '[a-z0-9]+')"


@query("X-5", "X-6", "X-7", sql=f"""select norm, array_to_string(list_sort(list_distinct(list_filter({_TOK}, lambda w: length(w) > 1 and w not in ('the', 'and', 'of', 'at', 'in')))), ' ') as words,
 array_to_string(list_sort(list_distinct(list_filter({_TOK}, lambda w: w not in ('the', 'a', 'an', 'and', 'of', 'in', 'at', 'on', 'for', 'to')))), ' ') as small, array_to_string(list_transform({_TOK}, lambda w: left(w, 1)), '') as initials from artists""")
def word_sets(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words and initials of names."""
    n = F.col("name")
    return table(spark, d, "artists").select("norm", F.array_join(F.array_sort(text.norm_words(n)), " ").alias("words"), F.array_join(F.array_sort(text.words(n)), " ").alias("small"), text.initials(n).alias("initials"))


_FORMS = "list_transform(range(1, len({0}) + 1), lambda k: array_to_string(list_transform({0}[1:k], lambda w: left(w, 1)), '') || array_to_string({0}[k + 1:], ''))"


@query("X-8", sql=f"""with t as (select norm, {_TOK} as every, list_filter({_TOK}, lambda w: w not in ('the', 'a', 'an', 'and', 'of', 'in', 'at', 'on', 'for', 'to')) as few from artists)
 select norm, array_to_string(list_sort(list_distinct(list_concat({_FORMS.format('every')}, {_FORMS.format("few")}))), ' ') as forms from t""")
def initial_form_sets(spark: SparkSession, d: str) -> DataFrame:
    """All forms of a name as initials and the rest."""
    return table(spark, d, "artists").select("norm", F.array_join(F.array_sort(text.initial_forms(F.col("name"))), " ").alias("forms"))


@query("X-9", "X-12")
def title_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The similarity of each song's title to its act's next one, both ways: it is not symmetric."""
    t = table(spark, d, "song_titles").select("rid", "artist_norm", "title")
    nxt = F.lead("title").over(W.partitionBy("artist_norm").orderBy("rid"))
    p = t.withColumn("other", nxt).filter("other is not null")
    return p.select("rid", F.round(fuzzy.ratio(F.col("title"), F.col("other")), 6).alias("there"), F.round(fuzzy.ratio(F.col("other"), F.col("title")), 6).alias("back"), fuzzy.same_song(F.col("title"), F.col("other")).alias("same"))


@query("X-11", sql="select a.norm as a, b.norm as b from artists a join artists b on a.norm < b.norm where least(length(a.norm), length(b.norm)) >= 4 and (contains(a.norm, b.norm) or contains(b.norm, a.norm))")
def contained_keys(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of keys, one inside the other at any place."""
    return matching.contained_pairs(table(spark, d, "artists"), "norm")


@query("X-13", sql="with m as (select artist_id, min(release_id) as a, max(release_id) as b from {RELEASES} where artist_id is not null group by 1) select artist_id, left(a, list_max(list_filter(range(0, length(a) + 1), lambda k: left(a, k) = left(b, k)))) as prefix from m")
def common_beginnings(spark: SparkSession, d: str) -> DataFrame:
    """The beginning that all of an act's release ids share."""
    r = release_fields(spark, d).filter("artist_id is not null").groupBy("artist_id").agg(F.min("release_id").alias("a"), F.max("release_id").alias("b"))
    return r.select("artist_id", text.common_prefix(F.array("a", "b")).alias("prefix"))


@query("X-14", sql="select rid, regexp_replace(replace(translate(title, '‘’‚“”„–—−', '''''''\"\"\"---'), '…', '...'), '[\\x{200b}-\\x{200d}\\x{2060}\\x{feff}\\x{ad}]', '', 'g') as t from song_titles")
def plain_signs(spark: SparkSession, d: str) -> DataFrame:
    """Typographic signs to plain ones; the repair of encodings is problem 2's operator."""
    return table(spark, d, "song_titles").select("rid", text.plain_punctuation(F.col("title")).alias("t"))


@query("X-15", "X-37")
def cleaned_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles without times, arrows and marks, and track numbers of file names."""
    t = table(spark, d, "song_titles").select("rid", F.concat("title", F.lit(" > "), F.lit("")).alias("raw"), F.format_string("d%dt%02d.flac", F.col("rid") % 3 + 1, F.col("rid") % 20).alias("file"))
    return t.select("rid", text.clean_title(F.col("raw")).alias("title"), parse.track_number(F.col("file")).alias("track"), parse.disc_number(F.col("file")).alias("disc"))


@query("X-16", "X-17", "X-18", "X-19", "X-20", "X-22")
def cased_names(spark: SparkSession, d: str) -> DataFrame:
    """Names cleaned and put in house case."""
    r = release_fields(spark, d).select("id", "artist").filter("artist is not null")
    n = F.col("artist")
    return r.select("id", text.clean_artist(F.upper(n)).alias("cleaned"), text.title_case(n).alias("titled"), text.name_case(F.lower(n)).alias("named"), text.camel_split(F.replace(n, F.lit(" "), F.lit(""))).alias("split"), text.strip_label(F.concat(F.lit("Artist: "), n)).alias("value"))


@query("X-21", "X-53", sql="""select show_id, coalesce(nullif(regexp_replace(regexp_replace(concat_ws(', ', nullif(trim(venue), ''), nullif(trim(city), ''), nullif(trim(state), '')), '[<>:"/\\\\|?*]', '-', 'g'), '^[\\s.]+|[\\s.]+$', '', 'g'), ''), 'Unknown') as title from {SHOWS}""")
def composed_titles(spark: SparkSession, d: str) -> DataFrame:
    """An album's title of what is known, as a safe file name."""
    parts = [text.blank_to_null(F.col(c)) for c in ("venue", "city", "state")]
    return show_fields(spark, d).select("show_id", text.safe_name(F.concat_ws(", ", *parts)).alias("title"))


@query("X-25", "X-46", "Q-3", sql="select id, case when year(try_cast(date as date)) between 1900 and 2099 then strftime(try_cast(date as date), '%Y-%m-%d') end as day from {RELEASES}")
def iso_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates read from free text; the calendar is checked."""
    return release_fields(spark, d).select("id", parse.extract_date(F.col("date")).alias("day"))


@query("X-26", "X-29", sql="""select show_id, case when regexp_matches(upper(source_type), '\\b(FM|BROADCAST|SIMULCAST)\\b') then 'SBD.FM' when regexp_matches(upper(source_type), '\\b(MATRIX|MTX)\\b') then 'MTX' when regexp_matches(upper(source_type), '\\b(SBD|DSBD|SDB)\\b') then 'SBD' when regexp_matches(upper(source_type), '\\bFOB\\b') then 'AUD.FOB' when regexp_matches(upper(source_type), '\\bAUD\\b') then 'AUD' else '' end as kind,
 nullif(regexp_extract(folder_name, '\\[[^\\]]*?([0-9]{6})\\]', 1), '') as number from {SHOWS} where source_type is not null""")
def source_classes(spark: SparkSession, d: str) -> DataFrame:
    """A source's class from its label, and the circulation number of the folder's name."""
    return show_fields(spark, d).filter("source_type is not null").select("show_id", parse.source_type(F.col("source_type")).alias("kind"), parse.shnid(F.col("folder_name")).alias("number"))


@query("X-28", "X-30", sql=r"""with t as (select doc_id, coalesce(text, '') as t from documents), l as (select doc_id, unnest(string_split_regex(t, '\r?\n')) as line, generate_subscripts(string_split_regex(t, '\r?\n'), 1) as n from t),
 r as (select doc_id, arg_min(regexp_replace(regexp_replace(trim(line), '(?i)^(taped by|recorded by|recordist|taper)', ''), '^[\s:=]+', ''), n) as said from l where regexp_matches(trim(line), '(?i)^(taped by|recorded by|recordist|taper)') and regexp_replace(regexp_replace(trim(line), '(?i)^(taped by|recorded by|recordist|taper)', ''), '^[\s:=]+', '') <> '' group by doc_id),
 w as (select doc_id, string_split_regex(said, '\s+')[-1] as last from r)
 select t.doc_id, regexp_extract(t.t, '(?i)[\[(]\s*(official|archive series|label release)\b[^\])]*[\])]', 1) as official, case when not regexp_matches(w.last, '[0-9]') and length(w.last) > 1 then w.last end as recorder from t left join w on w.doc_id = t.doc_id""")
def labels_and_tapers(spark: SparkSession, d: str) -> DataFrame:
    """What a text says of an official release, and who recorded it."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", parse.official_label(t).alias("official"), parse.recorder(t).alias("recorder"))


_HTML = "(?i)</?(?:html|body|p|br|div|span|table|tr|td|li|ul|b|i|a|h[1-6])\\b[^>]*>"
_STRIPPED = "regexp_replace(regexp_replace(text, '(?i)<br\\s*/?>|</(?:p|div|li|tr|h[1-6]|table|ul|ol)>', chr(10), 'g'), '<[^<>]{1,400}>', '', 'g')"
for _name, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _STRIPPED = f"replace({_STRIPPED}, '{_name}', '{_char}')"


@query("X-27", "X-42", "SRC-7", sql=f"""with t as (select doc_id, case when regexp_matches(text, '{_HTML}') then {_STRIPPED} else text end as t from documents)
 select doc_id, coalesce({TOLD.format("t")}, '') as kind, coalesce(len(string_split(t, chr(10))), -1) as lines from t""")
def text_sources(spark: SparkSession, d: str) -> DataFrame:
    """A source's class from the evidence in whole texts, their HTML read as lines."""
    t = table(spark, d, "documents").select("doc_id", text.html_lines(F.col("text")).alias("t"))
    return t.select("doc_id", parse.infer_source(F.col("t")).alias("kind"), F.coalesce(F.size(F.split("t", "\n", -1)), F.lit(-1)).alias("lines"))


@query("X-31", "X-32", "X-35", "X-38")
def parsed_folders(spark: SparkSession, d: str) -> DataFrame:
    """Folder names taken apart."""
    f = show_fields(spark, d).select("show_id", parse.folder_name(F.col("folder_name")).alias("f"), parse.album_string(F.col("folder_name")).alias("a"), parse.show_part(F.col("folder_name")).alias("part"), parse.location_line(F.col("venue")).alias("l"))
    return f.select("show_id", "f.artist", "f.date", "f.rest", F.col("a.venue").alias("venue"), F.col("a.city").alias("city"), F.col("a.state").alias("state"), F.col("a.source_type").alias("source_type"), F.col("a.complete").alias("complete"), "part", F.col("l.venue").alias("located"))


@query("X-33", "X-13", sql="""with f as (select artist_norm, list_sort(list(artist_norm || ' - ' || title)) as files from song_titles where title is not null and artist_norm is not null group by 1),
 p as (select *, left(files[1], list_max(list_filter(range(0, length(files[1]) + 1), lambda k: left(files[1], k) = left(files[-1], k)))) as prefix from f), t as (select *, list_transform(files, lambda x: trim(substr(x, length(prefix) + 1))) as titles from p)
 select artist_norm, prefix, case when len(list_filter(titles, lambda x: x = '')) = 0 and len(list_distinct(titles)) > 1 then array_to_string(titles, '|') end as titles from t""")
def titles_from_files(spark: SparkSession, d: str) -> DataFrame:
    """Titles from an act's file names: the common beginning goes; only if every file yields one and not all are the same."""
    f = table(spark, d, "song_titles").groupBy("artist_norm").agg(F.array_sort(F.collect_list(F.concat("artist_norm", F.lit(" - "), "title"))).alias("files"))
    left = F.transform("files", lambda x: F.trim(F.substring(x, F.length("prefix") + 1, F.length(x))))
    g = f.withColumn("prefix", text.common_prefix(F.col("files"))).withColumn("titles", left)
    return g.select("artist_norm", "prefix", F.when(F.forall("titles", lambda t: t != "") & (F.size(F.array_distinct("titles")) > 1), F.array_join("titles", "|")).alias("titles"))


@query("X-34")
def parsed_texts(spark: SparkSession, d: str) -> DataFrame:
    """Information texts read: artist, date, place, source and titles."""
    t = table(spark, d, "documents").filter("kind = 'info'").select("doc_id", parse.info_text(text.html_lines(F.col("text"))).alias("i"))
    return t.select("doc_id", "i.artist", "i.date", "i.place", "i.source_type", F.size("i.titles").alias("titles"))


@query("X-39", "X-43", sql="""select id, array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(data.formats, []), lambda f: case when regexp_matches(f, '(?i)24.?bit') then 'flac24' when regexp_matches(f, '(?i)flac') then 'flac16' when regexp_matches(f, '(?i)shorten|shn') then 'shn' when regexp_matches(f, '(?i)mp3|vbr') then 'mp3' when regexp_matches(f, '(?i)ogg') then 'ogg' end), lambda x: x is not null))), ', ') as formats from (select distinct id, data from releases)""")
def format_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Formats as sorted tokens."""
    return table(spark, d, "releases").select("id", F.col("data.formats").alias("f")).distinct().select("id", text.list_text(parse.formats_list(F.col("f"))).alias("formats"))


@query("X-40", "X-41", "SNK-2")
def redacted_log(spark: SparkSession, d: str) -> DataFrame:
    """Log lines with secrets blotted out, and hashes read from links."""
    e = table(spark, d, "events").select("event_id", F.format_string("GET https://u%d:pw%d@host/x?api_key=%d&y=1 magnet:?xt=urn:btih:%s", "user_id", "event_id", "event_id", F.sha1(F.col("event_id").cast("string"))).alias("line"))
    return e.select("event_id", text.redact(F.col("line")).alias("line"), text.magnet_hash(F.col("line")).alias("hash"), text.label_slug(F.lit("My Label!")).alias("label"))


@query("X-44", "X-45", sql="select distinct id, strftime(first_seen - interval 30 day, '%Y-%m-%d') as since, first_seen < (select max(first_seen) from releases) - interval 90 day as expired from releases where first_seen is not null")
def cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """Days back, and what is past its time."""
    r = table(spark, d, "releases").filter("first_seen is not null").select("id", "first_seen").distinct()
    newest = r.agg(F.max("first_seen").alias("newest"))
    return r.crossJoin(F.broadcast(newest)).select("id", F.date_format(F.expr("first_seen - interval 30 days"), "yyyy-MM-dd").alias("since"), F.expr("first_seen < newest - interval 90 days").alias("expired"))  # one row


@query("X-47", "X-48", "X-55", sql="select doc_id, (n_chars // 60) || ':' || lpad(cast(n_chars % 60 as varchar), 2, '0') as clock, abs(n_chars - 1500) <= 0.05 * greatest(n_chars, 1) as near from documents where n_chars is not null")
def formatted_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers as clock times, and a relative tolerance with a guarded denominator."""
    n = F.col("n_chars")
    return table(spark, d, "documents").filter("n_chars is not null").select("doc_id", text.clock(n).alias("clock"), (F.abs(n - 1500) <= 0.05 * F.greatest(n, F.lit(1))).alias("near"))


@query("X-50", "X-51", "SRC-9", "SRC-25", sql="select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """A field of JSON text, null where the text is no JSON."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("X-50", "SRC-25")
def merged_settings(spark: SparkSession, d: str) -> DataFrame:
    """Defaults overlaid with own settings, secrets masked."""
    defaults = F.create_map(F.lit("wait"), F.lit("5"), F.lit("sources"), F.lit("SBD"), F.lit("api_key"), F.lit(""))
    m = table(spark, d, "monitored_artists").select("id", F.map_filter(F.create_map(F.lit("sources"), "sources", F.lit("api_key"), "collection"), lambda k, v: F.coalesce(v, F.lit("")) != "").alias("own"))
    both = F.map_zip_with(defaults, "own", lambda k, a, b: F.when(k.endswith("key"), F.lit("***")).otherwise(F.coalesce(b, a)))
    return m.select("id", F.to_json(both).alias("settings"))


@query("X-52", "SRC-21", sql="select id, sha1(release_id) as hash from {RELEASES}")
def sha1_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashes."""
    return release_fields(spark, d).select("id", F.sha1("release_id").alias("hash"))


@query("X-54", sql="select id, case when contains(lower(artist), 'string band') then 'String bands' when contains(lower(artist), 'orchestra') then 'Orchestras' else artist end as album_artist from {RELEASES} where artist is not null")
def umbrella_names(spark: SparkSession, d: str) -> DataFrame:
    """Families of acts under one name, from a table of rules."""
    rules = (("string band", "String bands"), ("orchestra", "Orchestras"))
    out = F
    for part, family_name in rules:
        out = out.when(F.contains(F.lower("artist"), F.lit(part)), family_name)
    return release_fields(spark, d).filter("artist is not null").select("id", out.otherwise(F.col("artist")).alias("album_artist"))


@query("X-23", "R-14", "R-15")
def tidied_locations(spark: SparkSession, d: str) -> DataFrame:
    """Venue, city and state put right step by step: the order of the steps matters."""
    return places.tidy(show_fields(spark, d).select("show_id", "venue", "city", "state"))


QUERIES, ORACLE, COVERS = family.queries, family.oracle, family.covers
