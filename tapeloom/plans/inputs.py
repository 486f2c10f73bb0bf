"""Sources (SRC-…) and sinks (SNK-…)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.functions.text import html_lines
from tapeloom.operators import places, predicates
from tapeloom.plans.base import release_fields, show_fields, show_tracks
from tapeloom.plans.problems import P1_TRACKS_SQL
from tapeloom.plans.registry import Family
from tapeloom.sources import paged, replies, sinks, texts
from tapeloom.tables import shared_folder, table

family = Family()
query = family.query


@query("SRC-1", "SRC-2", "SRC-4")
def folder_listing(spark: SparkSession, d: str) -> DataFrame:
    """The data folder's files by parent folder."""
    return texts.newest_by_folder(texts.listing(spark, d, "*.parquet").filter(predicates.visible(F.col("name")))).select("files", "bytes", "newest")


@query("SRC-3", sql="select distinct id, regexp_extract(filed_path, '([^/]+)/[^/]+$', 1) as parent, regexp_extract(filed_path, '([^/]+)$', 1) as leaf from shows where filed_path is not null and filed_path <> '' and not regexp_matches(filed_path, '/[^/]*(19|20)[0-9][0-9]/')")
def library_walk(spark: SparkSession, d: str) -> DataFrame:
    """Artist and show of every filed path."""
    p = table(spark, d, "shows").filter("filed_path is not null and filed_path <> ''").filter(~F.col("filed_path").rlike("/[^/]*(19|20)[0-9][0-9]/")).select("id", "filed_path").distinct()
    lv = texts.library_levels(F.col("filed_path"))
    return p.select("id", F.coalesce(lv["artist"], F.lit("")).alias("parent"), lv["show"].alias("leaf"))


@query("SRC-6", "SRC-5", sql="select show_id, min(doc_id) as doc_id, arg_min(artist_norm, doc_id) as artist_norm from documents where show_id is not null and artist_norm is not null group by show_id")
def first_text_per_show(spark: SparkSession, d: str) -> DataFrame:
    """The first text of a show that has an artist: one is read, not all."""
    t = table(spark, d, "documents").filter("show_id is not null and artist_norm is not null").groupBy("show_id").agg(F.min_by(F.struct("doc_id", "artist_norm"), "doc_id").alias("m"))
    return t.select("show_id", "m.doc_id", "m.artist_norm")


@query("SRC-7")
def decoded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts stored as UTF-8 and UTF-16 bytes, read back: the same texts, without NULs and with their HTML as lines."""
    t = table(spark, d, "documents").select("doc_id", "text")
    b = t.select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-16LE")).otherwise(F.encode("text", "UTF-8")).alias("content"))
    want = html_lines(F.regexp_replace("text", "^\\ufeff|\\x00", ""))
    return b.select("doc_id", texts.decoded(F.col("content")).eqNullSafe(want).alias("same"))


@query("SRC-10", "SRC-24", "SNK-6", sql="""with k as (select regexp_replace(regexp_replace(strip_accents(lower(name)), '^\\s*(saint|st)[\\s.-]+', 'st'), '[^a-z0-9]', '', 'g') as key, * from places)
 select key, cc, admin, pop, cast(gid as varchar) as gid from (select *, row_number() over (partition by key order by pop desc, gid) as r from k) where r = 1""")
def gazetteer_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The most populous place of every folded name, written as a compressed table and read again."""
    best = places.best_per_name(table(spark, d, "places")).select("key", "cc", "admin", "pop", F.col("gid").cast("string").alias("gid"))
    path = f"{shared_folder(spark)}/gazetteer-{uuid.uuid4().hex}"
    texts.write_gazetteer(best, path)
    return texts.gazetteer(spark, path)


@query("SRC-11", sql="select alias, min(code) as code from (select code, unnest(list_distinct(list_concat([name], coalesce(aliases, [])))) as alias from countries) group by alias")
def alias_codes(spark: SparkSession, d: str) -> DataFrame:
    """Countries' codes by alias."""
    return texts.country_aliases(table(spark, d, "countries"))


@query("SRC-12", "SRC-14", "T-5", sql="select distinct id, indexer, release_id, data.artist as artist, data.added as added from releases where data.added >= '2015-01-01'")
def paged_index(spark: SparkSession, d: str) -> DataFrame:
    """All documents added since a day, read page by page through the data source; repeated ones once."""
    spark.dataSource.register(paged.PagedIndex)
    return spark.read.format("paged_index").option("path", f"{d}/releases.parquet").option("since", "2015-01-01").option("rows", 500).load().dropDuplicates(["id", "release_id"])


@query("SRC-15")
def item_replies(spark: SparkSession, d: str) -> DataFrame:
    """Items' replies as shows."""
    t = show_tracks(spark, d).groupBy("show_id").agg(F.collect_list(F.struct(F.concat("sk", F.lit(".flac")).alias("name"), F.lit("Flac").alias("format"), "title", F.col("track_no").cast("string").alias("track"))).alias("files"))
    s = show_fields(spark, d).dropDuplicates(["show_id"]).join(t, "show_id")
    reply = F.to_json(F.struct(F.struct(F.col("artist").alias("creator"), "date", F.concat_ws(", ", "venue", "city", "state").alias("coverage"), F.col("source_type").alias("source")).alias("metadata"), "files"))
    got = replies.item_show(s.select("show_id", reply.alias("reply")), "show_id", "reply")
    return got.select("show_id", "artist", "date", "venue", "city", "state", "source_type", F.size("titles").alias("titles"))


@query("SRC-16", "X-46", sql=f"""with t as (select *, dense_rank() over (partition by show_id order by part_no, coalesce(set_no, 1)) as nth from ({P1_TRACKS_SQL})), g as (select * from t where trim(title) <> '')
 select g.show_id, s.artist, case when regexp_matches(s.date, '^[0-9]{{{{4}}}}-[0-9][0-9]-[0-9][0-9]$') then strftime(try_cast(s.date as date), '%Y-%m-%d') end as date, row_number() over (partition by g.show_id order by g.nth, g.track_no) as num, trim(g.title) as title, g.nth as set_no, coalesce(g.segue, false) as segue
 from g join {{SHOWS}} s on s.show_id = g.show_id""".replace("{{4}}", "{4}"))
def setlist_replies(spark: SparkSession, d: str) -> DataFrame:
    """Setlists' replies as songs."""
    t = show_tracks(spark, d)
    sets = t.groupBy("show_id", F.struct("part_no", F.coalesce("set_no", F.lit(1)).alias("set_no")).alias("s")).agg(F.transform(F.array_sort(F.collect_list(F.struct("track_no", F.col("title").alias("name"), F.coalesce("segue", F.lit(False)).alias("segue")))), lambda x: F.struct(x["name"].alias("name"), x["segue"].alias("segue"))).alias("song"))
    all_sets = sets.groupBy("show_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "song"))), lambda x: F.struct(x["song"].alias("song"))).alias("set"))
    s = show_fields(spark, d).dropDuplicates(["show_id"]).join(all_sets, "show_id")
    reply = F.to_json(F.struct(F.struct(F.col("artist").alias("name")).alias("artist"), F.date_format(F.when(F.col("date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date("date")), "dd-MM-yyyy").alias("eventDate"), F.struct("set").alias("sets")))
    return replies.setlist_songs(s.select("show_id", reply.alias("reply")), "show_id", "reply").select("show_id", "artist", "date", "num", "title", "set_no", "segue")


@query("SRC-18", sql="select artist_norm, list_filter(['live', 'rock', 'folk'], lambda g: g <> 'live')[1] as genre, count(*) as n from song_titles group by artist_norm")
def first_allowed(spark: SparkSession, d: str) -> DataFrame:
    """The first of a list that is not blocked."""
    genre = F.get(F.filter(F.array(F.lit("live"), F.lit("rock"), F.lit("folk")), lambda g: g != "live"), F.lit(0))
    return table(spark, d, "song_titles").groupBy("artist_norm").agg(F.count("*").alias("n")).select("artist_norm", genre.alias("genre"), "n")


@query("SRC-20", "SRC-21", "X-52")
def torrent_files(spark: SparkSession, d: str) -> DataFrame:
    """Torrent files' hashes and names; malformed ones keep their error."""
    info = F.concat(F.lit("d4:name"), F.length("release_id"), F.lit(":"), F.col("release_id"), F.lit("e"))
    r = release_fields(spark, d).select("id", info.alias("info"), F.when(F.col("id") % 50 != 0, F.concat(F.lit("d4:info"), info, F.lit("e"))).otherwise(F.lit("<html>")).cast("binary").alias("content"))
    t = texts.torrents(r)
    return t.select("id", "hash", "name", "error", (F.col("hash") == F.sha1("info")).alias("right"))


@query("SRC-23", "R-25", "F-19", sql="select show_id, count(*) as files, cast(sum(n_chars) as bigint) as size, sum(n_chars) > 8000 as too_large, count(*) > 4 as too_many from documents where show_id is not null group by show_id")
def refused_archives(spark: SparkSession, d: str) -> DataFrame:
    """Groups of files beyond a number or a size."""
    return table(spark, d, "documents").filter("show_id is not null").groupBy("show_id").agg(F.count("*").alias("files"), F.sum("n_chars").alias("size")).select("show_id", "files", "size", (F.col("size") > 8000).alias("too_large"), (F.col("files") > 4).alias("too_many"))


@query("SRC-22", "A-19", sql="select user_id, event_type, round(avg(value), 6) as level, min(value) as least from events group by all")
def probed_levels(spark: SparkSession, d: str) -> DataFrame:
    """Measurements of files, taken beforehand, as a table by user and kind."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("level"), F.min("value").alias("least"))


@query("SRC-26", "J-2", sql="select id, name, norm from monitored_artists where monitored = 1")
def table_read(spark: SparkSession, d: str) -> DataFrame:
    """A filtered read of named columns; both reach the scan."""
    return table(spark, d, "monitored_artists").filter("monitored = 1").select("id", "name", "norm")


@query("SNK-3", "W-11", sql="""with p as (select artist_norm, confirmed as disc, rid, title from song_titles), d as (select artist_norm, count(distinct disc) as disctotal from p group by 1)
 select p.artist_norm, p.disc, p.rid, row_number() over (partition by p.artist_norm, p.disc order by rid) as tracknumber, count(*) over (partition by p.artist_norm, p.disc) as tracktotal, d.disctotal from p join d on d.artist_norm = p.artist_norm""")
def tag_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers and totals that begin again on every disc."""
    p = table(spark, d, "song_titles").select("artist_norm", F.col("confirmed").alias("disc"), "rid")
    return sinks.tag_rows(p, "artist_norm", "disc", "rid")


@query("SNK-5", "SNK-7", sql="select show_id, artist, date from {SHOWS}")
def audit_export(spark: SparkSession, d: str) -> DataFrame:
    """Shows exported as JSON and read again."""
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    sinks.export_json(show_fields(spark, d).select("show_id", "artist", "date"), path)
    return spark.read.schema("show_id long, artist string, date string").json(path)


@query("SNK-9", "T-7", sql="select distinct artist from {RELEASES} where artist is not null")
def import_ledger(spark: SparkSession, d: str) -> DataFrame:
    """A ledger to which a batch is given twice: every key stands in it once."""
    path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    keys = release_fields(spark, d).filter("artist is not null").select("artist")
    for _ in range(2):
        sinks.append_new(keys, path, "artist")
    return spark.read.parquet(path)


@query("SNK-10", sql="with f as (select show_id, doc_id, kind || '.jpg' as name, lang is null as embedded, case when lang is null then 0 when kind = 'info' then 2 else 2 end as place from documents where show_id is not null) select show_id, arg_min(name, {'p': place, 'n': name}) as name from f group by show_id")
def cover_choice(spark: SparkSession, d: str) -> DataFrame:
    """The picture to use."""
    f = table(spark, d, "documents").filter("show_id is not null").select("show_id", F.concat("kind", F.lit(".jpg")).alias("name"), F.col("lang").isNull().alias("embedded"))
    return sinks.pick_cover(f, "show_id")


QUERIES, ORACLE, COVERS = family.queries, family.oracle, family.covers
