"""Replies of catalogue services as rows: setlists and items, nested JSON flattened with the parents' keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tapeloom.functions import parse

SETLIST = """artist struct<name:string>, eventDate string, venue struct<name:string, city:struct<name:string, stateCode:string, country:struct<code:string>>>,
 sets struct<`set`:array<struct<encore:int, song:array<struct<name:string, segue:boolean>>>>>"""
ITEM = "metadata struct<creator:string, date:string, venue:string, coverage:string, source:string>, files array<struct<name:string, format:string, title:string, track:string>>"


def setlist_songs(replies: DataFrame, key: str, reply: str) -> DataFrame:
    """SRC-16: key, artist, date (ISO), venue, city, num, title, disc (99 for encores), set_no, segue.

    Blank names are no songs and take no number. A reply that is no JSON, or without songs, gives no rows.
    """
    r = replies.select(key, F.from_json(reply, SETLIST).alias("r"))
    s = r.select(key, "r", F.posexplode("r.sets.set").alias("s", "set"))
    g = s.select(key, "r", "s", F.col("set.encore").alias("encore"), F.posexplode("set.song").alias("k", "song")).filter("trim(song.name) <> ''")
    num = F.row_number().over(W.partitionBy(key).orderBy("s", "k")).cast("long")
    return g.select(
        key,
        F.col("r.artist.name").alias("artist"),
        F.date_format(F.try_to_date("r.eventDate", "dd-MM-yyyy"), "yyyy-MM-dd").alias("date"),
        F.col("r.venue.name").alias("venue"),
        F.col("r.venue.city.name").alias("city"),
        num.alias("num"),
        F.trim("song.name").alias("title"),
        F.when(F.coalesce("encore", F.lit(0)) > 0, 99).otherwise(1).alias("disc"),
        (F.col("s") + 1).cast("long").alias("set_no"),
        F.coalesce("song.segue", F.lit(False)).alias("segue"),
    )


def item_show(items: DataFrame, key: str, reply: str) -> DataFrame:
    """SRC-15: key, artist, date, venue, city, state, source_type and the titles of the audio files: by track, each stem once, untitled ones out."""
    r = items.select(key, F.from_json(reply, ITEM).alias("r"))
    place = F.transform(F.split("r.metadata.coverage", ","), lambda p: F.trim(p))
    n = F.size(place)
    own = F.nullif(F.trim("r.metadata.venue"), F.lit(""))
    audio = F.filter("r.files", lambda f: F.lower(f["format"]).isin("flac", "vbr mp3", "mp3", "ogg vorbis", "shorten") & (F.trim(F.coalesce(f["title"], F.lit(""))) != ""))
    listed = F.array_sort(F.transform(audio, lambda f: F.struct(F.lpad(F.coalesce(f["track"], F.lit("99")), 4, "0").alias("t"), f["name"].alias("name"), f["title"].alias("title"), F.regexp_replace(f["name"], r"\.\w+$", "").alias("stem"))))
    stems = F.transform(listed, lambda f: f["stem"])
    once = F.filter(listed, lambda f, i: F.array_position(stems, f["stem"]) == i + 1)
    return r.select(
        key,
        F.col("r.metadata.creator").alias("artist"),
        parse.extract_date(F.col("r.metadata.date")).alias("date"),
        F.coalesce(own, F.when(n >= 3, F.get(place, F.lit(0)))).alias("venue"),
        F.when(n >= 3, F.when(own.isNull(), F.get(place, F.lit(1))).otherwise(F.get(place, F.lit(0)))).otherwise(F.get(place, F.lit(0))).alias("city"),
        F.when(n >= 2, F.element_at(place, -1)).alias("state"),
        parse.source_type(F.col("r.metadata.source")).alias("source_type"),
        F.transform(once, lambda f: f["title"]).alias("titles"),
    )
