"""Files' bytes to text and records: encodings, torrents, tables of places."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeloom.functions.text import html_lines

#: Nesting and size beyond which a torrent file is refused.
MOST_DEPTH, MOST_BYTES = 64, 20 << 20


def decoded(content: Column) -> Column:
    """SRC-7: bytes as text: UTF-16 by its mark or by zeros in every other byte (a quarter of the first 200 bytes), else UTF-8 with bad bytes replaced; no NULs; HTML as lines."""
    head, long = F.hex(F.substring(content, 1, 8)), F.hex(F.substring(content, 1, 200))
    zeros = lambda byte: F.length(F.regexp_replace(F.regexp_replace(long, byte, "$1"), "(00)|..", "$1"))
    first, second = zeros("(..)(?:..)?"), zeros("..(..)?")
    dense = (4 * (first + second) > F.length(long)) & (F.octet_length(content) > 8) & (F.octet_length(content) % 2 == 0)
    le = F.startswith(head, F.lit("FFFE")) | head.rlike("^(?:..00){3,}") | (dense & (second > first))
    be = F.startswith(head, F.lit("FEFF")) | head.rlike("^(?:00..){3,}") | (dense & (first > second))
    text = F.when(le, F.decode(content, "UTF-16LE")).when(be, F.decode(content, "UTF-16BE")).otherwise(F.make_valid_utf8(content.cast("string")))
    return html_lines(F.regexp_replace(text, "^﻿|\\x00", ""))


class Damaged(ValueError):
    """Bytes that are no well-formed torrent."""


_TOKEN = re.compile(rb"i(?P<int>-?\d+)e|(?P<size>\d+):|(?P<open>[ld])|(?P<close>e)")


def bdecode(data: bytes) -> tuple[object, dict[bytes, tuple[int, int]]]:
    """SRC-21: the bencoded value that ``data`` begins with, and where the values of its outermost dictionary stand.

    One pass over the tokens with a stack of the lists and dictionaries that are open. Raises Damaged for anything
    malformed, cut short or nested too deep; bytes behind the value are left alone.
    """
    opened: list[tuple[bool, list, int]] = []  # is it a dictionary, what it holds so far, where it began
    spans: dict[bytes, tuple[int, int]] = {}
    at = 0
    while token := _TOKEN.match(data, at):
        begin, at = at, token.end()
        if token["open"]:
            if len(opened) == MOST_DEPTH:
                raise Damaged("too deep")
            opened.append((token["open"] == b"d", [], begin))
            continue
        if token["close"]:
            if not opened:
                raise Damaged("nothing to close")
            is_map, held, begin = opened.pop()
            if is_map and len(held) % 2:
                raise Damaged("key without value")
            value = dict(zip(held[::2], held[1::2])) if is_map else held
        elif token["int"]:
            value = int(token["int"])
        else:
            end = at + int(token["size"])
            if end > len(data):
                raise Damaged("cut short")
            value, at = data[at:end], end
        if not opened:
            return value, spans
        is_map, held, _ = opened[-1]
        if is_map and len(held) % 2 == 0 and not isinstance(value, bytes):
            raise Damaged("key is no text")
        if is_map and len(opened) == 1 and len(held) % 2:
            spans[held[-1]] = begin, at
        held.append(value)
    raise Damaged("cut short" if at >= len(data) else f"no value at byte {at}")


def torrent(data: bytes | None) -> tuple[str | None, str | None, str | None]:
    """(hash, name, error) of a torrent file. The hash is of the info dictionary's own bytes."""
    if not data or len(data) > MOST_BYTES:
        return None, None, "no torrent"
    try:
        value, spans = bdecode(data)
    except ValueError as e:  # also a number of too many digits
        return None, None, str(e)
    info = value.get(b"info") if isinstance(value, dict) else None
    if not isinstance(info, dict):
        return None, None, "no info"
    name = info.get(b"name", b"")
    return hashlib.sha1(data[slice(*spans[b"info"])]).hexdigest(), name.decode("utf-8", "replace") if isinstance(name, bytes) else "", None  # noqa: S324


def torrents(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds hash, name and error for every row's bytes; batches of bytes go to Python, nothing else does."""

    @F.pandas_udf("hash string, name string, error string")
    def read(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([torrent(None if d is None else bytes(d)) for d in data], columns=["hash", "name", "error"])

    return df.withColumn("__t", read(content)).select(*df.columns, "__t.*")


def listing(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """SRC-1: path, name, parent, length and time of all files under a folder. The content is not read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    f = (r.option("pathGlobFilter", glob) if glob else r).load(folder)
    parts = F.split("path", "/")
    return f.select("path", F.element_at(parts, -1).alias("name"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("parent"), "length", "modificationTime")


def newest_by_folder(files: DataFrame) -> DataFrame:
    """SRC-2, SRC-4: per folder that holds files, their number, bytes and the newest time."""
    return files.groupBy("parent").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest"))


def library_levels(path: Column) -> Column:
    """SRC-3: (artist, show) of a library's path; a level that ends in a year without a date is passed over."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.rlike(r"(?<!\d)(19|20)\d\d$") | p.rlike(r"(19|20)\d\d[-.]\d\d"))
    return F.struct(F.try_element_at(parts, F.lit(-2)).alias("artist"), F.try_element_at(parts, F.lit(-1)).alias("show"))


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: a table of places: key, cc, admin, pop, gid, by tabs, with # for comments; compressed or not."""
    return spark.read.csv(path, sep="\t", comment="#", schema="key string, cc string, admin string, pop long, gid string")


def write_gazetteer(places: DataFrame, path: str) -> None:
    """SNK-6: the same, compressed."""
    places.select("key", "cc", "admin", "pop", "gid").write.mode("overwrite").csv(path, sep="\t", compression="gzip")


def country_aliases(countries: DataFrame) -> DataFrame:
    """SRC-11: alias and code; of countries that share an alias the first code."""
    a = countries.select("code", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("alias"))
    return a.groupBy("alias").agg(F.min("code").alias("code"))
