"""Queries of problem 1: the nested show records as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.operators import shows


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every track of every show, by its place: show_id, part_no, track_no."""
    return shows.track_rows(shows.documents(spark, sf_dir), shows.inferred(spark, sf_dir)).select("show_id", "part_no", "track_no")


def p1_shows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root table: one row per show with valid meta."""
    return shows.show_rows(shows.documents(spark, sf_dir))


def p1_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts table; parent_sk is the show's sk."""
    return shows.part_rows(shows.documents(spark, sf_dir), shows.inferred(spark, sf_dir))


def p1_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks table; parent_sk is the sk of the show or of the part."""
    return shows.track_rows(shows.documents(spark, sf_dir), shows.inferred(spark, sf_dir))


def p1_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields for which the tables of shows, parts and tracks have no column; sk is the row's there."""
    return shows.other_fields(shows.documents(spark, sf_dir), shows.inferred(spark, sf_dir))


def p1_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of every list that the metas hold, whatever its name, with the parent's key and the ordinal."""
    return shows.list_rows(shows.documents(spark, sf_dir), shows.inferred(spark, sf_dir))


def p1_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of child tables without their parent, by level: always none; kept as a check of the links."""
    docs, levels = shows.documents(spark, sf_dir), shows.inferred(spark, sf_dir)
    rows = shows.list_rows(docs, levels)
    parents = shows.show_rows(docs).select("sk").unionByName(rows.select("sk"))
    return rows.select("parent_sk", "level").join(parents, F.col("parent_sk") == F.col("sk"), "left_anti")


_NAMED = "len(list_filter(json_keys(v), lambda k: not regexp_matches(k, '^[0-9]{1,18}$'))) = 0"


def _items_sql(source: str) -> str:
    """The entries of the lists in ``source`` (id, part_no, v), whatever their stored form."""
    read = f"(select id, part_no, case when json_type(w) = 'VARCHAR' and json_valid(w->>'$') then cast(w->>'$' as json) else w end as v from {source})"
    return f"""(select id, part_no, cast(i + 1 as bigint) as ord, json_extract(v, '$[' || i || ']') as item from (select id, part_no, v, unnest(range(cast(json_array_length(v) as bigint))) as i from {read} where json_type(v) = 'ARRAY')
 union all select id, part_no, cast(k as bigint), json_extract(v, '$."' || k || '"') from (select id, part_no, v, unnest(json_keys(v)) as k from {read} where json_type(v) = 'OBJECT' and {_NAMED})
 union all select id, part_no, cast(1 as bigint), v from {read} where json_type(v) = 'OBJECT' and not ({_NAMED}))"""


_PARTS_SQL = _items_sql("(select id, 0 as part_no, meta->'$.parts' as w from s)")
P1_SQL = f"""with s as (select distinct id, meta from shows where json_valid(meta) and json_type(meta) = 'OBJECT'), p as (select * from {_PARTS_SQL}),
 l as (select id, cast(0 as bigint) as part_no, meta->'$.tracks' as w from s union all select id, ord, item->'$.tracks' from p where json_type(item) = 'OBJECT')
 select id as show_id, part_no, ord as track_no from {_items_sql("l")} where json_type(item) in ('OBJECT', 'VARCHAR')"""
_SCALARS = ", ".join(f"case when json_type(meta->'$.{f}') not in ('OBJECT', 'ARRAY', 'NULL') then meta->>'$.{f}' end as {f}" for f in shows.SHOW_FIELDS)
_TEXT = "case when json_type({0}->'$.{1}') not in ('OBJECT', 'ARRAY', 'NULL') then {0}->>'$.{1}' end"
_WHOLE = "try_cast(nullif(regexp_extract(" + _TEXT + ", '^\\s*([-+]?[0-9]+)\\s*$', 1), '') as bigint)"
P1_PARTS_SQL = f"""with s as (select distinct id, meta from shows where json_valid(meta) and json_type(meta) = 'OBJECT'), p as (select * from {_PARTS_SQL})
 select id as show_id, ord as part_no, cast(id as varchar) as parent_sk, id || '/parts:' || ord as sk, {_TEXT.format("item", "dir")} as dir, {_WHOLE.format("item", "disc")} as disc,
 {_TEXT.format("item", "label")} as label, {_TEXT.format("item", "bracket")} as bracket from p where coalesce(json_type(item), 'NULL') <> 'NULL'"""
_FLAG = f"lower(trim({_TEXT.format('item', 'segue')}))"
P1_TRACKS_SQL = P1_SQL.replace(
    "select id as show_id, part_no, ord as track_no from",
    f"""select id as show_id, part_no, ord as track_no, case when part_no = 0 then cast(id as varchar) else id || '/parts:' || part_no end as parent_sk,
 case when part_no = 0 then cast(id as varchar) else id || '/parts:' || part_no end || '/tracks:' || ord as sk, {_WHOLE.format("item", "num")} as num,
 case when json_type(item) = 'VARCHAR' then item->>'$' else {_TEXT.format("item", "title")} end as title, {_WHOLE.format("item", "disc")} as disc, {_WHOLE.format("item", "set")} as set_no,
 case when {_FLAG} in ('true', '1', 'yes') then true when {_FLAG} in ('false', '0', 'no', '') then false end as segue from""",
)
ORACLE = {
    "p1_found": P1_SQL,
    "p1_parts": P1_PARTS_SQL,
    "p1_tracks": P1_TRACKS_SQL,
    "p1_shows": f"select id as show_id, cast(id as varchar) as sk, {_SCALARS} from (select distinct id, folder_name, meta from shows where json_valid(meta) and json_type(meta) = 'OBJECT')",
    "p1_orphans": "select 'x' as parent_sk, 'x' as level where false",
}
QUERIES = {q.__name__: q for q in (p1_found, p1_shows, p1_parts, p1_tracks, p1_others, p1_lists, p1_orphans)}
