"""The flat tables inside ``shows.meta``: shows, parts and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.operators import nested
from tapeloom.tables import table, whole_rows

# The lists and the fields of a show, its parts and their tracks.
LEVELS = (nested.Level(("tracks",)), nested.Level(("parts",), (nested.Level(("tracks",)),)))
PART_FIELDS = ("dir", "disc", "label", "bracket")
TRACK_FIELDS = ("num", "title", "disc", "set", "segue")
SHOW_FIELDS = ("artist", "host_artist", "date", "venue", "city", "state", "source_type", "official", "shnid", "recorder", "genre", "notes")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, folder_name and the parsed meta of every show once."""
    df = whole_rows(table(spark, sf_dir, "shows").select("id", "folder_name", "meta"), "id", "folder_name", "meta")
    return nested.parse_documents(df, "meta").filter(F.schema_of_variant("doc").startswith("OBJECT"))


def inferred(spark: SparkSession, sf_dir: str) -> tuple[nested.Level, ...]:
    """The lists that the metas hold, inferred from all of them; copies of a row tell nothing new and are left in."""
    return nested.infer_levels(nested.parse_documents(table(spark, sf_dir, "shows").select("meta"), "meta").filter(F.schema_of_variant("doc").startswith("OBJECT")), known=LEVELS)


def _tables(docs: DataFrame, levels: tuple[nested.Level, ...]) -> dict[str, DataFrame]:
    """The tables of these levels; one that the metas do not have is empty."""
    tables = nested.flatten(docs, "id", levels=levels)
    for name in nested.level_names(LEVELS):
        tables.setdefault(name, tables[""].filter(F.lit(False)).select("id", F.col("sk").alias("parent_sk"), F.lit(0).cast("long").alias("ordinal"), "doc", "sk"))
    return tables


def show_rows(docs: DataFrame) -> DataFrame:
    """One row per show with valid meta: its scalar fields as text."""
    return docs.select(F.col("id").alias("show_id"), F.col("id").cast("string").alias("sk"), *[nested.text_of(F.col("doc"), f).alias(f) for f in SHOW_FIELDS])


def fields(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """show_id and some scalar fields of every show with valid meta once; only they are shuffled, not the documents."""
    docs = nested.parse_documents(table(spark, sf_dir, "shows").select("id", "meta"), "meta").filter(F.schema_of_variant("doc").startswith("OBJECT"))
    return docs.select(F.col("id").alias("show_id"), *[nested.text_of(F.col("doc"), f).alias(f) for f in names]).distinct()


def part_rows(docs: DataFrame, levels: tuple[nested.Level, ...] = LEVELS) -> DataFrame:
    """One row per part, with its place in the show's list."""
    parts = _tables(docs, levels)["parts"]
    return parts.select(
        F.col("id").alias("show_id"),
        F.col("ordinal").alias("part_no"),
        "parent_sk",
        "sk",
        nested.text_of(F.col("doc"), "dir").alias("dir"),
        nested.whole_of(F.col("doc"), "disc").alias("disc"),
        nested.text_of(F.col("doc"), "label").alias("label"),
        nested.text_of(F.col("doc"), "bracket").alias("bracket"),
    )


def track_rows(docs: DataFrame, levels: tuple[nested.Level, ...] = LEVELS) -> DataFrame:
    """One row per track of a show (part_no 0) or of its k-th part (part_no k).

    A track is an object or a bare title; other items of a list are none.
    """
    tables = _tables(docs, levels)
    own = tables["tracks"].withColumn("part_no", F.lit(0).cast("long"))
    inner = tables["parts.tracks"].withColumn("part_no", F.regexp_extract("parent_sk", r"parts:([0-9]+)$", 1).cast("long"))
    doc, kind = F.col("doc"), F.schema_of_variant("doc")
    return (
        own.unionByName(inner)
        .filter(kind.startswith("OBJECT") | (kind == "STRING"))
        .select(
            F.col("id").alias("show_id"),
            "part_no",
            F.col("ordinal").alias("track_no"),
            "parent_sk",
            "sk",
            nested.whole_of(doc, "num").alias("num"),
            F.when(kind == "STRING", F.try_variant_get(doc, "$", "string")).otherwise(nested.text_of(doc, "title")).alias("title"),
            nested.whole_of(doc, "disc").alias("disc"),
            nested.whole_of(doc, "set").alias("set_no"),
            nested.flag_of(doc, "segue").alias("segue"),
        )
    )


def other_fields(docs: DataFrame, levels: tuple[nested.Level, ...] = LEVELS) -> DataFrame:
    """Every field of a show, a part or a track that the three tables have no column for, lists and objects included.

    show_id, level, sk (of the row that has the field), field and its value as JSON; nulls are no values.
    """
    tables = _tables(docs, levels)
    known = {"": (*SHOW_FIELDS, "tracks", "parts"), "parts": (*PART_FIELDS, "tracks"), "tracks": TRACK_FIELDS, "parts.tracks": TRACK_FIELDS}
    found = None
    for level, fields in known.items():
        pairs = F.explode(F.map_entries(F.try_variant_get(F.col("doc"), "$", "map<string,variant>"))).alias("e")
        rows = tables[level].filter(F.schema_of_variant("doc").startswith("OBJECT")).select(F.col("id").alias("show_id"), F.lit(level).alias("level"), "sk", pairs)
        rows = rows.filter(~F.col("e.key").isin(*fields) & ~nested.is_null_item(F.col("e.value"))).select("show_id", "level", "sk", F.col("e.key").alias("field"), F.to_json("e.value").alias("value"))
        found = rows if found is None else found.unionByName(rows)
    return found


def list_rows(docs: DataFrame, levels: tuple[nested.Level, ...]) -> DataFrame:
    """The rows of all child tables, one below the other: show_id, level, parent_sk, sk, ordinal and the item as JSON."""
    tables = nested.flatten(docs, "id", levels=levels)
    found = docs.select(F.col("id").alias("show_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("level", "string"), ("parent_sk", "string"), ("sk", "string"), ("ordinal", "long"), ("item", "string"))]).filter(F.lit(False))
    for name in nested.level_names(levels):
        found = found.unionByName(tables[name].select(F.col("id").alias("show_id"), F.lit(name).alias("level"), "parent_sk", "sk", "ordinal", F.to_json("doc").alias("item")))
    return found
