"""Views of the tables that the queries share.

A row repeated whole has the key of the one that it repeats, so copies are dropped by the key, after the projection:
what a query does not ask for is neither parsed nor shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.operators import nested, shows
from tapeloom.tables import table

_RELEASE_FIELDS = ("artist", "title", "date", "venue", "location", "source_type", "owned", "downloads", "added")


def show_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every show with valid meta once: show_id, folder_name, status, confidence and the meta's scalar fields."""
    docs = nested.parse_documents(table(spark, sf_dir, "shows"), "meta").filter("doc is not null")
    fields = [nested.text_of(F.col("doc"), f).alias(f) for f in shows.SHOW_FIELDS]
    return docs.select(F.col("id").alias("show_id"), "folder_name", "status", "confidence", *fields).dropDuplicates(["show_id"])


def release_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every release once, with the data's scalar fields beside the row's."""
    r = table(spark, sf_dir, "releases")
    return r.select("id", "indexer", "release_id", "artist_id", *[F.col(f"data.{f}").alias(f) for f in _RELEASE_FIELDS], "status", "reason", "first_seen", "updated_at").dropDuplicates(["id"])


def show_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks of all shows."""
    return shows.track_rows(shows.documents(spark, sf_dir))
