"""Sinks: exports, appended ledgers, rows to be written as tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tapeloom.tables import cut, exists


def export_json(df: DataFrame, path: str) -> None:
    """SNK-5, SNK-7: rows as JSON lines; Spark's commit makes the whole output appear at once."""
    df.write.mode("overwrite").json(path)


def append_new(df: DataFrame, ledger: str, key: str) -> DataFrame:
    """SNK-9, T-7: appends the keys that the ledger has not, and returns them. Repeated keys go in once.

    The ledger is a Parquet folder. A batch that is replayed finds its keys there and appends nothing.
    """
    new = df.select(key).distinct()
    if exists(df.sparkSession, f"{ledger}/_SUCCESS"):
        new = new.join(df.sparkSession.read.parquet(ledger), key, "left_anti")
    new = cut(new)
    new.write.mode("append").parquet(ledger)
    return new


def tag_rows(tracks: DataFrame, key: str, disc: str, order: str) -> DataFrame:
    """SNK-3: the tags of every track: its number on its disc, the disc's total and the discs' total."""
    w = W.partitionBy(key, disc)
    t = tracks.withColumn("tracknumber", F.row_number().over(w.orderBy(order)).cast("long")).withColumn("tracktotal", F.count("*").over(w))
    discs = tracks.groupBy(key).agg(F.count_distinct(disc).alias("disctotal"))
    return t.join(discs, key)


def pick_cover(files: DataFrame, key: str) -> DataFrame:
    """SNK-10: per key the picture to use: an embedded one first, else the file called cover, folder or front, else the first."""
    place = F.when(F.col("embedded"), 0).when(F.lower("name").rlike("^(cover|folder|front)[.]"), 1).otherwise(2)
    return files.groupBy(key).agg(F.min(F.struct(place.alias("place"), "name")).alias("m")).select(key, "m.name")
