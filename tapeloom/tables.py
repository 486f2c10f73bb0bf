"""Reading the catalogue's tables, and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder, a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Rows repeated whole, counted once.

    Tables of this catalogue repeat a row with its key, so the key decides which rows can be
    copies; the rows themselves decide which are. Pass only the columns that are needed, else
    wide columns are shuffled for nothing.
    """
    return df.dropDuplicates(list(keys) or df.columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a local one where it is unset.

    A machine's own temporary folder is only ever used in local mode; on a cluster a missing
    setting is an error, since other machines could not read what is written there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tapeloom-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name, on whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage ends there.

    A lost executor costs only a re-read, and a plan that uses the result more than once does not
    compute it again. Columnar files are smaller than what ``checkpoint()`` serialises.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
