"""Session helpers: the folder all executors share, table reads, row order."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of intermediate tables by session, so that a later query can remove what an earlier one has left.
_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session may do without: it gets a temporary one, removed at exit."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="leadloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{path}")
    return f"file://{path}"


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: losing an executor can't lose it, and later stages don't repeat it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut/{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_cuts() -> None:
    """Remove all tables written by cut_lineage so far. Frames that read them can't be used any more."""
    while _MADE:
        _remove(*_MADE.pop())


atexit.register(clear_cuts)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one, removed with the intermediate tables."""
    path = f"{shared_dir(spark)}/cut/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blank_to_null(c):
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))
