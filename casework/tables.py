"""Written tables that cut the lineage, and joins that broadcast only what was counted."""

from __future__ import annotations

import functools
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many narrow rows may be broadcast (about 32 MB).
BROADCAST_ROWS = 500_000

_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


@functools.lru_cache(1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="casework-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode without it, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def save(df: DataFrame) -> DataFrame:
    """Writes df below the shared folder and reads it again: cuts the lineage, survives lost executors.

    The files go with ``drop``, or when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/casework/{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _path(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def drop(*saved: DataFrame) -> None:
    """Deletes the files of tables that ``save`` gave, after their last reader has been written."""
    for df in saved:
        path = _PATHS.pop(df, None)
        if path:
            files, at = _path(df.sparkSession, path)
            files.delete(at, True)


def dealt(df: DataFrame, tasks_a_core: int = 4) -> DataFrame:
    """df in some tasks for each core, for work on its rows that is far larger than its files."""
    return df.repartition(tasks_a_core * df.sparkSession.sparkContext.defaultParallelism)


def look_up(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """big joined with small, a written table of narrow rows.

    Broadcasts small if it has at most max_rows rows; else a sort-merge join, of which
    adaptive execution splits the hot keys.
    """
    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("merge"), on, how)
