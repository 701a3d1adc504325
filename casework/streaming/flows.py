"""Documents and log entries that keep arriving, as Structured Streaming jobs.

Seen urls and documents are keyed state; extraction is stateless. What depends on a whole case is kept
as partial sums that a batch adds to (``summaries``), or recomputed for the cases that a batch touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casework.operators.dossier import SEVERITY


def fresh_documents(stream: DataFrame, time: str = "arrived_at", delay: str = "1 day") -> DataFrame:
    """Documents of a stream whose url was not seen within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["source_url"])


#: Keyed state on the executors' disks, written as changes: what a batch costs doesn't depend on how many keys there are.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_rocksdb(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Starts a query whose state is kept in RocksDB; the session's own setting stays as it was."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        return start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def analyse_on_arrival(stream: DataFrame, extract: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "document_id") -> StreamingQuery:
    """Writes what ``extract`` finds in each new document below path/found; documents that were seen are skipped.

    The keys of all documents, also of those in which nothing was found, are keyed state of the
    query, kept with its checkpoint: a batch looks up its own keys alone and reads nothing of what
    came before. One row of each key is taken. Each batch has a folder of its own and overwrites it,
    and takes the state that it had, so that one that runs again after a failure adds nothing twice.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        extract(df).write.mode("overwrite").parquet(f"{path}/found/batch={number}")

    extract(spark.createDataFrame([], stream.schema)).write.mode("ignore").parquet(f"{path}/found/batch=-1")
    fresh = stream.dropDuplicates([key])
    return _with_rocksdb(spark, lambda: fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def found(spark: SparkSession, path: str) -> DataFrame:
    """What ``analyse_on_arrival`` has found so far."""
    return spark.read.parquet(f"{path}/found").drop("batch")


def recompile_touched(stream: DataFrame, compile_cases: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Recompiles the cases that each batch touches; one folder a case, overwritten alone."""

    def batch(df: DataFrame, number: int) -> None:
        touched = df.select("case_id").distinct()
        compile_cases(touched).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_feed(stream: DataFrame, window: str = "12 seconds", delay: str = "1 minute") -> DataFrame:
    """Counts of log entries by window and severity."""
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    named = stream.withColumn("severity", F.coalesce(severity[F.col("event_type")], F.lit("info")))
    return named.withWatermark("created_at", delay).groupBy(F.window("created_at", window), "severity").agg(F.count("*").alias("n"))
