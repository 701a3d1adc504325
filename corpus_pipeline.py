"""A training corpus from raw documents, in five stages, each one operator of ``casework.llm``.

``STAGES`` lists them; each takes (spark, docs, sf_dir) and is given what its predecessor kept,
written as Parquet and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm import mixing, neardup, packing, pii, quality
from casework.llm.common import free_name, save, small_batches
from casework.llm.queries import table, vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    small_batches(spark)
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    found = free_name(docs, "found")
    return quality.classify(docs, weights, F.col("source"), F.col("lang"), out=found).filter(F.col(found)["kept"]).drop(found)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates at five words and a similarity of 0.8: one document of each class stays."""
    small_batches(spark)
    return neardup.deduplicate(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data: every span of every text becomes its kind in brackets."""
    small_batches(spark)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as the mix takes it."""
    small_batches(spark)
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the place of every piece of every document in the training sequences."""
    small_batches(spark)
    return packing.pack(docs, vocabulary(), keep_ids=False).drop("ids")


STAGES = [
    ("quality", keep_good),
    ("near_dedup", drop_near_duplicates),
    ("pii", remove_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenizers, redaction and classifiers are not SQL; tests/llm/test_pipeline.py has the brute-force checks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = save(docs)
    return docs
