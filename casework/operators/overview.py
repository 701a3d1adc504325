"""Lists of a case's overview: its top documents, latest events, rating."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.functions.pages import is_usable
from casework.operators.ranking import case_of, top_by


def top_documents(documents: DataFrame, score: str, k: int = 10) -> DataFrame:
    """The k documents of each case with a title and the highest score."""
    return top_by(documents.filter(F.coalesce("title", F.lit("")) != ""), ["case_id"], [F.desc(score), "id"], k).select("case_id", "rank", "id", "title")


def overview_documents(documents: DataFrame, k: int = 8) -> DataFrame:
    """The k documents of each case with the highest score in their marker; 0 without one."""
    score = F.coalesce(F.regexp_extract("raw_text", r"score=(\d+)", 1).try_cast("int"), F.lit(0))
    return top_by(documents.withColumn("score", score), ["case_id"], [F.desc("score"), "id"], k).select("case_id", "rank", "id", "score")


def latest_events(timeline: DataFrame, k: int = 5) -> DataFrame:
    return top_by(timeline.filter("event_date is not null"), ["case_id"], [F.desc("event_date"), "id"], k).select("case_id", "rank", "id", "event_date")


def ratings(cases: DataFrame, entities: DataFrame, documents: DataFrame) -> DataFrame:
    """A rating of each case by its entities and usable documents, for cases without a stored one."""
    e = entities.groupBy(F.col("case_id").alias("id")).agg(F.count("*").alias("n_entities"))
    u = documents.groupBy(F.col("case_id").alias("id")).agg(F.count_if(is_usable(F.col("raw_text"))).alias("n_usable"))
    c = cases.select("id").join(e, "id", "left").join(u, "id", "left").fillna(0)
    n, d = F.col("n_entities"), F.col("n_usable")
    return c.withColumn("rating", case_of("EMPTY CASE", ((n >= 3) & (d >= 3), "STRONG BUILD"), ((n >= 1) & (d >= 1), "MODERATE BUILD"), (d >= 1, "LOW CONFIDENCE")))
