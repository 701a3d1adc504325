"""Dated events of documents: strict and soft ones, windows of years, incremental loads.

All take sentences (document_id, pos, sentence) of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.functions import text
from casework.functions.matching import found, has_some
from casework.operators.ranking import first_by, top_by

STRICT, SOFT = 15, 8
PROPER_NOUN = r"\b[A-Z][a-z]+\b"
PROGRAM = r"(?i)\b(?:program|project|initiative|fund|agency|department|office|authority|commission|bureau|administration|council)\b"


def _dated(sentences: DataFrame) -> DataFrame:
    """Sentences with a date, their type and summary.

    What a sentence names is a column before it is read again, and rows without a date go by an
    explode, which is not pushed down: each pattern is tried once a sentence.
    """
    s, my, md = F.col("sentence"), F.col("_month_year"), F.col("_month_day")
    d = sentences.withColumn("_month_year", text.month_year(s)).withColumn("_month_day", F.when(my == "", text.month_day(s)).otherwise(""))
    d = d.withColumn("event_date", F.explode(F.array_compact(F.array(text.date_from(s, my, md))))).drop("_month_year", "_month_day")
    summary = F.substring(F.regexp_replace(F.trim(s), r"\s+", " "), 1, 200)
    return d.withColumn("_low", F.lower(s)).withColumns({"event_type": text.event_type(F.col("_low")), "summary": summary}).drop("_low")


def _first(events: DataFrame, k: int) -> DataFrame:
    one = first_by(events.withColumn("start", F.substring("summary", 1, 60)), ["document_id", "event_date", "start"], ["pos"])
    return top_by(one, ["document_id"], ["pos"], k).select("document_id", "pos", "event_date", "event_type", "summary")


def strict_events(sentences: DataFrame, k: int = STRICT) -> DataFrame:
    """The first k sentences of each document with a date and an action, one for each date and start of the text."""
    return _first(_dated(sentences.filter(has_some(found(F.lower("sentence"), [text.ACTION])))), k)


def soft_events(sentences: DataFrame, strict: DataFrame, k: int = SOFT) -> DataFrame:
    """For documents without strict events: the first k sentences with a date and a name or a program's word."""
    open_ = sentences.join(strict.select("document_id").distinct(), "document_id", "left_anti")
    return _first(_dated(open_.filter(has_some(found(F.col("sentence"), [PROPER_NOUN, PROGRAM])))), k)


def all_events(sentences: DataFrame) -> DataFrame:
    strict = strict_events(sentences)
    return strict.withColumn("soft_event", F.lit(False)).unionByName(soft_events(sentences, strict).withColumn("soft_event", F.lit(True)))


def in_year_window(events: DataFrame, documents: DataFrame, years: int = 2) -> DataFrame:
    """Events within so many years of their document's (id, publish_date); those of undated documents stay."""
    d = documents.select(F.col("id").alias("document_id"), F.year("publish_date").alias("published"))
    kept = F.col("published").isNull() | (F.abs(F.year("event_date") - F.col("published")) <= years)
    return events.join(d, "document_id", "left").filter(kept).drop("published")


def anchored(events: DataFrame, words: Column) -> DataFrame:
    """Events whose summary has an action and one of the first eight anchor words (any, where there are none)."""
    first = F.slice(words, 1, 8)
    low = F.lower("summary")
    return events.filter(low.rlike(text.ACTION) & ((F.size(first) == 0) | F.exists(first, lambda w: F.contains(low, w))))


def not_yet_there(fresh: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    """Rows of fresh whose key (document and content) present lacks: loads that can run again."""
    return fresh.join(present.select(*key).distinct(), key, "left_anti")


# Words and types of events that are no part of a case.
JUNK_EVENT = r"(?i)\b(episode|season|recap|watch|documentary|film|movie|concert|game\s+result|match\s+result|tournament|playoff|bracket|stream\s+now|box\s+office)\b"
JUNK_TYPES = ("SPORTS", "ENTERTAINMENT", "CELEBRITY", "GAME")


def without_junk(events: DataFrame) -> DataFrame:
    """Events whose type and summary are not of sports or entertainment; a null type or summary is none."""
    junk = F.coalesce(F.upper("event_type").isin(*JUNK_TYPES), F.lit(False)) | F.coalesce(F.col("summary").rlike(JUNK_EVENT), F.lit(False))
    return events.filter(~junk)


def titled(event_type: Column, summary: Column, soft: Column) -> Column:
    """[TYPE] summary(120), or [SOFT][TYPE] summary(110)."""
    return F.when(soft, F.concat(F.lit("[SOFT]["), event_type, F.lit("] "), F.substring(summary, 1, 110))).otherwise(F.concat(F.lit("["), event_type, F.lit("] "), F.substring(summary, 1, 120)))


def titled_plainly(event_type: Column, summary: Column) -> Column:
    """TYPE WORDS: summary(80), the title of events that come with an upload or an analysis."""
    return F.concat(F.replace(event_type, F.lit("_"), F.lit(" ")), F.lit(": "), F.substring(summary, 1, 80))
