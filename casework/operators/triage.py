"""Triage of mentions: support, automatic and bulk decisions, promotion to entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.functions.pages import credibility
from casework.operators.ranking import case_of, first_by, name_key, top_by

PROMOTED = 8
NAV_NAME = r"(?i)^(next|more|watch|listen|read|share|top|latest|live|breaking|related)\s"
GENERIC_NAME = r"^(share|email|menu|search|close|back|next|more|open|save|edit|view|load|clear|reset|submit|cancel|follow|donate)$"


def support(mentions: DataFrame) -> DataFrame:
    """(case_id, name_key, n_documents): distinct documents of each name in any status."""
    known = mentions.select("case_id", name_key("entity_name").alias("name_key"), "document_id").filter("document_id is not null and name_key is not null")
    return known.distinct().groupBy("case_id", "name_key").agg(F.count("*").alias("n_documents"))


def _pending(mentions: DataFrame) -> DataFrame:
    """Pending mentions with defaults for what is not known, and the documents that support their name."""
    pending = mentions.filter("status = 'pending'").withColumn("name_key", name_key("entity_name"))
    return pending.join(support(mentions), ["case_id", "name_key"], "left").withColumns(
        {
            "role": F.coalesce("role", F.lit("UNKNOWN")),
            "topic": F.coalesce("topic", F.lit("LOW")),
            "zone": F.coalesce("zone", F.lit("body")),
            "confidence": F.coalesce("confidence", F.lit(0.0)),
            "n_documents": F.coalesce("n_documents", F.lit(1)),
        }
    )


def auto_triage(mentions: DataFrame, celebrities: Column | None = None) -> DataFrame:
    """(id, case_id, status) of the pending mentions: approved, rejected or held, by ordered rules.

    celebrities: a predicate for names of people in the news for other reasons, the caller's list.
    """
    m = _pending(mentions)
    c, topic, role, zone = F.col("confidence"), F.col("topic"), F.col("role"), F.col("zone")
    front = zone.isin("title", "dek", "lead")
    real = ~role.isin("UNKNOWN", "PERSON")
    one_word = ~F.col("entity_name").contains(" ") & (F.col("entity_type") != "person")
    low, unknown = topic == "LOW", role == "UNKNOWN"
    single = F.col("n_documents") <= 1
    crossed = ~single | role.isin("GOVERNMENT_AGENCY", "COMMITTEE")
    rules = [] if celebrities is None else [(celebrities, "rejected")]
    rules += [
        (c < 0.50, "rejected"),
        (zone.isin("sidebar", "footer", "related") & (c < 0.70), "rejected"),
        (one_word & (c < 0.62), "rejected"),
        (one_word & low & unknown, "rejected"),
        (F.trim("entity_name").rlike("^[A-Z]{1,4}$") & unknown, "rejected"),
        ((zone == "tail") & low & unknown, "rejected"),
        (crossed & front & (topic == "HIGH") & real & (c >= 0.72), "approved"),
        (crossed & (topic == "HIGH") & real & (c >= 0.85), "approved"),
        (crossed & (topic == "MEDIUM") & real & (c >= 0.78) & front, "approved"),
        (role.isin("GOVERNMENT_AGENCY", "COMMITTEE", "OFFICIAL") & topic.isin("HIGH", "MEDIUM") & (c >= 0.70), "approved"),
        (single & (topic == "HIGH") & real & (c >= 0.72), "held"),
        ((topic == "MEDIUM") & (c >= 0.58), "held"),
        (low & real & (c >= 0.68), "held"),
        (low & ~real, "rejected"),
    ]
    return m.select("id", "case_id", case_of("held", *rules).alias("status"))


# Fixed value: words of institutions' names.
INSTITUTION = r"(?i)\b(Department|Agency|University|Committee|Court|Office|Administration|Council|Authority|Commission|Bureau|Division|Foundation|Institute|Ministry|Board|Program|Service|Center|Centre)\b"


def analysis_triage(mentions: DataFrame, celebrities: Column | None = None) -> DataFrame:
    """auto_triage as an analysis run does it: lower thresholds, institutions by name, role or type, and rejection by default."""
    m = _pending(mentions)
    c, topic, role, zone = F.col("confidence"), F.col("topic"), F.col("role"), F.col("zone")
    front, real = zone.isin("title", "dek", "lead"), ~role.isin("UNKNOWN", "PERSON")
    low, unknown, several = topic == "LOW", role == "UNKNOWN", F.col("n_documents") >= 2
    institution = role.isin("GOVERNMENT_AGENCY", "COMMITTEE") | F.col("entity_name").rlike(INSTITUTION) | (F.coalesce("entity_type", F.lit("")) == "government_agency")
    crossed = several | institution
    rules = [] if celebrities is None else [(celebrities, "rejected")]
    rules += [
        (c < 0.50, "rejected"),
        (zone.isin("sidebar", "footer", "related") & (c < 0.70), "rejected"),
        ((zone == "tail") & low & unknown, "rejected"),
        (F.trim("entity_name").rlike("^[A-Z]{1,4}$") & unknown, "rejected"),
        (crossed & (topic == "HIGH") & real & ((front & (c >= 0.70)) | (c >= 0.82)), "approved"),
        (institution & (c >= 0.65) & ~zone.isin("tail", "sidebar", "footer"), "approved"),
        (institution & topic.isin("HIGH", "MEDIUM") & (c >= 0.62), "approved"),
        (crossed & (topic == "MEDIUM") & real & (c >= 0.75) & front, "approved"),
        (several & (c >= 0.62) & real, "approved"),
        ((topic == "MEDIUM") & (c >= 0.58), "held"),
        (low & real & (c >= 0.65), "held"),
    ]
    return m.select("id", "case_id", case_of("rejected", *rules).alias("status"))


def triage_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("case_id").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("approved", "rejected", "held")], F.count("*").alias("n_total"))


def bulk_rule(rule: str) -> tuple[Column, str]:
    """The predicate of a named bulk action and the status that it gives."""
    name, c = F.col("entity_name"), F.coalesce("confidence", F.lit(1.0))
    upper = F.trim(name)
    rules = {
        "low-confidence": (c < 0.60, "rejected"),
        "single-word-person": ((F.col("entity_type") == "person") & ~name.contains(" "), "rejected"),
        "all-pending": (F.lit(True), "rejected"),
        "off-topic": (F.col("topic") == "OFF_TOPIC", "rejected"),
        "junk": (upper.rlike("^[A-Z]{1,3}$") | upper.rlike("^[0-9]+$") | name.rlike("https?://"), "rejected"),
        "low-role": (F.coalesce("role", F.lit("UNKNOWN")) == "UNKNOWN", "held"),
        "artifact": (F.col("zone").isin("sidebar", "footer", "related", "boilerplate") | name.rlike(NAV_NAME) | upper.rlike("^[A-Z]{2,6}$"), "rejected"),
        "nav-boilerplate": (F.lower(name).rlike(GENERIC_NAME) | (F.col("zone").isin("tail", "boilerplate") & (c < 0.60)), "rejected"),
        "role-bearing": ((F.coalesce("role", F.lit("UNKNOWN")) != "UNKNOWN") & (F.coalesce("confidence", F.lit(0.0)) >= 0.72), "approved"),
        "title-lead-highconf": (F.col("zone").isin("title", "dek", "lead") & (F.coalesce("role", F.lit("UNKNOWN")) != "UNKNOWN") & F.col("topic").isin("HIGH", "MEDIUM") & (F.coalesce("confidence", F.lit(0.0)) >= 0.68), "approved"),
    }
    return rules[rule]


def bulk(mentions: DataFrame, rule: str) -> DataFrame:
    """mentions with the status that a bulk action leaves; only pending ones change."""
    holds, status = bulk_rule(rule)
    return mentions.withColumn("status", F.when((F.col("status") == "pending") & holds, status).otherwise(F.col("status")))


def promote(mentions: DataFrame, entities: DataFrame, blocklist: DataFrame | None = None, most: int = PROMOTED) -> DataFrame:
    """New entities of each case: approved names by first appearance, at most ``most`` with those that exist already.

    Of the mentions of a name, the one of highest confidence (the earliest on ties) gives name and type.
    """
    from casework.functions.text import normalized_name

    m = mentions.filter("status = 'approved'").withColumn("norm", normalized_name(F.col("entity_name")))
    best = m.groupBy("case_id", "norm").agg(F.max_by(F.struct("entity_name", "entity_type"), F.struct("confidence", -F.col("id"))).alias("best"), F.min("id").alias("first_id"))
    named = best.select("case_id", "first_id", "best.*")
    if blocklist is not None:
        named = named.join(blocklist, named.entity_name == blocklist.name, "left_anti")
    top = top_by(named, ["case_id"], ["first_id"], most)
    exists = entities.select("case_id", F.col("name").alias("entity_name"))
    return top.join(exists, ["case_id", "entity_name"], "left_anti").select("case_id", "entity_name", "entity_type", "first_id", "rank")


def unanalysed(documents: DataFrame, mentions: DataFrame) -> DataFrame:
    """Documents without any mention."""
    return documents.join(mentions.select(F.col("document_id").alias("id")).distinct(), "id", "left_anti")


def reject_name(mentions: DataFrame, removed: DataFrame) -> DataFrame:
    """mentions after the pending ones of removed entities (case_id, name) are rejected, whatever their case of letters."""
    keys = removed.select("case_id", name_key("name").alias("name_key")).distinct().withColumn("gone", F.lit(True))
    m = mentions.withColumn("name_key", name_key("entity_name")).join(keys, ["case_id", "name_key"], "left")
    return m.withColumn("status", F.when(F.col("gone") & (F.col("status") == "pending"), "rejected").otherwise(F.col("status"))).drop("gone", "name_key")


def without_entities(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges that touch none of the removed entities (id)."""
    gone = removed.select("id").distinct()
    return edges.join(gone.withColumnRenamed("id", "entity_a_id"), "entity_a_id", "left_anti").join(gone.withColumnRenamed("id", "entity_b_id"), "entity_b_id", "left_anti")


def purge(documents: DataFrame, mentions: DataFrame, failed: Column) -> tuple[DataFrame, DataFrame]:
    """Documents that did not fail, and the mentions of those."""
    kept = documents.filter(~F.coalesce(failed, F.lit(False)))
    gone = documents.filter(failed).select(F.col("id").alias("document_id")).distinct()
    return kept, mentions.join(gone, "document_id", "left_anti")


def replace_pending(mentions: DataFrame, fresh: DataFrame) -> DataFrame:
    """mentions after a new analysis of the documents in fresh: decided ones stay, pending ones go, of each new name the last."""
    again = fresh.select("document_id").distinct().withColumn("again", F.lit(True))
    kept = mentions.join(again, "document_id", "left").filter(F.col("again").isNull() | (F.col("status") != "pending")).drop("again")
    return kept.unionByName(first_by(fresh.withColumn("name_key", name_key("entity_name")), ["document_id", "name_key"], [F.desc("id")]).drop("name_key"))


def triage_view(mentions: DataFrame, cases: DataFrame, entities: DataFrame) -> DataFrame:
    """Pending mentions with the title of their case and whether an entity of the name exists."""
    exists = entities.select("case_id", name_key("name").alias("name_key")).distinct().withColumn("exists_", F.lit(True))
    m = mentions.filter("status = 'pending'").withColumn("name_key", name_key("entity_name")).join(exists, ["case_id", "name_key"], "left")
    return m.join(cases.select(F.col("id").alias("case_id"), F.col("title").alias("case_title")), "case_id", "left").select("id", "case_id", "case_title", "entity_name", "confidence", F.coalesce("exists_", F.lit(False)).alias("entity_exists"))


def mention_view(mentions: DataFrame, cases: DataFrame, documents: DataFrame, document_id: int | None = None, case_id: int | None = None, status: str | None = None) -> DataFrame:
    """Mentions of a document, case or status (any where not given) with the title and existence of their case, and the title and tier of their source.

    documents: (id, title, source_domain, raw_text, from_web). A mention without its case or document is kept.
    """
    kept = mentions
    for name, value in (("document_id", document_id), ("case_id", case_id), ("status", status)):
        kept = kept if value is None else kept.filter(F.col(name) == value)
    of_case = cases.select(F.col("id").alias("case_id"), F.col("title").alias("case_title"), F.lit(True).alias("known"))
    tier = credibility(F.col("source_domain"), F.col("raw_text"), F.coalesce("from_web", F.lit(False)))
    of_document = documents.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), tier.alias("source_tier"))
    m = kept.join(of_case, "case_id", "left").join(of_document, "document_id", "left")
    return m.select("id", "document_id", "case_id", "entity_name", "confidence", "status", "case_title", F.coalesce("known", F.lit(False)).alias("case_exists"), "document_title", "source_tier")


def histogram(decided: DataFrame, by: str) -> DataFrame:
    """Rows per case and value, the five most frequent of each case."""
    counted = decided.groupBy("case_id", by).count()
    return top_by(counted, ["case_id"], [F.desc("count"), by], 5).select("case_id", by, F.col("count").alias("n"), "rank")
