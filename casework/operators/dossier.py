"""Dossier, registry and look-up queries over all cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casework.operators.graph import degree
from casework.operators.ranking import case_of, name_key, ranked_whole, top_by

# Events that count for accountability; generic names; types that pass the lock; severities of log entries (others: info).
ACCOUNTABILITY = ("CONTRACT_AWARDED CONTRACT AUDIT AUDIT_FLAG AUDIT_FINDING APPROPRIATION HEARING ENFORCEMENT ENFORCEMENT_ACTION PROGRAM_CHANGE VIOLATION INDICTMENT SETTLEMENT REGULATORY_ACTION BUDGET_ACTION GRANT_AWARD FRAUD_FLAG "
                  "WHISTLEBLOWER INVESTIGATION CONVICTION FILING FRAUD_MISUSE INSPECTION SUSPENSION DEBARMENT REFERRAL COMPLAINT SUBPOENA ARREST CHARGE AGENCY_CHANGE LEADERSHIP_CHANGE OVERSIGHT_ACTION BUDGET DISBURSEMENT").split()  # fmt: skip
JUNK_WORD = r"(?i)\b(episode|season|recap|trailer|premiere|documentary|film|movie|concert|game|match|tournament|playoff|bracket|watch|stream|preview|sports|celebrity|entertainment)\b"
ORG_TYPES = ("government_agency", "government_body", "government", "agency", "organization", "company", "corporation", "business", "nonprofit", "ngo", "program", "department")
GENERIC = ("people", "person", "community", "residents", "families", "individuals", "group", "groups", "city", "county", "state", "nation", "government", "officials", "office", "board", "public", "administration")
SEVERITY = {
    "auth_login": "success", "auth_logout": "info", "auth_failed": "error",
    "case_created": "info", "case_seeded": "info", "auto_build_started": "info", "auto_ingest_started": "info", "auto_build_complete": "success", "build_quality_assigned": "info", "seed_complete": "success", "seed_intent_classified": "debug",
    "query_run": "debug", "document_ingested": "info", "web_source_ingested": "info", "extraction_failed": "warn", "extraction_partial": "warn", "doc_noise_skipped": "debug", "doc_topic_mismatch": "warn", "doc_contamination_high": "warn",
    "analysis_completed": "info", "entity_approved": "success", "entity_auto_approved": "success", "entity_promoted": "success", "entity_rejected": "warn", "entity_candidate_held": "info", "entity_held": "info",
    "suggested_link": "info", "graph_built": "success", "graph_updated": "success", "timeline_extracted": "info", "financial_signal": "info",
    "recovery_triggered": "warn", "recovery_complete": "success", "seed_fallback_triggered": "warn", "seed_no_promotion": "error", "dossier_generated": "success",
}


def entity_quality(entities: DataFrame, mentions: DataFrame, edges: DataFrame, signals: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts and a quality score for each entity: money, confidence, documents, edges, words (four letters or more) in titles of its case."""
    long_words = lambda c: F.explode(F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 3)))
    titled = documents.select("case_id", long_words("title").alias("word")).distinct()
    in_title = entities.select("id", "case_id", long_words("name").alias("word")).join(titled, ["case_id", "word"], "left_semi").select("id").distinct().withColumn("in_title", F.lit(True))
    approved = mentions.filter("status = 'approved'").groupBy("case_id", name_key("entity_name").alias("name_key")).agg(F.countDistinct("document_id").alias("n_documents"), F.avg("confidence").alias("avg_confidence"))
    money = signals.select("case_id", F.explode(F.array("entity_name", "controlled_by", "received_by")).alias("n")).filter("n is not null").select("case_id", name_key("n").alias("name_key")).distinct().withColumn("financial", F.lit(True))
    d = degree(edges).select(F.col("entity_id").alias("id"), F.col("degree").alias("n_edges"))
    e = entities.withColumn("name_key", name_key("name")).join(approved, ["case_id", "name_key"], "left").join(money, ["case_id", "name_key"], "left").join(d, "id", "left").join(in_title, "id", "left")
    e = e.withColumns({"n_documents": F.coalesce("n_documents", F.lit(0)), "n_edges": F.coalesce("n_edges", F.lit(0)), "financial": F.coalesce("financial", F.lit(False)), "avg_confidence": F.coalesce("avg_confidence", F.lit(0.5)), "in_title": F.coalesce("in_title", F.lit(False))})
    e = e.withColumn("most", F.greatest(F.max("n_documents").over(Window.partitionBy("case_id")), F.lit(1)))
    score = F.when(F.col("financial"), 3.0).otherwise(0.0) + 3 * F.col("avg_confidence") + 2 * F.col("n_documents") / F.col("most") + F.when(F.col("in_title"), 2.0).otherwise(0.0) + 2 * F.least(F.col("n_edges") / 3, F.lit(1.0))
    return e.select("id", "case_id", "name", "type", "n_documents", "n_edges", "financial", "in_title", F.round(score, 4).alias("score"))


def locked(quality: DataFrame, k: int = 12) -> DataFrame:
    """The k best entities of each case that are not generic and have documents, money, edges, an institution's type or a word in a title."""
    key = name_key("name")
    short = ~key.contains(" ") & (F.length(key) <= 3)
    passes = (F.col("n_documents") >= 2) | F.col("financial") | (F.col("n_edges") > 0) | F.lower("type").isin(*ORG_TYPES) | F.col("in_title")
    return top_by(quality.filter(~key.isin(*GENERIC) & ~short & passes), ["case_id"], [F.desc("score"), "id"], k).select("case_id", "rank", "id", "name", "score", "n_documents")


def display_type(kind):
    """Raw types to the few that are shown; others in capitals with spaces."""
    low = F.lower(F.trim(kind))
    return case_of(F.upper(F.replace(kind, F.lit("_"), F.lit(" "))), (low.isin("person", "individual", "official"), "PERSON"), (low.isin("agency", "government_agency", "government_body", "government", "department"), "AGENCY"), (low.isin("organization", "nonprofit", "ngo"), "ORGANIZATION"), (low.isin("company", "corporation", "business", "contractor"), "COMPANY"), (low.isin("location", "place", "city"), "LOCATION"), (low.isin("program", "project"), "PROGRAM"))


def accountability(timeline: DataFrame, k: int = 8) -> DataFrame:
    """The first k events of each case that count for accountability."""
    kept = timeline.filter(F.col("event_date").isNotNull() & (F.col("event_type").isNull() | F.col("event_type").isin(*ACCOUNTABILITY)) & ~F.coalesce(F.col("title"), F.lit("")).rlike(JUNK_WORD))
    return top_by(kept, ["case_id"], ["event_date", "id"], k).select("case_id", "rank", "id", "event_date", "event_type")


def evidence_order(documents: DataFrame) -> DataFrame:
    """Documents of each case, the latest first, undated last."""
    return ranked_whole(documents.select("case_id", "id", "publish_date"), ["case_id"], [F.desc_nulls_last("publish_date"), "id"]).select("case_id", "rank", "id", "publish_date")


def registry(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities with approved mentions and documents of their name over all cases."""
    m = mentions.filter("status = 'approved'").groupBy(name_key("entity_name").alias("name_key")).agg(F.count("*").alias("n_mentions"), F.countDistinct("document_id").alias("n_documents"))
    return entities.withColumn("name_key", name_key("name")).join(m, "name_key", "left").fillna(0, ["n_mentions", "n_documents"]).select("id", "case_id", "name", "type", "n_mentions", "n_documents")


def profiles(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Mention counts by status, first and last document, and strength of each entity inside its case."""
    m = mentions.groupBy("case_id", name_key("entity_name").alias("name_key")).agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("approved", "pending", "rejected")], F.min("document_id").alias("first_document"), F.max("document_id").alias("last_document"), F.countDistinct(F.when(F.col("status") == "approved", F.col("document_id"))).alias("n_documents")
    )
    e = entities.withColumn("name_key", name_key("name")).join(m, ["case_id", "name_key"], "left").fillna(0, ["n_approved", "n_pending", "n_rejected", "n_documents"])
    d, a = F.col("n_documents"), F.col("n_approved")
    return e.select("id", "case_id", "n_approved", "n_pending", "n_rejected", "n_documents", "first_document", "last_document", case_of("LIMITED", ((d >= 3) & (a >= 3), "STRONG"), ((d >= 2) | (a >= 2), "MODERATE")).alias("strength"))


def profile_documents(entities: DataFrame, mentions: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, rank, document_id, n_mentions, title, source_domain): the documents that mention each entity of their case, the most mentions first.

    Mentions are counted by (case, name, document) first, so that a name with many mentions is few rows.
    """
    counted = mentions.filter("document_id is not null").groupBy("case_id", name_key("entity_name").alias("name_key"), "document_id").agg(F.count("*").alias("n_mentions"))
    rows = entities.select("id", "case_id", name_key("name").alias("name_key")).join(counted, ["case_id", "name_key"]).select("id", "document_id", "n_mentions")
    placed = ranked_whole(rows, ["id"], [F.desc("n_mentions"), "document_id"])
    return placed.join(documents.select(F.col("id").alias("document_id"), "title", "source_domain"), "document_id", "left").select("id", "rank", "document_id", "n_mentions", "title", "source_domain")


def profile_lists(entities: DataFrame, mentions: DataFrame, documents: DataFrame, timeline: DataFrame, k: int = 8) -> DataFrame:
    """(id, documents, events): for each entity its k most mentioning documents (document_id, n_mentions) and k first events (id, event_date) of these and other documents that mention it.

    Each list is cut to k before its rows move together.
    """
    counted = mentions.filter("document_id is not null").groupBy("case_id", name_key("entity_name").alias("name_key"), "document_id").agg(F.count("*").alias("n_mentions"))
    rows = entities.select("id", "case_id", name_key("name").alias("name_key")).join(counted, ["case_id", "name_key"]).select("id", "document_id", "n_mentions").join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    listed = lambda df, name, *fields: df.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("l")).select("id", F.transform("l", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))
    docs = listed(top_by(rows, ["id"], [F.desc("n_mentions"), "document_id"], k), "documents", "document_id", "n_mentions")
    dated = timeline.filter("event_date is not null").select("document_id", F.col("id").alias("event_id"), "event_date")
    events = listed(top_by(rows.join(dated, "document_id"), ["id"], ["event_date", "event_id"], k), "events", "event_id", "event_date")
    return entities.select("id").join(docs, "id", "left").join(events, "id", "left")


def profile_facts(quality: DataFrame, mentions: DataFrame, signals: DataFrame, edges: DataFrame) -> DataFrame:
    """Documents, approved mentions, signals with their total, edges, strength and open questions of each locked entity (id, case_id, name, type, n_documents).

    questions: at most three codes, in order: MORE_SOURCES, FIND_FLOWS (agencies and contractors without signals), MAP_LINKS, AUTHORITY (persons); VERIFY where none holds.
    """
    approved = mentions.filter("status = 'approved'").groupBy("case_id", name_key("entity_name").alias("name_key")).agg(F.count("*").alias("n_mentions"))
    paid = signals.filter("entity_name is not null").groupBy("case_id", name_key("entity_name").alias("name_key")).agg(F.count("*").alias("n_signals"), F.sum("normalized_amount").alias("signal_total"))
    d = degree(edges).select(F.col("entity_id").alias("id"), F.col("degree").alias("n_edges"))
    e = quality.withColumn("name_key", name_key("name")).join(approved, ["case_id", "name_key"], "left").join(paid, ["case_id", "name_key"], "left").join(d, "id", "left").fillna(0, ["n_mentions", "n_signals", "n_edges"]).fillna(0.0, ["signal_total"])
    n, kind = F.col, display_type(F.col("type"))
    asks = [(n("n_documents") < 2, "MORE_SOURCES"), ((n("n_signals") == 0) & kind.isin("COMPANY", "CONTRACTOR", "AGENCY"), "FIND_FLOWS"), (n("n_edges") == 0, "MAP_LINKS"), (kind == "PERSON", "AUTHORITY")]
    codes = F.slice(F.array_compact(F.array(*[F.when(p, code) for p, code in asks])), 1, 3)
    strength = case_of("LIMITED", ((n("n_documents") >= 3) & (n("n_mentions") >= 3), "STRONG"), ((n("n_documents") >= 2) | (n("n_mentions") >= 2), "MODERATE"))
    return e.select("id", "case_id", "n_documents", "n_mentions", "n_signals", "signal_total", "n_edges", strength.alias("strength"), F.when(F.size(codes) == 0, F.array(F.lit("VERIFY"))).otherwise(codes).alias("questions"))


def _named(rows: DataFrame, by: str, out: str, names: DataFrame, name: str, word: str) -> DataFrame:
    """rows with the name of the row that ``by`` points to, or the word and the number where there is none."""
    of = names.select(F.col("id").alias(by), F.nullif(F.col(name), F.lit("")).alias("_name"))
    return rows.join(of, by, "left").withColumn(out, F.coalesce("_name", F.concat(F.lit(f"{word} "), F.col(by).cast("string")))).drop("_name")


def named_flows(flows: DataFrame, entities: DataFrame) -> DataFrame:
    """Money flows (id, case_id, source_entity_id, destination_entity_id, amount, currency) with the names of both ends."""
    out = _named(_named(flows, "source_entity_id", "source_name", entities, "name", "Entity"), "destination_entity_id", "destination_name", entities, "name", "Entity")
    return out.select("id", "case_id", "source_name", "destination_name", "amount", F.coalesce(F.nullif("currency", F.lit("")), F.lit("USD")).alias("currency"))


def named_timeline(timeline: DataFrame, entities: DataFrame, documents: DataFrame) -> DataFrame:
    """Events (id, case_id, event_date, title, linked_entity_id, document_id) with the names of what they are linked to, null where to nothing."""
    out = _named(_named(timeline, "linked_entity_id", "entity_name", entities, "name", "Entity"), "document_id", "document_title", documents, "title", "Document")
    return out.select("id", "case_id", "event_date", "title", "entity_name", "document_title")


def named_evidence(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """Evidence (id, relationship_id, document_id) with the titles of its documents."""
    return _named(evidence, "document_id", "document_title", documents, "title", "Document").select("id", "relationship_id", "document_id", "document_title")


def latest_log(log: DataFrame, k: int = 200) -> DataFrame:
    """The last k entries of each case with their severity."""
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return top_by(log, ["case_id"], [F.desc("created_at"), F.desc("id")], k).select("case_id", "rank", "id", "event_type", F.coalesce(severity[F.col("event_type")], F.lit("info")).alias("severity"))


def severity_counts(log: DataFrame) -> DataFrame:
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return log.groupBy(F.coalesce(severity[F.col("event_type")], F.lit("info")).alias("severity")).agg(F.count("*").alias("n"))


def fleet(cases: DataFrame, entities: DataFrame, documents: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row of counts over everything."""
    c = cases.agg(F.count("*").alias("n_cases"), F.count_if(F.col("status") == "open").alias("n_open"))
    for t, name, keep in ((entities, "n_entities", F.lit(True)), (documents, "n_documents", F.lit(True)), (mentions, "n_pending", F.col("status") == "pending")):
        c = c.join(F.broadcast(t.agg(F.count_if(keep).alias(name))), how="cross")  # one row each
    return c


def case_quality(cases: DataFrame, entities: DataFrame, edges: DataFrame, signals: DataFrame, timeline: DataFrame, documents: DataFrame) -> DataFrame:
    """Points of each case for its locked entities, clean edges, numeric signals, accountable events and sources, and a label."""
    per = lambda t, **c: t.groupBy(F.col("case_id").alias("id")).agg(*[v.alias(k) for k, v in c.items()])
    gov = F.lower(F.concat(F.coalesce("source_domain", F.lit("")), F.coalesce("title", F.lit("")))).rlike(r"\.gov|inspector.general|oig|audit|gao|county|board.of.supervisors|official")
    named = F.coalesce("entity_name", "controlled_by", "received_by").isNotNull()
    c = cases.select("id")
    for t in (
        per(entities, n_entities=F.count_if(F.col("n_documents") >= 1), n_crossed=F.count_if(F.col("n_documents") >= 2)),
        per(edges, n_edges=F.count("*")),
        per(signals, n_signals=F.count("*"), n_named=F.count_if(named), n_big=F.count_if(F.col("normalized_amount") >= 1_000_000)),
        per(timeline, n_events=F.count("*")),
        per(documents, n_sources=F.count("*"), n_gov=F.count_if(gov)),
    ):
        c = c.join(t, "id", "left")
    c = c.fillna(0)
    n = F.col
    points = {
        "entity_points": F.least(F.lit(20), 3 * n("n_entities") + 3 * n("n_crossed")),
        "edge_points": F.least(F.lit(20), 4 * n("n_edges")),
        "money_points": F.least(F.lit(25), 5 * n("n_signals") + 3 * n("n_named") + 2 * n("n_big")),
        "event_points": F.least(F.lit(15), 5 * n("n_events")),
        "source_points": F.least(F.lit(20), 2 * n("n_sources") + 4 * n("n_gov") + F.when(n("n_sources") - n("n_gov") >= 2, 2).otherwise(0)),
    }
    c = c.select("id", *[v.cast("int").alias(k) for k, v in points.items()]).withColumn("total", sum((n(k) for k in list(points)[1:]), n("entity_points")))
    return c.withColumn("label", case_of("OPERATOR-READY", (n("total") < 20, "RAW"), (n("total") < 45, "DEVELOPING"), (n("total") < 70, "COMPILED")))


def confidence(cases: DataFrame, locked_entities: DataFrame, documents: DataFrame, signals: DataFrame) -> DataFrame:
    """Overall confidence of each case, by entities in three documents, sources and numeric signals."""
    per = lambda t, **c: t.groupBy(F.col("case_id").alias("id")).agg(*[v.alias(k) for k, v in c.items()])
    c = cases.select("id")
    for t in (per(locked_entities, n_entities=F.count("*"), n_confirmed=F.count_if(F.col("n_documents") >= 3)), per(documents, n_sources=F.count("*")), per(signals, n_signals=F.count("*"))):
        c = c.join(t, "id", "left")
    n = F.col
    level = case_of("PROVISIONAL", (n("n_entities") == 0, "INSUFFICIENT"), ((n("n_confirmed") >= 3) & (n("n_sources") >= 6) & (n("n_signals") > 0), "STRONG"), ((n("n_confirmed") >= 2) & (n("n_sources") >= 4), "MODERATE"))
    return c.fillna(0).withColumn("level", level)


def risk_flags(cases: DataFrame, locked_entities: DataFrame, edges: DataFrame, signals: DataFrame, timeline: DataFrame, documents: DataFrame) -> DataFrame:
    """Six booleans of each case."""
    per = lambda t, **c: t.groupBy(F.col("case_id").alias("id")).agg(*[v.alias(k) for k, v in c.items()])
    c = cases.select("id")
    for t in (
        per(signals, high_value=F.bool_or(~F.coalesce("inferred_signal", F.lit(False)) & (F.col("normalized_amount") >= 1_000_000)), contract=F.bool_or(F.col("signal_type").isin("CONTRACT", "CONTRACT_AWARDED")), n_signals=F.count("*")),
        per(edges, weak_edge=F.bool_or(F.col("confidence") < 0.4), n_edges=F.count("*")),
        per(documents, unattributed=F.bool_or(F.coalesce("source_domain", F.lit("")) == "")),
        per(timeline, n_events=F.count("*")),
        per(locked_entities, n_entities=F.count("*")),
    ):
        c = c.join(t, "id", "left")
    c = c.fillna(0).fillna(False)
    n = F.col
    return c.select("id", "high_value", "contract", "weak_edge", "unattributed", ((n("n_events") > 0) & (n("n_signals") > 0)).alias("timing"), ((n("n_entities") > 0) & (n("n_edges") == 0)).alias("unlinked"))


def append_log(entries: DataFrame, path: str) -> None:
    """Appends log entries (event_type, message, case_id, created_at)."""
    entries.write.mode("append").parquet(path)
