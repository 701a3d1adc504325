"""Compiling cases: counts, rankings, quality. One row, or a few ranked rows, for each case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.functions.text import diag_map, diag_value, strip_markers
from casework.operators.graph import degree, ends
from casework.operators.ranking import holding, case_of, first_by, name_key, top_by
from casework.tables import save

# How much an event type counts.
EVENT_RANK = {"FUNDING_APPROVED": 10, "CONTRACT_AWARDED": 10, "LEGAL_ACTION": 9, "AUDIT": 9, "INVESTIGATION_STARTED": 8, "PROGRAM_LAUNCH": 7, "PROPERTY_ACQUISITION": 7, "POLICY_CHANGE": 6, "PROGRAM_EXPANSION": 5}
ORG_WORD = r"\b(agency|administration|office|department|bureau|foundation|inc|corp|llc|ltd|group|institute|association|committee|commission|authority|ministry|council|union|party|government|court|senate|congress|parliament|university|college|hospital|bank|fund|company|firm|organization)\b"
TITLE_WORD = r"\b(mr|mrs|ms|dr|sen|rep|gov|sec|gen|col|maj|cpt|sgt|atty|judge|justice|president|vice president|chancellor|minister|mayor|sheriff|detective|agent|director)\b\.?"


def case_counts(cases: DataFrame, **tables: DataFrame) -> DataFrame:
    """cases with n_<name> for each table of rows with a case_id, zero where there are none."""
    out = cases
    for name, t in tables.items():
        out = out.join(t.groupBy(F.col("case_id").alias("id")).agg(F.count("*").alias(f"n_{name}")), "id", "left")
    return out.fillna(0, [f"n_{name}" for name in tables])


def edges_touching(cases: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, n_edges): edges with an entity of the case on either side."""
    e = edges.select("id", F.explode(F.array("entity_a_id", "entity_b_id")).alias("entity_id"))
    own = e.join(entities.select(F.col("id").alias("entity_id"), "case_id"), "entity_id").select("case_id", "id").distinct()
    counted = own.groupBy(F.col("case_id").alias("case")).agg(F.count("*").alias("n_edges"))
    return cases.join(counted, F.col("id") == F.col("case"), "left").select("id", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def mention_stats(mentions: DataFrame) -> DataFrame:
    """(case_id, entity_name, n_mentions, n_documents, avg_confidence, max_confidence)."""
    return mentions.groupBy("case_id", "entity_name").agg(
        F.count("*").alias("n_mentions"),
        F.countDistinct("document_id").alias("n_documents"),
        F.round(F.avg("confidence") + 1e-9, 2).alias("avg_confidence"),  # halves go up in any order of adding
        F.round(F.max("confidence"), 2).alias("max_confidence"),
    )


def usable(documents: DataFrame) -> DataFrame:
    """Documents with their diagnostic map (``diag``), but those that failed or have under 100 characters."""
    d = documents.withColumn("diag", diag_map(F.col("raw_text")))
    status = F.coalesce(diag_value(F.col("raw_text"), "status"), F.lit("unknown"))  # the map is made only of what is left, if it is read
    return d.filter(~status.isin("failed", "wrapper") & (F.length(F.coalesce("raw_text", F.lit(""))) >= 100))


def ranked_documents(documents: DataFrame, timeline: DataFrame, signals: DataFrame, k: int = 5) -> DataFrame:
    """The k documents of each case that carry most: relevance, priority, alignment, length, events, money, entities."""
    d = usable(documents)
    for name, t in (("timeline", timeline), ("money", signals)):
        d = d.join(t.select(F.col("document_id").alias("id")).distinct().withColumn(f"has_{name}", F.lit(True)), "id", "left").fillna(False, [f"has_{name}"])
    number = lambda k: F.coalesce(F.col("diag")[k].try_cast("int"), F.lit(0))
    priority, align = F.coalesce(F.col("diag")["priority"], F.lit("PRIORITY_B")), F.coalesce(F.col("diag")["alignment"], F.lit("unknown"))
    parts = [
        number("score"),
        case_of(0, (priority == "PRIORITY_A", 15), (priority == "PRIORITY_B", 5)),
        case_of(0, (align == "matched", 10), (align == "partial", 4)),
        case_of(0, (number("chars") > 5000, 8), (number("chars") > 2000, 4)),
        F.when(F.col("has_timeline"), 12).otherwise(0),
        F.when(F.col("has_money"), 14).otherwise(0),
        case_of(0, (number("entities") >= 5, 6), (number("entities") >= 2, 3)),
    ]
    reason = F.concat_ws(" | ", F.when(number("score") > 0, F.concat(F.lit("relevance="), number("score").cast("string"))), F.when(priority == "PRIORITY_A", "priority=A"), F.when(align == "matched", "aligned"), F.when(F.col("has_timeline"), "has_timeline"), F.when(F.col("has_money"), "has_financial"))
    scored = d.select("id", "case_id", "title", sum(parts[1:], parts[0]).cast("int").alias("score"), reason.alias("reason"))
    return top_by(scored, ["case_id"], [F.desc("score"), "id"], k)


def junk_name(c):
    """Names that can't be entities: too short or long, urls, numbers, noise in capitals, many words."""
    return (F.length(c) > 60) | (F.length(c) < 3) | c.rlike("https?://") | c.rlike("^[0-9]+$") | (F.regexp_count(c, F.lit("[A-Z]")) > 15) | (F.size(F.split(c, r"\s+")) > 6)


def inferred_type(name, known):
    """The known type, else one by organization words, titles of persons, or the shape of the name."""
    low = F.lower(name)
    return case_of(
        "organization",
        (F.coalesce(known, F.lit("unknown")) != "unknown", known),
        (low.rlike(ORG_WORD), "organization"),
        (low.rlike(TITLE_WORD), "person"),
        (F.trim(name).rlike(r"^[A-Z][a-z]\S{0,13}\s+[A-Z][a-z]\S{0,13}$"), "person"),
        (F.trim(name).rlike(r"^[A-Z]\S{0,19}$"), "location"),
    )


def ranked_entities(mentions: DataFrame, entities: DataFrame, primary: int = 6, secondary: int = 4) -> DataFrame:
    """The best primary (two documents or three mentions) and other names of each case.

    Names are judged once they are counted and written, one row for each name of a case: Spark would
    move the patterns below the counting, to every mention.
    """
    known = entities.groupBy("case_id", name_key("name").alias("name_key")).agg(F.max_by("type", "id").alias("known_type"), F.max("id").alias("entity_id"))
    stats = save(mention_stats(mentions.filter(F.col("entity_name").isNotNull())))
    s = stats.filter(~junk_name(F.col("entity_name"))).withColumn("name_key", name_key("entity_name")).join(known, ["case_id", "name_key"], "left")
    s = s.withColumns(
        {
            "type": inferred_type(F.col("entity_name"), F.col("known_type")),
            "is_primary": (F.col("n_documents") >= 2) | (F.col("n_mentions") >= 3),
            "score": F.round(2 * F.col("n_mentions") + 4 * F.col("n_documents") + 8 * F.col("avg_confidence"), 4),
        }
    )
    return top_by(s, ["case_id", "is_primary"], [F.desc("score"), "entity_name"], max(primary, secondary)).filter(F.col("rank") <= F.when(F.col("is_primary"), primary).otherwise(secondary))


def ranked_timeline(timeline: DataFrame, mentions: DataFrame, as_of, k: int = 8) -> DataFrame:
    """The k events of each case up to a date that count most; a title that has a known name counts more.

    A name meets the titles of its case that have its first six letters, so that a large case is
    no product of its titles and names.
    """
    past = timeline.filter(F.col("event_date").isNotNull() & (F.col("event_date") <= F.lit(as_of).cast("date"))).withColumn("low", F.lower(F.coalesce("title", F.lit(""))))
    one = first_by(past.withColumn("start", F.substring("low", 1, 60)), ["case_id", "event_date", "start"], ["id"])
    named = save(mentions.filter(F.col("entity_name").isNotNull()).select("case_id", "entity_name").distinct())  # judged name by name, not mention by mention
    names = named.filter(~junk_name(F.col("entity_name"))).select("case_id", F.lower("entity_name").alias("name")).distinct()
    has = holding(one.select("id", "case_id", "low"), names, "low", "name", ["case_id"]).select("id").distinct().withColumn("has_name", F.lit(True))
    rank = F.create_map(*[F.lit(x) for kv in EVENT_RANK.items() for x in kv])
    priority = F.coalesce(rank[F.col("event_type")], F.lit(1))
    scored = one.join(has, "id", "left").withColumns({"priority": priority, "score": priority * 10 + F.when(F.col("has_name"), 8).otherwise(0)})
    return top_by(scored, ["case_id"], [F.desc("score"), "event_date", "id"], k).select("case_id", "rank", "id", "event_date", "event_type", "priority", "score")


def data_quality(cases: DataFrame, documents: DataFrame, entities: DataFrame, events: DataFrame) -> DataFrame:
    """Quality, confidence and health of each case, from its usable documents and its ranked rows."""
    count = lambda t, name: t.groupBy(F.col("case_id").alias("id")).agg(F.count("*").alias(name))
    c = cases.select("id")
    for t, name in ((usable(documents), "n_usable"), (entities.filter("is_primary"), "n_primary"), (events, "n_events")):
        c = c.join(count(t, name), "id", "left")
    c = c.fillna(0, ["n_usable", "n_primary", "n_events"]).withColumn("n_evidence", F.least("n_usable", F.lit(5)))
    quality = case_of("WEAK", (F.col("n_usable") == 0, "EMPTY"), ((F.col("n_primary") >= 2) & (F.col("n_evidence") >= 3) & (F.col("n_events") >= 2), "STRONG"), ((F.col("n_primary") >= 1) & (F.col("n_evidence") >= 2), "MODERATE"))
    c = c.withColumn("quality", quality)
    q, p, e, u = F.col("quality"), F.col("n_primary"), F.col("n_events"), F.col("n_usable")
    confidence = case_of(
        F.lit(0),
        (q == "STRONG", 80 + F.least(F.lit(20), p * 4 + F.least(e, F.lit(3)) * 2)),
        (q == "MODERATE", 45 + F.least(F.lit(30), p * 6 + F.least(e, F.lit(2)) * 3)),
        (q == "WEAK", 15 + F.least(F.lit(25), p * 5 + u * 2)),
    )
    return c.withColumns({"confidence": F.least(F.lit(99), confidence).cast("int"), "health": case_of("SPARSE", (q == "STRONG", "STRONG"), (q == "MODERATE", "DEVELOPING"))})


def power_nodes(entities: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """The k ranked primary entities of each case with most links, mentions and documents."""
    d = degree(edges).groupBy("entity_id").agg(F.sum("degree").alias("degree"))
    e = entities.filter("is_primary").drop("rank", "score").join(d, "entity_id", "left").fillna(0, ["degree"])
    e = e.withColumn("score", 2 * F.col("degree") + 0.5 * F.col("n_mentions") + F.col("n_documents"))
    return top_by(e, ["case_id"], [F.desc("score"), "entity_name"], k).select("case_id", "rank", "entity_id", "entity_name", "degree", "score")


def key_relationships(edges: DataFrame, k: int = 8) -> DataFrame:
    """The k edges of each case of highest confidence."""
    both = edges.filter("entity_a_id is not null and entity_b_id is not null")
    return top_by(both, ["case_id"], [F.desc(F.coalesce("confidence", F.lit(0.0))), "id"], k).select("case_id", "rank", "id", "entity_a_id", "entity_b_id", "relationship_type", "confidence")


def bodies(documents: DataFrame) -> DataFrame:
    return documents.select("id", "case_id", strip_markers(F.col("raw_text")).alias("body"))


__all__ = ["bodies", "case_counts", "data_quality", "edges_touching", "ends", "inferred_type", "junk_name", "key_relationships", "mention_stats", "power_nodes", "ranked_documents", "ranked_entities", "ranked_timeline", "usable"]


def totals(cases: DataFrame, documents: DataFrame, **tables: DataFrame) -> DataFrame:
    """Counts of each case, with its usable documents."""
    return case_counts(cases, documents=documents, usable=usable(documents), **tables)


def early_signals(entities: DataFrame, signals: DataFrame, timeline: DataFrame, k: int = 6) -> DataFrame:
    """The first k weak hints of each case: secondary names, funding words without amounts, dates without actions."""
    from casework.operators.money import is_non_numeric

    names = entities.filter("not is_primary and rank <= 3").select("case_id", F.lit(1).alias("ord"), F.col("rank").cast("long").alias("at"), F.lit("entity").alias("kind"), F.col("entity_name").alias("label"), F.lit(0.35).alias("confidence"))
    money = signals.filter(is_non_numeric()).select("case_id", F.lit(2), F.col("id"), F.lit("financial"), F.coalesce("program_name", "entity_name", F.substring("event_summary", 1, 60), F.lit("Unknown")), F.coalesce("financial_confidence", F.lit(0.25)))
    dates = timeline.filter("soft_event").select("case_id", F.lit(3), F.col("id"), F.lit("timeline"), F.substring("title", 1, 80), F.lit(0.30))
    return top_by(names.union(money).union(dates), ["case_id"], ["ord", "at"], k).select("case_id", "rank", "kind", "label", "confidence")


def oversight(cases: DataFrame, timeline: DataFrame, signals: DataFrame, entities: DataFrame, documents: DataFrame) -> DataFrame:
    """Flags of each case on oversight: none despite money, its first date, agencies without it, large funds without a public source, many approvals."""
    legal = F.col("event_type").isin("LEGAL_ACTION", "AUDIT", "INVESTIGATION_STARTED")
    low = F.lower(F.concat_ws(" ", "source_domain", "title"))
    per = lambda t, **c: t.groupBy(F.col("case_id").alias("id")).agg(*[v.alias(k) for k, v in c.items()])
    c = cases.select("id")
    for t in (
        per(timeline, first_legal=F.min(F.when(legal, F.col("event_date"))), n_approvals=F.count_if(F.col("event_type").isin("FUNDING_APPROVED", "CONTRACT_AWARDED"))),
        per(signals, n_signals=F.count("*"), large=F.coalesce(F.sum(F.when(F.col("normalized_amount") >= 1_000_000, F.col("normalized_amount"))), F.lit(0.0))),
        per(entities.filter("is_primary"), has_agency=F.bool_or(F.col("type").isin("government_agency", "agency"))),
        per(documents, has_public=F.bool_or(low.rlike(r"\.gov|audit|inspector general"))),
    ):
        c = c.join(t, "id", "left")
    c = c.fillna(0, ["n_approvals", "n_signals", "large"]).fillna(False, ["has_agency", "has_public"])
    none = F.col("first_legal").isNull()
    return c.select("id", (none & (F.col("n_signals") > 0)).alias("no_oversight"), F.when(F.col("n_signals") > 0, F.col("first_legal")).alias("late_since"), (F.col("has_agency") & none).alias("agency_unseen"), ((F.col("large") > 0) & ~F.col("has_public")).alias("no_public_source"), (F.col("n_approvals") >= 3).alias("many_approvals"))


def write_briefs(briefs: DataFrame, path: str) -> None:
    """One JSON brief a case: (case_id, brief)."""
    briefs.select("case_id", F.to_json(F.struct(*[c for c in briefs.columns if c != "case_id"])).alias("brief")).write.mode("overwrite").parquet(path)


def read_briefs(stored: DataFrame, schema: str) -> DataFrame:
    """Stored briefs as structs; broken JSON gives null."""
    parsed = F.from_json("brief", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return stored.select("case_id", F.when(F.get_json_object("brief", "$").isNotNull(), parsed).alias("brief"))
