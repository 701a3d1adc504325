"""Money signals of cases: lists, ledger, ranking, red flags, flow traces.

Each function takes the signals of all cases and gives rows of all cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.operators.ranking import case_of, first_by, name_key, ranked_whole, top_by

LEDGER_ROWS = 30
NON_NUMERIC = "NON-NUMERIC"


def _some(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def is_non_numeric() -> Column:
    return F.coalesce(F.col("signal_type").startswith("NON_NUMERIC"), F.lit(False)) | (F.coalesce("amount_display", F.lit("")) == NON_NUMERIC)


def numeric_signals(signals: DataFrame) -> DataFrame:
    """Positive amounts, one for each (case, entity, amount), the largest first."""
    kept = signals.filter(~is_non_numeric() & (F.col("normalized_amount") > 0))
    return first_by(kept.withColumn("entity_key", F.lower(F.coalesce("entity_name", F.lit("")))), ["case_id", "entity_key", "normalized_amount"], ["id"]).drop("entity_key")


def signal_list(signals: DataFrame) -> DataFrame:
    """Numeric signals; for cases without any, the first three non-numeric ones that have a summary."""
    numeric = numeric_signals(signals)
    early = signals.join(numeric.select("case_id").distinct(), "case_id", "left_anti").filter(F.col("signal_type").startswith("NON_NUMERIC") & _some("event_summary"))
    early = top_by(early, ["case_id"], ["id"], 3).drop("rank").withColumn("inferred_signal", F.lit(True)).withColumn("normalized_amount", F.lit(None).cast("double"))
    return numeric.withColumn("inferred_signal", F.coalesce("inferred_signal", F.lit(False))).unionByName(early)


def ledger(signals: DataFrame) -> DataFrame:
    """Totals per case, and whether most of its signals are budget allocations."""
    return (
        numeric_signals(signals)
        .groupBy("case_id")
        .agg(
            F.sum("normalized_amount").alias("total"),
            F.count("*").alias("n_signals"),
            F.countDistinct("entity_name").alias("n_entities"),
            F.countDistinct("document_id").alias("n_documents"),
            F.count_if(F.col("signal_type") == "ALLOCATION").alias("n_allocations"),
        )
        .withColumn("budget_case", (F.col("n_allocations") > 0) & (2 * F.col("n_allocations") >= F.col("n_signals")))
    )


def ledger_rows(signals: DataFrame, k: int = LEDGER_ROWS) -> DataFrame:
    top = top_by(numeric_signals(signals), ["case_id"], [F.desc("normalized_amount"), "id"], k)
    return top.select("case_id", "rank", "id", "entity_name", "program_name", "normalized_amount", "signal_type")


def ranked_signals(signals: DataFrame, known_names: DataFrame) -> DataFrame:
    """The best five numeric signals of each case (or three others), by amount, known entity, confidence and completeness.

    known_names: (case_id, name_key) of the ranked entities.
    """
    rounded = F.round(F.coalesce("normalized_amount", F.lit(0.0)) / 10_000).cast("long") * 10_000
    keyed = signals.withColumns(
        {
            "entity_key": F.substring(name_key(F.coalesce("entity_name", F.lit(""))), 1, 30),
            "type_key": F.substring(F.lower(F.coalesce("signal_type", F.lit(""))), 1, 20),
            "rounded": rounded,
        }
    )
    one = first_by(keyed, ["case_id", "entity_key", "type_key", "rounded"], ["id"])
    known = known_names.select("case_id", F.col("name_key").alias("entity_lower")).distinct().withColumn("known", F.lit(True))
    one = one.withColumn("entity_lower", F.lower("entity_name")).join(known, ["case_id", "entity_lower"], "left")
    amount = F.coalesce("normalized_amount", F.lit(0.0))
    parts = [
        F.least(amount / 1_000_000, F.lit(100.0)),
        F.when(F.coalesce("known", F.lit(False)) & _some("entity_lower"), 20.0).otherwise(0.0),
        F.coalesce(F.col("financial_confidence") * 10, F.lit(0.0)),
        F.when(F.coalesce("inferred_signal", F.lit(False)), 0.0).otherwise(8.0),
        case_of(0.0, (_some("controlled_by") & _some("received_by"), 6.0), (_some("controlled_by") | _some("received_by"), 3.0)),
        F.when(F.length("event_summary") > 40, 4.0).otherwise(0.0),
        F.when(_some("program_name"), 2.0).otherwise(0.0),
        F.when(is_non_numeric(), -15.0).otherwise(0.0),
    ]
    score = F.round(sum(parts[1:], parts[0]), 6)
    scored = one.withColumn("score", score).withColumn("numeric", ~is_non_numeric())
    best = top_by(scored, ["case_id", "numeric"], [F.desc("score"), "id"], 5)
    # ten rows a case at most; a window over them instead of the whole plan again
    best = best.withColumn("has_numeric", F.max("numeric").over(Window.partitionBy("case_id"))).filter(F.col("numeric") | (~F.col("has_numeric") & (F.col("rank") <= 3)))
    return best.select("case_id", "rank", "id", "numeric", "score", "entity_name", "program_name", "normalized_amount", "signal_type", "financial_confidence", "inferred_signal", "controlled_by", "received_by", "amount_display")


def fused(top: DataFrame) -> DataFrame:
    """Among the top signals, those that share a program or entity count as inferred where that is open, at a lower confidence."""
    keyed = top.withColumn("fusion_key", F.coalesce("program_name", "entity_name", F.lit("")))
    shared = (F.count("*").over(Window.partitionBy("case_id", "fusion_key")) >= 2) & (F.col("fusion_key") != "") & F.col("inferred_signal").isNull()
    lower = F.greatest(F.lit(0.10), F.col("financial_confidence") - 0.10)
    return keyed.withColumn("shared", shared).select("case_id", "id", "fusion_key", F.when(F.col("shared"), True).otherwise(F.col("inferred_signal")).alias("inferred_signal"), F.round(F.when(F.col("shared"), lower).otherwise(F.col("financial_confidence")), 4).alias("financial_confidence"))


def red_flags(signals: DataFrame) -> DataFrame:
    """Facts behind the red flags of each case; receiver facts name the largest receiver (ties by name)."""
    text = F.lower(F.coalesce("event_summary", F.lit("")))
    no_bid = text.contains("no-bid") | text.contains("sole source") | text.contains("emergency contract") | text.contains("direct award")
    receiver = F.coalesce("received_by", "entity_name")
    facts = signals.groupBy("case_id").agg(
        F.max("normalized_amount").alias("largest"),
        F.bool_or(no_bid).alias("no_bid"),
        F.count_if(is_non_numeric()).alias("n_opaque"),
        F.count_if("inferred_signal").alias("n_inferred"),
        F.count_if(F.col("signal_type") == "AUDIT").alias("n_audit"),
        F.coalesce(F.sum(F.when(F.col("signal_type") == "AUDIT", F.col("normalized_amount"))), F.lit(0.0)).alias("audit_total"),
        F.count_if(F.col("signal_type") == "COST_OVERRUN").alias("n_overrun"),
        F.coalesce(F.sum(F.when(F.col("signal_type") == "COST_OVERRUN", F.col("normalized_amount"))), F.lit(0.0)).alias("overrun_total"),
    )
    paid = signals.withColumn("receiver", receiver).filter("receiver is not null and normalized_amount > 0").groupBy("case_id", "receiver").agg(F.sum("normalized_amount").alias("paid"), F.count("*").alias("n_payments"))
    inflow = paid.groupBy("case_id").agg(F.sum("paid").alias("inflow"), F.max("n_payments").alias("most_payments"))
    top = first_by(paid, ["case_id"], [F.desc("paid"), "receiver"]).select("case_id", F.col("receiver").alias("top_receiver"), F.col("paid").alias("top_paid"))
    out = facts.join(inflow, "case_id", "left").join(top, "case_id", "left")
    share = F.round(100 * F.col("top_paid") / F.col("inflow")).cast("long")
    return out.select(
        "*",
        share.alias("top_share"),
        F.coalesce((F.col("top_paid") >= 500_000) & (share >= 40), F.lit(False)).alias("concentrated"),
        (F.coalesce("most_payments", F.lit(0)) >= 3).alias("fragmented"),
    )


def control_chains(signals: DataFrame) -> DataFrame:
    """The five largest numeric signals of each case as chains from -> program -> to."""
    top = top_by(numeric_signals(signals), ["case_id"], [F.desc("normalized_amount"), "id"], 5)
    chain = F.concat_ws(" -> ", F.coalesce("controlled_by", "entity_name"), "program_name", "received_by")
    return top.select("case_id", "rank", "id", chain.alias("chain"), F.col("controlled_by").isNotNull().alias("has_controller"), F.col("received_by").isNotNull().alias("has_receiver"))


def flow_trace(signals: DataFrame, party: str | None = None, numeric_only: bool = True, by_confidence: bool = False) -> DataFrame:
    """One row for each (case, entity, amount, type) with any party containing the words, by amount or confidence."""
    kept = signals.filter(~is_non_numeric()) if numeric_only else signals
    if party:
        low = party.lower()
        kept = kept.filter(F.lower(F.concat_ws("|", "entity_name", "controlled_by", "received_by")).contains(low))
    kept = kept.withColumn("entity_key", F.lower(F.coalesce("entity_name", F.lit(""))))
    one = first_by(kept, ["case_id", "entity_key", "normalized_amount", "signal_type"], ["id"])
    order = F.desc_nulls_last("financial_confidence" if by_confidence else "normalized_amount")
    few = one.select("case_id", "id", "entity_name", "normalized_amount", "signal_type", "financial_confidence")
    return ranked_whole(few, ["case_id"], [order, "id"]).select("case_id", "rank", "id", "entity_name", "normalized_amount", "signal_type")


def back_linked(signals: DataFrame, mentions: DataFrame) -> DataFrame:
    """Signals without an entity take the first mention of their document whose name is in their program or summary."""
    names = mentions.select("document_id", F.col("id").alias("mention_id"), F.col("entity_name").alias("name")).filter("name is not null")
    text = F.lower(F.concat_ws(" ", "program_name", "event_summary"))
    open_ = signals.filter("entity_name is null").withColumn("text", text)
    found = open_.join(names, "document_id").filter(F.expr("contains(text, lower(name))")).groupBy("id").agg(F.min_by("name", "mention_id").alias("linked_name"))
    return signals.join(found, "id", "left").select("id", "case_id", "document_id", F.coalesce("entity_name", "linked_name").alias("entity_name"))


# A sentence needs one of these words to tell of funding; advertising copy, sports and community news are left out.
FUNDING_GATE = r"\b(funded?|grant(?:ed?)?|contract(?:ed?)?|appropriated?|allocated?|awarded?|paid?|payment|budget|procurement|reimburse|disburse|spending|expenditure|invest(?:ment|ed)|subsidized?|sole.source|no.bid|change\s+order|cost\s+overrun|audit\s+finding|questioned\s+cost|disallow|oig|inspector\s+general|task\s+order|invoice|invoiced?|capitalized?|encumbered?|obligated?)\b"
AD_COPY = r"\b(sale|discount|off|coupon|promo|deal\s+of\s+the\s+day|limited\s+time|buy\s+now|add\s+to\s+cart|checkout|free\s+shipping|starting\s+at|as\s+low\s+as|per\s+month|subscription|plan|retail|price\s+drop|save\s+up\s+to|season\s+pass|ticket\s+price|admission|box\s+office)\b"

BOX_OFFICE = r"\b(starting\s+from|gross(?:ing)?|earned|opening\s+weekend|revenue\s+for\s+(?:the\s+)?film)\b"
SPORTS = r"\b(signing\s+bonus|contract\s+extension\s+for|salary\s+cap\s+hit|years?\s+deal|year\s+contract|nfl|nba|mlb|nhl|mls)\b"
COMMUNITY = r"\b(festival|concert|parade|raffle|bake\s+sale|donation\s+drive|fundraiser|gala|auction|charity\s+run|walk\s+for|community\s+event|annual\s+dinner|gofundme|crowdfund)\b"
NO_FUNDING = (AD_COPY, BOX_OFFICE, SPORTS, COMMUNITY)


def sentence_signals(sentences: DataFrame, k: int = 30, least: float = 1_000.0) -> DataFrame:
    """Money signals of sentences (document_id, pos, sentence): the first of each amount of a document, at most k."""
    from casework.functions import text

    low = F.lower("sentence")
    told = sentences.filter(low.rlike(FUNDING_GATE))
    for words in NO_FUNDING:
        told = told.filter(~low.rlike(words))
    found = told.select("document_id", "pos", text.signal_type(F.col("sentence")).alias("signal_type"), F.posexplode(text.amounts(F.col("sentence"))).alias("match", "amount_raw"))
    found = found.withColumns({"amount": text.amount_value(F.col("amount_raw")), "currency": text.currency(F.col("amount_raw"))}).filter(F.col("amount") >= least)
    one = first_by(found, ["document_id", "amount", "currency"], ["pos", "match"])
    return top_by(one, ["document_id"], ["pos", "match"], k).select("document_id", "pos", "match", "amount_raw", "amount", "currency", "signal_type", "rank")
