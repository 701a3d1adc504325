"""Entity graphs of cases: co-mention edges, degrees, neighbourhoods, money links.

Edges join each name's distinct documents, so a document with many mentions of few entities gives
few rows; a < b on ids keeps one row a pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.operators.ranking import case_of, first_by, name_key, top_by

#: Letters that a name must have to stand for a longer one.
LEAST_PREFIX = 4
JUNK_EDGE = r"(?i)\b(with|by|from|of|and|or|the|a|an|co_mention|title_co_mention|cooccurrence|generic|unknown|mentioned|appears|found)\b"


def entity_documents(entities: DataFrame, mentions: DataFrame, *more: str) -> DataFrame:
    """(case_id, entity_id, document_id) and more columns of the entities, distinct, by case-insensitive name inside the case."""
    named = entities.select("case_id", F.col("id").alias("entity_id"), name_key("name").alias("name_key"), *more).filter("name_key <> ''")
    docs = mentions.select("case_id", name_key("entity_name").alias("name_key"), "document_id").filter("document_id is not null").distinct()
    return named.join(docs, ["case_id", "name_key"]).select("case_id", "entity_id", "document_id", *more).distinct()


def pairs(of: DataFrame, *more: str) -> DataFrame:
    """(case_id, entity_a_id, entity_b_id, n_documents) of entities that share documents of a case; more columns of both ends as name_a, name_b."""
    a, b = (of.select("case_id", "document_id", F.col("entity_id").alias(f"entity_{end}_id"), *[F.col(x).alias(f"{x}_{end}") for x in more]) for end in ("a", "b"))
    by = ["case_id", "entity_a_id", "entity_b_id", *[f"{x}_{end}" for x in more for end in ("a", "b")]]
    return a.join(b, ["case_id", "document_id"]).filter("entity_a_id < entity_b_id").groupBy(*by).agg(F.count("*").alias("n_documents"))


def co_mention(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Edges between entities that share documents, stronger with more of them."""
    n = F.col("n_documents")
    return pairs(entity_documents(entities, mentions)).withColumns(
        {
            "relationship_type": F.when(n >= 2, "repeated_association").otherwise("co_mention"),
            "confidence": case_of(0.70, (n >= 3, 0.88), (n >= 2, 0.80)),
        }
    )


def seed_documents(documents: DataFrame) -> DataFrame:
    """Documents (id, case_id, tier, priority) that seed a graph: aligned ones, in cases without any those of priority A or B."""
    aligned = F.coalesce(F.col("tier").isin("CORE", "RELEVANT"), F.lit(False))
    some = documents.filter(aligned).select("case_id").distinct().withColumn("some", F.lit(True))
    return documents.join(some, "case_id", "left").filter(F.when(F.col("some"), aligned).otherwise(F.col("priority").isin("PRIORITY_A", "PRIORITY_B"))).select(*documents.columns)


def seed_strength(edges: DataFrame) -> DataFrame:
    """(case_id, n_edges, n_strong) of a seed graph; strong pairs share two documents."""
    return edges.groupBy("case_id").agg(F.count("*").alias("n_edges"), F.count_if(F.col("n_documents") >= 2).alias("n_strong"))


def seed_graph(entities: DataFrame, mentions: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges over chosen documents only (id, case_id); both ends in a title or lead make the strongest."""
    good = documents.select(F.col("id").alias("document_id")).distinct()
    m = mentions.join(good, "document_id", "left_semi")
    front = m.filter(F.col("zone").isin("title", "dek", "lead")).select("case_id", name_key("entity_name").alias("name_key")).distinct()
    lead = entities.withColumn("name_key", name_key("name")).join(front, ["case_id", "name_key"], "left_semi").select("id")
    edges = pairs(entity_documents(entities, m))
    for end in ("a", "b"):
        edges = edges.join(lead.select(F.col("id").alias(f"entity_{end}_id"), F.lit(True).alias(f"lead_{end}")), f"entity_{end}_id", "left")
    both = F.coalesce(F.col("lead_a") & F.col("lead_b"), F.lit(False))
    kind = case_of("co_mention", (both, "title_co_mention"), (F.col("n_documents") >= 2, "repeated_association"))
    conf = case_of(0.70, (both, 0.88), (F.col("n_documents") >= 2, 0.82))
    return edges.select("case_id", "entity_a_id", "entity_b_id", "n_documents", kind.alias("relationship_type"), conf.alias("confidence"))


def provisional(entities: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """For cases without edges: all pairs of their first entities (at most ``most``, the cap of promotion)."""
    bare = entities.join(edges.select("case_id").distinct(), "case_id", "left_anti")
    top = top_by(bare, ["case_id"], ["id"], most)
    a, b = top.select("case_id", F.col("id").alias("entity_a_id")), top.select("case_id", F.col("id").alias("entity_b_id"))
    return a.join(b, "case_id").filter("entity_a_id < entity_b_id").withColumns({"relationship_type": F.lit("provisional_co_mention"), "confidence": F.lit(0.45)})


def suggested(entities: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of approved mentions that are not edges yet, graded by documents and by the types of their ends."""
    of = entity_documents(entities, mentions.filter("status = 'approved'"), "type")
    p = pairs(of, "type").join(edges.select("entity_a_id", "entity_b_id"), ["entity_a_id", "entity_b_id"], "left_anti")
    low, high = F.least("type_a", "type_b"), F.greatest("type_a", "type_b")
    pair = F.concat_ws("|", low, high)
    bonus = case_of(
        0.0,
        (pair.isin("government_agency|person", "agency|person"), 2.0),
        (pair.isin("company|person", "organization|person", "company|government_agency"), 1.5),
        (pair.isin("government_agency|organization", "agency|organization", "company|organization"), 1.0),
        (pair == "person|person", -0.5),
        (pair.isin("organization|organization", "company|company"), 0.5),
    )
    p = p.withColumn("score", F.col("n_documents") + bonus)
    p = p.withColumn("grade", case_of("LOW", (F.col("score") >= 3.5, "HIGH"), (F.col("score") >= 2, "MEDIUM")))
    noise = (F.col("grade") == "LOW") & (F.col("n_documents") <= 1) & (pair == "person|person")
    return p.filter(~noise).select("case_id", "entity_a_id", "entity_b_id", "n_documents", "score", "grade")


def ends(edges: DataFrame) -> DataFrame:
    return edges.select("case_id", F.explode(F.array("entity_a_id", "entity_b_id")).alias("entity_id")).filter("entity_id is not null")


def degree(edges: DataFrame) -> DataFrame:
    """(case_id, entity_id, degree)."""
    return ends(edges).groupBy("case_id", "entity_id").agg(F.count("*").alias("degree"))


def visible(entities: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """Entities of at least a degree whose names are not blank or numeric."""
    d = degree(edges).select(F.col("entity_id").alias("id"), "degree")
    return entities.join(d, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).filter((F.col("degree") >= least) & (F.trim("name") != "") & ~F.col("name").rlike(r"^[0-9\s.,-]+$"))


def ego(edges: DataFrame, centers: DataFrame) -> DataFrame:
    """(center, neighbour) for each of the centers (entity_id)."""
    c = centers.select(F.col("entity_id").alias("center")).distinct()
    both = edges.select(F.col("entity_a_id").alias("center"), F.col("entity_b_id").alias("neighbour")).union(edges.select("entity_b_id", "entity_a_id"))
    return both.join(c, "center", "left_semi").distinct()


def financial_links(signals: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Payer to receiver, matched to entities of the case by name, else by a prefix either way; one signal a pair, none that is an edge."""
    s = signals.select("id", "case_id", name_key(F.coalesce("controlled_by", "entity_name")).alias("payer"), name_key("received_by").alias("receiver")).filter("payer is not null and receiver is not null")
    names = entities.select("case_id", F.col("id").alias("entity_id"), name_key("name").alias("name_key"))
    wanted = s.select("case_id", F.explode(F.array("payer", "receiver")).alias("party")).distinct()
    # the heads of one side are looked up as whole names of the other; a whole name comes first
    heads = lambda c, last: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), last)), lambda n: F.substring(F.col(c), F.lit(1), n)), lambda x: F.length(x) >= LEAST_PREFIX)
    shorter = wanted.select("case_id", "party", F.explode(F.array_distinct(F.concat(heads("party", F.length("party")), F.array("party")))).alias("name_key")).join(names, ["case_id", "name_key"])
    longer = names.select("case_id", "entity_id", F.explode(heads("name_key", F.length("name_key") - 1)).alias("party")).join(wanted, ["case_id", "party"])
    found = shorter.select("case_id", "party", "entity_id", (F.col("name_key") != F.col("party")).alias("in_part")).union(longer.select("case_id", "party", "entity_id", F.lit(True)))
    match = found.groupBy("case_id", "party").agg(F.min(F.struct("in_part", "entity_id")).alias("m")).select("case_id", "party", "m.entity_id")
    linked = s.join(match.select("case_id", F.col("party").alias("payer"), F.col("entity_id").alias("source_id")), ["case_id", "payer"]).join(match.select("case_id", F.col("party").alias("receiver"), F.col("entity_id").alias("target_id")), ["case_id", "receiver"])
    linked = linked.filter("source_id <> target_id").withColumns({"entity_a_id": F.least("source_id", "target_id"), "entity_b_id": F.greatest("source_id", "target_id")})
    one = first_by(linked, ["entity_a_id", "entity_b_id"], ["id"])
    return one.join(edges.select("entity_a_id", "entity_b_id"), ["entity_a_id", "entity_b_id"], "left_anti").select("case_id", F.col("id").alias("signal_id"), "source_id", "target_id")


def co_mentioned(entities: DataFrame, mentions: DataFrame, k: int = 8) -> DataFrame:
    """For each entity the names most often approved in the same documents, by pairs of mentions.

    Counts per (case, document, name) are multiplied and summed, so pairs of mentions never become rows.
    """
    m = mentions.filter("status = 'approved'").select("case_id", "document_id", F.col("entity_name").alias("name"), name_key("entity_name").alias("name_key"))
    per = m.groupBy("case_id", "document_id", "name", "name_key").agg(F.count("*").alias("n"))
    own = entities.select("case_id", F.col("id").alias("entity_id"), name_key("name").alias("own_key")).join(per.groupBy("case_id", "document_id", F.col("name_key").alias("own_key")).agg(F.sum("n").alias("own_n")), ["case_id", "own_key"])
    both = own.join(per, ["case_id", "document_id"]).filter("own_key <> name_key").groupBy("case_id", "entity_id", "name").agg(F.sum(F.col("own_n") * F.col("n")).alias("n_pairs"))
    grade = case_of("LOW", (F.col("n_pairs") >= 3, "HIGH"), (F.col("n_pairs") >= 2, "MEDIUM"))
    return top_by(both, ["entity_id"], [F.desc("n_pairs"), "name"], k).withColumn("grade", grade)


def clean_edges(edges: DataFrame, k: int | None = None, missing: float = 1.0) -> DataFrame:
    """Edges of meaningful type and confidence of .3 or more (a null counts as ``missing``); the best k of each case if given."""
    kind = F.trim(F.coalesce("relationship_type", F.lit("")))
    kept = edges.filter((kind != "") & ~kind.rlike(JUNK_EDGE) & (F.coalesce("confidence", F.lit(missing)) >= 0.3))
    return kept if k is None else top_by(kept, ["case_id"], [F.desc("confidence"), "id"], k)


def named_edges(edges: DataFrame, entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """Edges with the names of their ends and how many pieces of evidence they have."""
    names = entities.select("id", "name")
    counted = evidence.groupBy(F.col("relationship_id").alias("id")).agg(F.count("*").alias("n_evidence"))
    out = edges.join(counted, "id", "left")
    for end in ("a", "b"):
        out = out.join(names.select(F.col("id").alias(f"entity_{end}_id"), F.col("name").alias(f"name_{end}")), f"entity_{end}_id", "left")
    named = [F.coalesce(f"name_{e}", F.concat(F.lit("Entity "), F.col(f"entity_{e}_id").cast("string"))).alias(f"name_{e}") for e in ("a", "b")]
    return out.select("id", "case_id", *named, "relationship_type", "confidence", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


def bridges(edges: DataFrame, entities: DataFrame, power: DataFrame) -> DataFrame:
    """Entities on any edge that are not among the power nodes (entity_id)."""
    on = ends(edges.filter("entity_a_id is not null and entity_b_id is not null")).select(F.col("entity_id").alias("id")).distinct()
    return entities.join(on, "id", "left_semi").join(power.select(F.col("entity_id").alias("id")).distinct(), "id", "left_anti").select("id", "case_id", "name")
