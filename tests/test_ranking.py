import random

from pyspark.sql import functions as F

from casework.functions import text
from casework.operators import compiling, dossier, graph, money, ranking


def test_ranks_of_a_giant_group(spark):
    """A third of the rows in one group, a null group, ties of the order told apart by id; groups of one."""
    rng = random.Random(0)
    rows = [(1 if i % 3 == 0 else None if i % 50 == 1 else i % 40, rng.choice([None, *range(50)]), i) for i in range(6000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "case_id long, v long, id long")
    plain = ranking.ranked(df, ["case_id"], [F.desc_nulls_last("v"), "id"])
    whole = ranking.ranked_whole(df, ["case_id"], [F.desc_nulls_last("v"), "id"])
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, plain.collect())) and whole.schema["rank"] == plain.schema["rank"]
    assert ranking.ranked_whole(df.limit(0), ["case_id"], ["id"]).count() == 0


def test_no_window_or_join_on_the_case_alone(spark):
    docs = spark.range(100).select((F.col("id") % 3).alias("case_id"), F.current_date().alias("publish_date"), "id")
    plan = dossier.evidence_order(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_range" in plan and "row_number() windowspecdefinition(case_id" not in plan
    signals = docs.select("case_id", "id", *[F.concat(F.lit(x), F.col("id") % 7).alias(x) for x in ("controlled_by", "entity_name", "received_by")])
    names = docs.select("case_id", "id", F.concat(F.lit("received_by"), F.col("id") % 7).alias("name"))
    edges = spark.createDataFrame([], "entity_a_id long, entity_b_id long")
    plan = graph.financial_links(signals, names, edges)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join Inner" in x]
    assert joins and all("AND" in x for x in joins)


def test_links_by_the_head_of_a_name(spark):
    s = spark.createDataFrame([(1, 1, "Harbor", None, "Apex Construction Group"), (2, 1, "Harbor Council of the North", None, "apex"), (3, 2, "Harb", None, "Apex"), (4, 1, "Har", None, "Apex Co"), (5, 1, None, "HARBOR COUNCIL", "Apex Co")], "id long, case_id long, controlled_by string, entity_name string, received_by string")
    e = spark.createDataFrame([(10, 1, "Harbor Council"), (11, 1, "Apex"), (12, 1, "Apex Construction"), (13, 2, "Harbor"), (14, 1, ""), (15, 1, None)], "id long, case_id long, name string")
    got = sorted(map(tuple, graph.financial_links(s, e, spark.createDataFrame([], "entity_a_id long, entity_b_id long")).collect()))
    assert got == [(1, 1, 10, 11)]
    some = graph.financial_links(s.filter("id <> 1"), e, spark.createDataFrame([], "entity_a_id long, entity_b_id long"))
    assert sorted(map(tuple, some.collect())) == [(1, 2, 10, 11)]


def test_texts_that_hold_names_of_any_length(spark):
    rng = random.Random(2)
    texts = [(c, i, "".join(rng.choices("ab ", k=rng.randint(0, 14)))) for c in (1, 2) for i in range(80)]
    names = list({(c, "".join(rng.choices("ab ", k=rng.randint(0, 8)))) for c in (1, 2, 3) for _ in range(40)})
    t, n = spark.createDataFrame(texts, "case_id long, id long, t string"), spark.createDataFrame(names, "case_id long, name string")
    got = sorted((r.case_id, r.id, r.name) for r in ranking.holding(t, n, "t", "name", ["case_id"]).collect())
    assert got == sorted((c, i, m) for c, i, x in texts for k, m in names if k == c and m and m in x)
    assert ranking.holding(t, n.limit(0), "t", "name", ["case_id"]).count() == 0


def test_flow_trace_ranks(spark, sf_dir):
    from casework.sources.views import load

    rows = money.flow_trace(load(spark, sf_dir, "signals")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.case_id, []).append(r["rank"])
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in by.values())


def test_names_are_judged_once_a_case_and_files_by_their_status(spark):
    # the patterns of names follow the written counts; the status of a file is read without a map of its marker
    rows = [(1, "Harbor Council", i, 0.5) for i in range(4)] + [(1, "12345", i, 0.9) for i in range(4)] + [(1, "x" * 61, 1, 0.9), (1, "Metro", 1, 0.6), (1, None, 2, 0.6)]
    mentions = spark.createDataFrame(rows, "case_id long, entity_name string, document_id long, confidence double")
    entities = spark.createDataFrame([(5, 1, "harbor council ", "agency")], "id long, case_id long, name string, type string")
    best = compiling.ranked_entities(mentions, entities)
    assert [(r.entity_name, r.type, r.n_mentions, r.is_primary) for r in best.orderBy("entity_name").collect()] == [("Harbor Council", "agency", 4, True), ("Metro", "location", 1, False)]
    assert "document_id" not in best._jdf.queryExecution().optimizedPlan().toString()
    markers = ["[DIAG:status=failed|score=1] ", " [WEB-DIAG:score=1|status=failed|status=valid] ", "[DIAG:xstatus=failed] ", "[DIAG:status=] ", "[DIAG:] ", "", "[DIAG:status=a=wrapper] ", "[DIAG:a=b|status=wrapper] ", None]
    files = spark.createDataFrame([(i, None if m is None else m + "y" * 100) for i, m in enumerate(markers)], "id long, raw_text string")
    left = compiling.usable(files)
    assert [r.id for r in left.orderBy("id").collect()] == [1, 2, 3, 4, 5, 6]
    assert "map_from_arrays" not in left.select("id")._jdf.queryExecution().optimizedPlan().toString()
    same = files.select((text.diag_map(F.col("raw_text"))["status"].eqNullSafe(text.diag_value(F.col("raw_text"), "status"))).alias("same"))
    assert all(r.same for r in same.collect())
