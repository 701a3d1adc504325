import re

import pyarrow as pa
from pyspark.sql import functions as F

from casework.functions import matching
from casework.functions import mention_rules as rules
from casework.functions import parties, text
from casework.operators import mentions, promotion

TEXTS = ["the justice department", "a justice said", "an audit of justice  department, justice done", "", None, "a judge", "The quarterback of HUD", "an audit of justice  department, justice done"]


def test_masks_are_those_of_each_pattern():
    patterns = [p for p, _, _ in rules.ROLES]
    want = [None if t is None else sum(1 << i for i, p in enumerate(patterns) if re.search(p, t, re.ASCII)) for t in TEXTS]
    assert matching.masks(pa.array(TEXTS), patterns).to_pylist() == want
    assert matching.masks(pa.array([None, None], pa.string()), patterns).to_pylist() == [None, None]


def test_rules_of_mentions_are_not_hundreds_of_expressions(spark):
    # a pattern each was more code than one method of the JVM takes
    df = spark.createDataFrame([("Harbor Council", "The federal judge said so.", "person", "general")], "n string, c string, k string, i string")
    out = df.select(rules.role(F.col("c"), F.col("k")).alias("r"), rules.topic(F.col("n"), F.col("c"), F.array(F.lit("harbor")), F.col("i")).alias("t"), rules.is_menu_text(F.col("n")).alias("m"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and out.first().asDict(True) == {"r": {"role": "COURT_JUDGE", "confidence": 0.88}, "t": "HIGH", "m": False}


def test_zones_are_taken_once_a_document(spark):
    df = spark.createDataFrame([(1, 2, "Harbor Council and Metro Bank met Jordan Petrov."), (2, 2, None), (3, 2, "")], "document_id long, case_id long, text string")
    out = mentions.mentions(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("aggregate(split") and {r.entity_name for r in out.collect()} == {"Harbor Council", "Metro Bank", "Jordan Petrov"}


def test_party_phrases_are_taken_once(spark):
    # the phrase behind a verb stood in eight places of one expression, each computing it again
    s = F.col("s")
    df = spark.createDataFrame([("Harbor Trust was awarded to Metro Bank by the council",), ("no verb of that kind",), (None,)], "s string")
    out = df.select(parties.after(s, parties.RECEIVE).alias("a"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 2 and [r.a for r in out.collect()] == ["Metro Bank", None, None]


def test_types_of_sentences_are_one_reading(spark):
    out = spark.createDataFrame([("The audit found it",), ("Nothing",), (None,)], "s string").select(text.event_type(F.col("s")).alias("e"), text.signal_type(F.col("s")).alias("g"))
    assert "RLIKE" not in out._jdf.queryExecution().optimizedPlan().toString() and [r.e for r in out.collect()] == ["AUDIT", "EVENT", "EVENT"]


def test_keys_of_clusters_are_made_of_distinct_names(spark):
    rows = [(1, 7, 10, "Harbor Council"), (2, 7, 11, "Harbor Council"), (3, 7, 11, "harbor council"), (4, 7, 12, None), (5, None, 12, "Harbor Council")]
    m = spark.createDataFrame(rows, "id long, case_id long, document_id long, entity_name string").selectExpr("*", "'agency' as entity_type", "0.7D as confidence", "'PERSON' as role", "'HIGH' as topic", "'lead' as zone", "'a grant' as context")
    docs = spark.createDataFrame([(10, "Harbor Council", "PRIORITY_A", "CORE", "low")], "document_id long, title string, priority string, tier string, contamination string")
    of = spark.createDataFrame([(7, "harbor council", "harbor council")], "case_id long, name_key string, cluster string")
    out = promotion.features(m, of, docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan  # a written table: what reads it many times makes it once
    r = out.collect()
    assert len(r) == 1 and (r[0].n_mentions, r[0].n_documents, r[0].title_hits, r[0].first_id) == (3, 2, 1, 1)
    f = mentions.cluster_features(m, of).collect()
    assert len(f) == 1 and (f[0].n_mentions, f[0].n_documents) == (3, 2)
