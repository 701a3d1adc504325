from pyspark.sql import functions as F

from casework.functions import relevance
from casework.plans import rule_plans


def test_one_reading_counts_what_each_list_holds(spark):
    texts = ["", "the audit of grants", "contracts and subcontractors' contract budgets", "scoreboard; newsletter, press release prnewswire", "tax credit tax  credit investigation", "İstanbul state estate statement é grant"]
    rows = [(i, t, b) for i, (t, b) in enumerate((t, b) for t in texts for b in texts)]
    df = spark.createDataFrame(rows, "i int, t string, b string")
    for r in df.select("*", relevance.lexicon_hits(F.col("t"), F.col("b")).alias("h")).collect():
        of = lambda words, in_title: sum((w in r.t) if in_title else (w in r.b and w not in r.t) for w in words)
        want = (of(relevance.INVESTIGATIVE, True), of(relevance.INVESTIGATIVE, False), of(relevance.FLUFF, True), of(relevance.FLUFF, False), sum(w in r.t or w in r.b for w in relevance.PR_WIRE))
        assert tuple(r.h) == want, (r.t, r.b)


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "An audit", "The audit of the harbor fund. " * 9, "apnews.com", "finance_funding", "general", ["harbor"], 0.1, 7, 8, 9)], "id int, title string, text string, domain string, intent string, mode string, terms array<string>, boilerplate_ratio double, _t int, _a int, relevance int")
    df = df.withColumn("anchor", relevance.anchor(F.col("terms"), F.col("mode")))
    out = relevance.document_relevance(df)
    r = out.first()
    assert out.columns == [*[c for c in df.columns if c != "relevance"], "relevance"] and (r._t, r._a, r.id, r.title) == (7, 8, 1, "An audit") and r.relevance.score > 50
    assert relevance.document_relevance(df.limit(0)).count() == 0
    nulls = df.select("id", *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in ("title", "text", "domain")], "intent", "mode", "terms", "boilerplate_ratio", "anchor")
    assert relevance.document_relevance(nulls).first().relevance.score < 50


def test_news_are_dealt_to_all_cores(spark, sf_dir):
    df = rule_plans.PLANS["document_relevance"][0](spark, sf_dir)
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_anchor_without_words(spark):
    df = spark.createDataFrame([(["harbor"], "the harbor", True), ([], "the harbor", False), (None, "the harbor", False)], "w array<string>, t string, hit boolean")
    a = F.struct(F.col("w").alias("words"), F.col("w").alias("strong"), F.col("w").alias("against"))
    for r in df.select("*", *[x.alias(k) for k, x in relevance.anchor_hits(F.col("t"), F.col("t"), F.col("t"), a).items()]).collect():
        assert r._title_hit == r._lead_hit == r._against == r.hit


def test_documents_of_counters_are_cleaned_in_arrow_batches(spark, sf_dir):
    d = rule_plans._news(spark, sf_dir).select("case_id", "relevance.priority", "relevance.tier")
    assert "top stories" not in d._jdf.queryExecution().optimizedPlan().toString()
