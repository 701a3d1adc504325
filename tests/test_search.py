import random

from pyspark.sql import functions as F

from casework.operators import search


def test_found_against_a_plain_scan_in_memory_and_written(spark, tmp_path):
    rng = random.Random(0)
    texts = [(i, "".join(rng.choices("abAB é", k=rng.randint(0, 12)))) for i in range(300)] + [(900, None), (901, ""), (902, "a"), (903, "x" * 500)]
    asked = ["", "a", "B", "é", "ab", "ABA", "abab", "b a", "bé ab", "zz", "zzz", "abz", "xxxx", None]
    rows = spark.createDataFrame(texts, "id long, name string")
    queries = spark.createDataFrame([(q,) for q in asked * 2], "query string")
    want = sorted((q, i) for q in asked if q for i, t in texts if t and q.lower() in t.lower())
    search.write_index(rows, "name", f"{tmp_path}/index")
    for index in (search.indexed(rows, "name"), search.read_index(spark, f"{tmp_path}/index")):
        assert sorted((r.query, r.id) for r in search.found(index, queries).collect()) == want
    assert search.found(search.indexed(rows.limit(0), "name"), queries).count() == 0 and search.found(search.indexed(rows, "name"), queries.limit(0)).count() == 0


def test_written_index_is_read_in_part(spark, tmp_path):
    rows = spark.range(3000).select("id", F.format_string("name %04d", "id").alias("name"))
    search.write_index(rows, "name", f"{tmp_path}/index")
    hits = search.found(search.read_index(spark, f"{tmp_path}/index"), spark.createDataFrame([("e 0042",)], "query string"))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    folders = set(plan.split("PartitionFilters: [")[1].split("]")[0].replace("(", " ").replace(")", " ").replace(",", " ").split())
    assert sum(x.isdigit() for x in folders) <= 4 and [r.id for r in hits.collect()] == [42]


def test_the_index_is_not_broadcast(spark, tmp_path):
    spark.range(3000).select("id", F.format_string("title %04d", "id").alias("name")).write.parquet(f"{tmp_path}/rows")  # a small file, of which Spark would broadcast all groups
    rows, queries = spark.read.parquet(f"{tmp_path}/rows"), spark.createDataFrame([("e 0042",), ("LE 1",), ("zzz",)], "query string")
    hits = search.found(search.indexed(rows, "name"), queries)
    hits.collect()
    plan = hits._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BuildRight" in plan and "BuildLeft" not in plan and "Generate" not in plan.split("BroadcastExchange")[1]
    assert sorted({r.query for r in hits.collect()}) == ["LE 1", "e 0042"] and hits.count() == 1001


def test_documents_are_not_broadcast(spark):
    rows = spark.range(100).select("id", (F.col("id") % 5).alias("case_id"), F.format_string("title %04d", "id").alias("title"))
    hits = search.title_search(rows, spark.createDataFrame([("e 0042",)], "query string"))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert [x for x in plan.split() if x.endswith("Join")][0] == "SortMergeJoin"
    assert [tuple(r) for r in hits.collect()] == [("e 0042", 42, 2, "title 0042")]
