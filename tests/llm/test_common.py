import random

from pyspark.sql import functions as F

from casework.llm import common


def test_components_in_one_task_and_in_many(spark, monkeypatch):
    r = random.Random(0)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(1, 200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = {x: find(x) for x in parent}
    df = spark.createDataFrame(edges, "a long, b long")
    for most in (10**6, 0):
        monkeypatch.setattr(common, "ONE_TASK", most)
        got = common.components(df).collect()
        assert len(got) == len(want) and {x.id: x.component for x in got} == want
    assert common.components(df.limit(0)).count() == 0


def test_look_up_both_ways(spark):
    big, small = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "k long, x string"), spark.createDataFrame([(1, 10)], "k long, y long")
    for most in (5, 0):
        assert sorted((r.k, r.x, r.y) for r in common.look_up(big, small, ["k"], max_rows=most).collect()) == [(1, "a", 10), (1, "c", 10), (2, "b", None)]


def test_a_sample_of_any_number_of_rows_is_not_empty(spark):
    rows = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    for of in (2 * 10**5, 10**10, 10**15):
        n = rows.filter(common.sampled(F.col("h"), of / 100, of)).count()
        assert 1800 < n < 2200
    # at the least share that a hash can tell apart, a small hash is still in
    small = spark.createDataFrame([(5,), (-1,)], "h long")
    assert small.filter(common.sampled(F.col("h"), 2000, 10**13)).count() == 1
