import math

import numpy as np
from pyspark.sql import functions as F

from casework.llm import queries, topk
from tests.llm.oracle import same


def brute(rows, asked, k):
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    usable = [(i, n, [math.floor(1024 * float(x)) for x in v]) for i, (n, v) in enumerate(rows) if n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, n, q in usable:
        if asked(n):
            best = sorted((-clip(sum(a * b for a, b in zip(q, d, strict=True))), m) for j, m, d in usable if j != i and len(d) == len(q))[:k]
            out += [(n, r + 1, m, -s) for r, (s, m) in enumerate(best)]
    return sorted(out)


def test_query_equals_sql(spark, sf_dir):
    same(queries.op1_topk(spark, sf_dir), queries.ORACLE_SQL["op1_topk"], sf_dir)


def test_brute_force_with_odd_rows_ties_and_many_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(20)] + [(7, rows[7][1]), (None, rows[3][1]), (5, None), (10, [1.0, None] * 3), (20, [float("nan")] * 6), (30, [1e30] * 6), (40, [1.0, 2.0]), (41, [2.0, 2.0]), (50, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df.selectExpr("*", "1 as row", "2 as v"), F.col("vec_id") % 10 == 0, 5, query_bytes=400).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda n: n % 10 == 0, 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0, 5).count() == 0


def test_scores_of_large_vectors_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 4e5]) for i in range(60)] + [(100 + i, [float(np.float32(x)) for x in rng.normal(size=4) * 1e9]) for i in range(20)]
    rows += [(200, [786432.5, 1.0, 0.0, 0.0]), (210, [786432.5, 1.0, 0.0, 0.0009765625]), (220, [786432.5, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") % 5 == 0, 8).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda n: n % 5 == 0, 8) and any(abs(r.score) > 2**53 for r in got)


def test_walk_prunes_and_is_exact():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(20, 8)) * 2000
    x = np.floor(np.concatenate([c + rng.normal(size=(100, 8)) * 20 for c in centers]))
    q = x[::100]
    best = topk.Best(len(q), 10)
    ids = np.arange(len(x))
    scored = topk.search(topk.Tree(q, leaf=1), -1 - np.arange(len(q)), topk.Tree(x), ids, ids, best)
    assert scored < 0.4 * len(q) * len(x)
    s = q @ x.T
    for i in range(len(q)):
        assert best.id[i].tolist() == np.lexsort((ids, -s[i]))[:10].tolist()


def test_trees_cover_their_rows():
    x = np.random.default_rng(2).normal(size=(500, 5))

    def walk(node):
        center, radius, size, kids, rows = node
        assert np.sqrt(((x[rows] - center) ** 2).sum(1)).max() <= radius + 1e-9
        if kids:
            assert sorted(np.concatenate([k[4] for k in kids]).tolist()) == sorted(rows.tolist())
            list(map(walk, kids))

    walk(topk.Tree(x).root)
