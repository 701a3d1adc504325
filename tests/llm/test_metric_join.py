import numpy as np

from casework.llm import metric_join, queries
from tests.llm.oracle import same


def brute(rows, t=0.9):
    ok = [(i, n, np.array(v, float)) for i, (n, v) in enumerate(rows) if n is not None and v and all(x is not None and np.isfinite(x) for x in v) and np.any(np.array(v, float))]
    links = {i: [j for j, _, y in ok if j != i and len(y) == len(x) and x @ y / np.sqrt((x @ x) * (y @ y)) >= t] for i, _, x in ok}
    out = []
    for i, (n, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = n if n is None else min(rows[j][0] for j in seen)
        out.append((n, len(links.get(i, [])), c, n is None or n == c))
    return sorted(out, key=repr)


def test_query_equals_sql(spark, sf_dir):
    same(queries.op4_metric_join(spark, sf_dir), queries.ORACLE_SQL["op4_metric_join"], sf_dir)


def clustered(seed, dim, n):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    return [(int(i), [float(np.float32(x)) for x in base[i % 12] + rng.normal(size=dim) * rng.choice([0.05, 0.25, 0.45])]) for i in rng.permutation(n)]


def test_many_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "CELL_ROWS", 20)
    for dim in (3, 12):
        rows = clustered(dim, dim, 260)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
        got = metric_join.near_duplicates(df, block=16).collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(3, v), (1, v), (2, [2.0, 4.0, 6.0]), (9, None), (8, [0.0] * 3), (7, [1.0, None, 2.0]), (6, [float("inf")] * 3), (None, v), (5, [1.0, 2.0]), (4, []), (11, [1e38, 2e38, 3e38]), (12, v), (12, v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, metric_join.near_duplicates(df).collect()), key=repr) == brute(rows)
    assert metric_join.near_duplicates(df.limit(0)).count() == 0
