import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from casework.llm import negatives, queries
from tests.llm.oracle import same


def brute(rows, anchor, n_positives=5, k=5):
    usable = [(i, n, l, [math.floor(256 * float(x)) for x in v]) for i, (n, v, l) in enumerate(rows) if n is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, n, l, q in usable:
        if anchor(n):
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, d)))), m, l != o) for j, m, o, d in usable if j != i and len(d) == len(q))
            for s, m, _ in [x for x in scored if not x[2]][:n_positives]:
                found = [(t, x) for t, x, other in scored if other and 80 * -s <= 100 * -t <= 100 * -s][:k]
                out += [(n, m, r + 1, x, -s, -t) for r, (t, x) in enumerate(found)]
    return sorted(out)


def test_query_equals_sql(spark, sf_dir):
    same(queries.op13_negatives(spark, sf_dir), queries.ORACLE_SQL["op13_negatives"], sf_dir)


def made(seed=0, n=300, dim=6):
    """Clusters whose labels mix, one label and one vector of a third of the rows, and odd rows."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, dim))
    rows = [(i, [float(np.float32(x)) for x in centers[i % 5] + rng.normal(size=dim) * 0.2], int(rng.integers(4)) if i % 3 else 0) for i in range(n)]
    rows += [(1000 + i, rows[10][1], i % 2) for i in range(n // 2)]
    rows += [(10, rows[7][1], 1), (None, rows[3][1], 1), (2000, None, 1), (2010, rows[4][1], None), (2020, [1.0, None] * (dim // 2), 1), (2030, [float("nan")] * dim, 0), (2040, [0.0] * dim, 0), (2050, [1.0, 2.0], 0), (2051, [1.0, 2.0], 0), (2052, [1.0, 1.5], 2), (2060, [], 0), (2061, [], 0), (2062, [], 1), (2070, [-1.0, -2.0], 3), (2071, [1.0, 2.0], 3)]
    return rows


@pytest.mark.parametrize("block", [40, 8192])
def test_brute_force_with_odd_rows_ties_and_blocks(spark, block):
    rows = made()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as row", "2 as v", "3 as home", "4 as score")
    got = sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"), block=block).collect()))
    want = brute(rows, lambda n: n % 10 == 0)
    assert got == want and len({r[1] for r in want}) > 5
    assert any(r[4] == 0 for r in want)  # a window at zero


def test_large_scores_are_exact(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=4) * 1e5
    rows = [(i, [float(np.float32(x)) for x in base + rng.normal(size=4) * 1e4], i % 2) for i in range(60)] + [(100 + i, [float(np.float32(x)) for x in 1e5 * base], i % 2) for i in range(4)] + [(110, [3e38] * 4, 0), (111, [3e38] * 4, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, F.col("label")).collect())) == brute(rows, lambda n: n % 5 == 0)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, F.col("label")).count() == 0


def sides(x, y):
    import pandas as pd

    every = np.concatenate([x, y])
    refs = negatives.pick_pivots(negatives._units(every)[1], 16)
    out = []
    for v in (x, y):
        norm, unit = negatives._units(v)
        angle = np.arccos(np.clip(unit @ refs.T, -1, 1))
        out.append(pd.DataFrame({"row": np.arange(len(v)), "id": np.arange(len(v)), "label": 0, "v": [r.tobytes() for r in v], "norm": norm, "angles": list(angle), "home": angle.argmin(1)}))
    return negatives._sides(*out, x.shape[1])


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(20, 8)) * 2000
    x = np.floor(np.concatenate([c + rng.normal(size=(100, 8)) * 20 for c in centers]))
    a, d = sides(x[::50], x)
    tiles = negatives.Tiles(d)
    s = a.x @ d.x.T
    low, high = negatives.tile_bounds(a, tiles.lo, tiles.hi, tiles.norm_lo, tiles.norm_hi)
    for t, at in enumerate(tiles.at):
        assert (low[:, t] <= s[:, at].min(1)).all() and (s[:, at].max(1) <= high[:, t]).all()
        near, far = negatives.row_bounds(a, np.arange(a.n), d, at, tiles.close[t])
        assert (near <= s[:, at]).all() and (s[:, at] <= far).all()
    best = negatives.Best(a.n, 5)
    scored, pairs = negatives.walk(a, d, lambda at: (best.worst[at], np.full(len(at), np.inf)), lambda at, j, s: best.add(at, s, np.broadcast_to(d.id[j], s.shape).copy()))
    assert scored < 0.2 * pairs
    assert (best.score == -np.sort(-s, axis=1)[:, :5]).all()
