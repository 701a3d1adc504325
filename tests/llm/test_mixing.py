import re

import numpy as np

from casework.llm import mixing, queries


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(w[s] for s in order if s not in capped)
        t = {s: 3 * sizes[s] if s in capped else rest * w[s] / free for s in order}
        over = {s for s in order if t[s] > 3 * sizes[s]}
        if not over - capped:
            return t
        capped |= over


def check(rows, docs):
    sizes, by = {}, {}
    for r in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] = sizes.get(r.source, 0) + n
        by[r.doc_id] = (r.source, n)
    want, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    assert len(rows) == len(docs)
    for r in rows:
        s, n = by[r.doc_id]
        assert r["size"] == n and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken <= 3 * n and (n == 0 or r.taken % n == 0)
        taken[s] += r.taken
    return {s: abs(taken[s] - want[s]) for s in sizes}


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = queries.op5_mixing(spark, sf_dir).collect()
    off = check(rows, docs)
    most = {}
    for r in docs:
        most[r.source] = max(most.get(r.source, 0), len(r.text.split()))
    assert all(v <= most[s] for s, v in off.items())
    assert sorted(rows) == sorted(queries.op5_mixing(spark, sf_dir).collect())


def test_small_blocks_balance(spark):
    rng = np.random.default_rng(0)
    docs = [(i, "w " * int(n), None if i % 3 == 0 else f"s{i % 2}") for i, n in enumerate(rng.integers(0, 40, 600))]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    off = check(mixing.mix(df, block=16).collect(), df.collect())
    assert max(off.values()) <= 40


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "", None), (None, "x y", "a"), (None, "x y", "a")], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 4 and all(r.taken <= 3 * r["size"] for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_flight_keeps_the_totals():
    rng = np.random.default_rng(3)
    p, size = rng.random(500), rng.integers(1, 900, 500).astype(float)
    q = mixing.flight(p, size, rng)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-3


def test_clashing_names_one_id_for_all_and_a_very_long_text(spark):
    rows = [(None, f"w{i} " * (3 if i else 200_000), "s" if i % 3 else None, 1, 2, 3, 4) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _row int, _times int, _copy int, key int")
    out = mixing.apply_mix(docs, block=64)
    assert out.columns == docs.columns and out.count() > 0
    a, b = (sorted(map(repr, mixing.mix(docs.repartition(n), block=64).collect())) for n in (2, 5))
    assert a == b and len(a) == 600
