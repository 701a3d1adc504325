import math
import zlib
from collections import Counter

import numpy as np

from casework.llm import ngram_lm, queries

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in WHITE:
        low = low.replace(c, " ")
    return [*[w for w in low.split(" ") if w], None]


def brute(docs, held):
    c = Counter(t for k, text in docs if not held(k) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    return n, {(k, text): (len(tokens(text)), sum(c[t] > 0 for t in tokens(text)), sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(text))) for k, text in docs}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    n, want = brute(docs, held)
    want = {k: x for (k, _), x in want.items()}
    rows = queries.op10_ngram_lm(spark, sf).collect()
    assert len(rows) == len(docs)
    better = 0
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), *want[r.doc_id][:2], n)
        assert abs(r.base_score - want[r.doc_id][2]) < 1e-6 * max(1, abs(r.base_score))
        assert r.score < 0
        better += r.score >= r.base_score
    assert better > 0.8 * len(rows)


def test_broadcast_or_not_and_a_small_dictionary(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    scored = lambda counts, **k: {r.doc_id: r for r in ngram_lm.score(docs, counts, **k).collect()}
    one = ngram_lm.train(docs)
    many = ngram_lm.train(docs, slot_bytes=20_000)
    few = ngram_lm.train(docs, dict_rows=100, slot_bytes=20_000)
    assert one.slots == 1 and many.slots > 10 and len(few.frequent.token) <= 100
    a = scored(one)
    b = scored(many)
    for x, y in ((a, scored(one, filter_bytes=0)), (b, scored(many, filter_bytes=0))):  # but for the order of sums
        assert all(abs(r.score - y[k].score) < 1e-6 and r.n_known == y[k].n_known and abs(r.base_score - y[k].base_score) < 1e-6 for k, r in x.items())
    c = scored(few, filter_bytes=0)
    for k, r in a.items():
        for other in (b[k], c[k]):
            assert (other.n_tokens, other.n_known) == (r.n_tokens, r.n_known) and abs(other.base_score - r.base_score) < 1e-6
        # other slots have other false hits; counts of histories outside the broadcast part are rounded down
        assert abs(b[k].score - r.score) < 0.05 * r.n_tokens and abs(c[k].score - r.score) < 0.1 * r.n_tokens


def test_scores_against_exact_counts(spark):
    """The model with exact counts of pairs, on texts that training lacks."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    learn, other = docs[: len(docs) // 2], docs[len(docs) // 2 :]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    pairs, hist, c = Counter(), Counter(), Counter()
    for _, text in learn:
        t = tokens(text)
        pairs.update(zip([0, *t], t, strict=False))
        hist.update([0, *t[:-1]])
        c.update(t)
    n_all = sum(c.values()) + len(c) + 1
    p = lambda h, w, q: (q + ngram_lm.K * (c[w] + 1) / n_all) / (hist[h] + ngram_lm.K)
    exact = {k: sum(math.log10(p(h, w, pairs[h, w])) for h, w in zip([0, *tokens(text)], tokens(text), strict=False)) for k, text in other}
    counts = ngram_lm.train(frame(learn))
    off = 0.0
    for r in ngram_lm.score(frame(other), counts).collect():
        assert abs(r.score - exact[r.doc_id]) < 0.02 * r.n_tokens + 3
        off += abs(r.score - exact[r.doc_id]) / r.n_tokens / len(other)
    assert off < 0.02
    # the probabilities of a history sum to 1 at most, and to 1 / BASE at least
    for h, _ in hist.most_common(20):
        rounded = lambda n: float(ngram_lm.count_at(ngram_lm.levels(np.array([n])))[0]) if n else 0.0
        total = sum(p(h, w, rounded(pairs[h, w])) for w in c) + p(h, "unseen", 0)
        assert 1 / ngram_lm.BASE <= total <= 1 + 1e-9


def test_filter_gives_levels_back():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**32, 20_000).astype(np.uint32))
    q = rng.integers(1, 30, len(keys))
    raw = ngram_lm.segment(keys, q)
    got = ngram_lm.level_in(raw, keys)
    assert (got >= q).all() and (got > q).mean() < 0.001
    other = np.setdiff1d(rng.integers(0, 2**32, 20_000).astype(np.uint32), keys)
    assert (ngram_lm.level_in(raw, other) > 0).mean() < 0.001 and not ngram_lm.level_in(None, keys).any()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "A a\x0ba"), (2, "a a a"), (2, "a a a")], "doc_id long, text string")
    counts = ngram_lm.train(docs)
    rows = ngram_lm.score(docs, counts).collect()
    assert counts.n == 14 and counts.v == 2 and len(rows) == 5
    n, want = brute([(r.doc_id, r.text) for r in docs.collect()], lambda k: False)
    assert sorted(round(r.base_score, 9) for r in rows) == sorted(round(x[2], 9) for k, x in want.items() for _ in range(2 if k[0] == 2 else 1))
    empty = docs.limit(0)
    assert ngram_lm.score(empty, ngram_lm.train(empty)).count() == 0
    assert [r.base_score for r in ngram_lm.score(docs.limit(1), ngram_lm.train(empty)).collect()] == [0.0]


def test_pairs_seen_once_are_stored(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = ngram_lm.score(docs, ngram_lm.train(docs)).collect()
    # each pair and its history are seen once, or the first of 40: p is at least 1 / (1 + K)
    assert all(r.score > r.n_tokens * math.log10(1 / (1 + ngram_lm.K)) - 3 and r.base_score < -3 * 50 for r in rows)


def test_levels_of_counts():
    c = np.arange(1, 2000)
    q = ngram_lm.levels(c)
    assert list(ngram_lm.count_at(q[:4])) == [1, 2, 3, 4] and ngram_lm.count_at(np.array([0]))[0] == 0
    assert (ngram_lm.count_at(q) <= c).all() and (ngram_lm.count_at(q) * ngram_lm.BASE > c - 1).all()


def test_a_very_long_text_and_clashing_names(spark):
    long = "a b " * 300_000
    docs = spark.createDataFrame([(1, long, 5, 6), (2, "a b", 5, 6)], "doc_id long, text string, row long, slot long")
    rows = {r.doc_id: r for r in ngram_lm.score(docs, ngram_lm.train(docs)).collect()}
    assert rows[1].n_tokens == 600_001 and rows[2].n_tokens == 3
