import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casework.llm import queries, spelling
from tests.llm.oracle import same


def edits(w, letters):
    cut = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    return ({a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in letters} | {a + c + b for a, b in cut for c in letters}) - {w}


def brute(counts):
    """(word, form, root, n, n_near, form_n) from all edits of every word."""
    letters = sorted({c for w in counts for c in w})
    form, n_near = {}, {}
    for w, n in counts.items():
        close = [x for x in edits(w, letters) if x in counts]
        n_near[w] = len(close)
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, n_near[w], counts[form[w]] if form[w] else None))
    return sorted(out)


def brute_counts(rows, damage=97):
    total = Counter()
    for k, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{k}:{w}".encode())
            if h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return total


def made(n, seed=0):
    rng = random.Random(seed)
    words = {"".join(rng.choices("etaoinshréß", k=rng.randint(1, 7))) for _ in range(n)}
    words |= {rng.choice(sorted(edits(w, "eté"))) for w in list(words)[: n // 2]} - {""}
    long = "abcdefgh" * 8
    words |= {long, long + "x", long[:-1], "q" + long[1:], "q" * 300, "q" * 301, "listen", "silent", "enlist", "tinsel"}
    return {w: rng.choice([1, 2, 3, 4, 8, 50, 900]) for w in sorted(words)}


@pytest.mark.parametrize("branch_rows", [10, 16_384])
def test_brute_force(spark, branch_rows):
    counts = made(400)
    df = spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, root int")
    got = spelling.variants(df, 2, branch_rows)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted(map(tuple, got.collect()))
    assert got == brute(counts)
    assert any(r[2] not in (r[0], r[1]) for r in got)  # a chain of more than one step


def test_one_class_of_anagrams_and_one_hot_branch(spark):
    """A third of the words share their letters; a branch that can't be cut is still whole."""
    rng = random.Random(5)
    counts = {w: 1 + i % 7 for i, w in enumerate({"".join(rng.sample("stoneria", 8)) for _ in range(600)} | {"".join(rng.sample("stonerib", 8)) for _ in range(600)})}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variants(df, 2, 50).collect())) == brute(counts)


@settings(max_examples=300, deadline=None)
@given(st.text("abé", max_size=6), st.text("abé", max_size=6))
def test_near(a, b):
    want = b in edits(a, "abé")
    assert spelling.near(a, b) == want
    if a and b:
        assert spelling.Words([a, b]).near(np.array([0]), np.array([1]))[0] == want


@settings(max_examples=50, deadline=None)
@given(st.sets(st.text("etnaoré", min_size=1, max_size=8), min_size=1, max_size=40))
def test_search_misses_no_pair(words):
    words = sorted(words)
    v = spelling.vectors(words)
    got = [(min(a, b), max(a, b)) for i, j in spelling.search(v, v, len(v)) for a, b in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got))
    assert {(a, b) for a in range(len(words)) for b in range(a) if spelling.near(words[a], words[b])} <= {(b, a) for a, b in got}


def test_words_of_odd_texts(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "Été É ÉTÉ été ×÷ x1y don't"), (None, "null id"), (4, "word " * 3000), (4, "word " * 3000), (5, "A" * 5000), (6, "日本 ＡＢ Ĳİ")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int")
    want = brute_counts([("" if k is None else k, t) for k, t in rows], 3)
    got = {r.word: r.n for r in spelling.word_counts(df, damage=3).collect()}
    assert got == {w: n for w, n in want.items() if w}
    monkeypatch.setattr(spelling, "AT_ONCE", 5)
    assert {r.word: r.n for r in spelling.word_counts(df, damage=3).collect()} == got
    assert spelling.variants(spelling.word_counts(df.limit(0))).count() == 0


def test_query_equals_sql(spark, sf_dir):
    same(queries.op12_spelling(spark, sf_dir), queries.ORACLE_SQL["op12_spelling"], sf_dir)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    counts = {w: n for w, n in brute_counts(rows).items() if len(w) >= 5 and n >= 3}
    got = sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in queries.op12_spelling(spark, sf_dir).collect())
    assert got == brute(counts) and any(r[1] for r in got)
