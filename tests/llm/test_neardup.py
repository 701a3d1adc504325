import random
import re
from collections import defaultdict

import numpy as np

from casework.llm import neardup, queries
from tests.llm.oracle import same


def brute(rows, words, percent=80):
    """Classes of rows (id, text), by all pairs that share a shingle."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    by, parent = defaultdict(list), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, s in enumerate(sets):
        for x in sorted(s):
            by[x].append(i)
    for i, s in enumerate(sets):
        near = defaultdict(int)
        for x in s:
            for j in by[x]:
                if j < i:
                    near[j] += 1
        for j, both in near.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        if k is not None:
            least[r] = min(k, least.get(r, k))
    return sorted(((k, len(sets[i]), least.get(find(i)), k == least.get(find(i)) or least.get(find(i)) is None) for i, (k, _) in enumerate(rows)), key=repr)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op8_neardup(spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 2)
    assert sum(not r.kept for r in got) > 20


def test_query_equals_sql(spark, sf_dir):
    same(queries.op8_neardup(spark, sf_dir), queries.ORACLE_SQL["op8_neardup"], sf_dir)


def planted(seed, n=60, common=0):
    """Groups of copies at all distances around the threshold, with a passage that many share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    passage, rows = [word() for _ in range(40)], []
    for g in range(n):
        base = [word() for _ in range(r.choice([1, 2, 3, 8, 30, 120]))]
        for _ in range(r.choice([1, 2, 3, 12])):
            w = [word() if r.random() < r.choice([0, 0.02, 0.05, 0.08]) else x for x in base]
            rows.append((len(rows), " ".join(w + (passage if g < common else []))))
    return r.sample(rows, len(rows))


def test_planted_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 4)
    for seed, common, words in ((1, 0, 2), (2, 40, 2), (3, 20, 5)):
        rows = planted(seed, common=common)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert sorted(map(tuple, neardup.classes(df, words=words).collect()), key=repr) == brute(rows, words)


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 8)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    r = random.Random(5)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(60)]
    rows = [(i, " ".join(f"x{r.randint(0, 10**6)}" if r.random() < 0.05 else w for w in base)) for i in range(220)] + [(1000 + i, f"other text {i} here") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, neardup.classes(df, words=2).collect()), key=repr) == brute(rows, 2)


def test_odd_rows(spark):
    rows = [(3, None), (4, ""), (5, " \n"), (9, "one"), (8, "ONE"), (7, "one two"), (6, "one  two"), (None, "one two"), (None, "alone here now"), (2, "a b c d e f"), (2, "a b c d e f"), (10, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, neardup.classes(df, words=2).collect()), key=repr) == brute(rows, 2)
    assert neardup.classes(df.limit(0)).count() == 0
    left = neardup.deduplicate(df.selectExpr("*", "'x' as n", "1 as kept"), words=2)
    assert left.columns == ["doc_id", "text", "n", "kept"]
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "3", "4", "5", "6", "8", "None"]


def test_rows_of_one_id_are_told_apart(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(20))
    rows = [(1, text(1), "a"), (1, text(2), "b"), (2, text(2), "c"), (3, text(1), "d"), (1, text(1), "a")]
    left = neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, copies string"))
    assert sorted(tuple(r) for r in left.collect()) == [(1, text(1), "a"), (1, text(2), "b")]


def test_long_texts_and_texts_of_many_common_words(spark, monkeypatch):
    """Documents of 2,000 shingles and more: the counters hold, sketches stay short."""
    r = random.Random(7)
    base = [[f"w{r.randint(0, 10**5)}" for _ in range(2500)] for _ in range(30)]
    rows = [(3 * i + j, " ".join(w if r.random() > x else "new" + w for w in b)) for i, b in enumerate(base) for j, x in enumerate((0, 0.03, 0.2))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, neardup.classes(df, words=2).collect()), key=repr) == brute(rows, 2)
    s = neardup.shingles(rows[0][1].encode(), 2)
    assert len(s) >= 2000 and len(neardup.retained(s, neardup.levels(df, 2), 80)) < 50
    few_slots = np.full(1 << 8, 400, np.int64)  # every counter is high, none stands out
    assert not neardup.as_levels(few_slots, max(neardup.LIST, 4 * few_slots.mean())).any()


def test_hot_centres_get_an_order_of_their_own(spark, monkeypatch):
    """A passage in every document makes long lists, in which the other words decide."""
    for name, value in (("SMALL", 4), ("BLOCK", 16), ("LIST", 10**6), ("ORDER_NODES", 40)):
        monkeypatch.setattr(neardup, name, value)
    called = []
    again = neardup._again
    monkeypatch.setattr(neardup, "_again", lambda *a: called.append(1) or again(*a))
    r = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(90):
        own = [f"w{r.randint(0, 10**6)}" for _ in range(r.choice([4, 12, 20, 40]))]
        for _ in range(r.choice([1, 1, 2, 3])):
            rows.append((len(rows), " ".join(passage + [w if r.random() > 0.1 else "x" + w for w in own])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, neardup.classes(df, words=2).collect()), key=repr) == brute(rows, 2) and called


def test_estimate_and_sketch_size():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.unique(np.concatenate([a[::10], rng.integers(0, 2**63, 900).astype(np.uint64)]))
    short = lambda s: (s[:32] >> np.uint64(32)).astype("<u4").tobytes()
    assert neardup.estimate(short(a), short(a)) == 1 and neardup.estimate(short(a), short(b)) < 0.35
    assert neardup.sketch_size(100, 80) < neardup.sketch_size(60, 80) < 120
