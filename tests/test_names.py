import random

import pytest
from pyspark.sql import functions as F

from casework.operators import names


def match(a, b):
    if a == b or min(len(a), len(b)) >= 4 and (a in b or b in a):
        return True
    x, y = ({w for w in k.split() if len(w) > 2} for k in (a, b))
    return min(len(a), len(b)) >= 8 and bool(x and y) and len(x & y) / max(len(x), len(y)) >= 0.6


def made(seed, n, most=12):
    rng = random.Random(seed)
    vocabulary = ["harbor", "north", "pier", "relief", "fund", "of", "x1", "board", "river", "court", "unit", "east", "west", "clinic", "bo", "station"]
    return [" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 2, 3, 3, 4, 5, 6, 8, rng.randint(9, most)]))) + rng.choice(["", "", "", f" {rng.randint(0, 30):03d}"]) for _ in range(n)]


def test_first_match_against_a_plain_loop(spark):
    asked, known = sorted(set(made(1, 250))), sorted(set(made(2, 250)))
    at = {k: i for i, k in enumerate(random.Random(4).sample(known, len(known)))}
    a = spark.createDataFrame([(c, k) for k in asked for c in (1, 2)], "case_id long, key string")
    b = spark.createDataFrame([(1, k, i) for k, i in at.items()], "case_id long, key string, at long")
    got = {(r.case_id, r.key): r["at"] for r in names.first_match(a, b).collect()}
    want = {(1, k): min((i for o, i in at.items() if match(k, o)), default=None) for k in asked}
    assert got == {k: i for k, i in want.items() if i is not None} and len(got) > 100 and None in want.values()


def greedy(rows):
    heads, out = [], []
    for name in rows:
        final = next((h for h in heads if match(name, h)), None)
        if final is None:
            heads.append(name)
        out.append(final or name)
    return out


@pytest.mark.parametrize("one_task,n", [(0, 30), (20, 60), (2000, 120)])
def test_canonical_is_greedy_in_order(spark, one_task, n):
    rows = made(3, n) + ["harbor", "harbor"]
    other = made(7, 8)
    df = spark.createDataFrame([(1, n, 3 * i) for i, n in enumerate(rows)] + [(2, n, i) for i, n in enumerate(other)], "case_id long, name string, place int")
    got = sorted(map(tuple, names.canonical(df, one_task).select("case_id", "place", "name", "final_name").collect()))
    assert got == sorted([(1, 3 * i, n, f) for i, (n, f) in enumerate(zip(rows, greedy(rows)))] + [(2, i, n, f) for i, (n, f) in enumerate(zip(other, greedy(other)))])
    assert one_task or names.canonical(df.limit(0), one_task).count() == 0


def test_chain_of_names(spark):
    """Each name matches the one before it alone, so that every second one is final."""
    rows = [f"{i:04d}x{i + 1:04d}" for i in range(3)]
    rows = [a for i, r in enumerate(rows) for a in (r, r[5:])][:-1]  # 0000x0001, 0001, 0001x0002, 0002, ...
    df = spark.createDataFrame([(1, n, i) for i, n in enumerate(rows)], "case_id long, name string, place int")
    assert [r.final_name for r in names.canonical(df, 0).orderBy("place").collect()] == greedy(rows)


def test_one_case_of_many_names_makes_no_pairs_of_all(spark):
    """100,000 names of one case that all share 60 % of their words; the joins give a few rows a name."""
    n = 100_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("case_id"), F.format_string("harbor pier %05d", "id").alias("name"), F.col("id").cast("int").alias("place"))
    got = names.canonical(df)
    assert got.groupBy("final_name").count().collect() == [("harbor pier 00000", n)]
    known = spark.createDataFrame([(1, "harbor pier master", 7), (1, "harbor pier office", 3)], "case_id long, name string, id long")
    assert [tuple(r) for r in names.resolved(df, known).groupBy("canonical").count().collect()] == [("harbor pier office", n)]


def test_resolved_of_odd_rows(spark):
    c = spark.createDataFrame([(1, None), (1, ""), (1, "Harbor"), (1, "Harbor"), (2, "Harbor Council"), (3, "Bo"), (4, "The Apex Co.")], "case_id long, name string")
    e = spark.createDataFrame([(1, "Greater Harbor Council", 5), (1, "Harbor Trust", 5), (1, None, 1), (1, "", 9), (2, None, 1), (3, "Bob", 1), (4, "Apex", 2)], "case_id long, name string, id long")
    got = {(r.case_id, r.candidate): r.canonical for r in names.resolved(c, e).collect()}
    assert got == {(1, None): None, (1, ""): "", (1, "Harbor"): "Greater Harbor Council", (2, "Harbor Council"): None, (3, "Bo"): None, (4, "The Apex Co."): "Apex"}
    assert names.resolved(c, e.limit(0)).filter("canonical is not null").count() == 0
