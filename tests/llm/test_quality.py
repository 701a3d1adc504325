import math
from collections import defaultdict

from pyspark.sql import functions as F

from casework.llm import quality, queries

SF = "/root/testdata/sf0.01"


def test_query_agrees_with_labels(spark):
    rows = {r.doc_id: r for r in queries.op9_quality(spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    bad = [rows[r.doc_id].kept for r in labels if r.quality == 0]
    good = [rows[r.doc_id].kept for r in labels if r.quality == 1]
    assert sum(bad) / len(bad) < 0.05 and sum(good) / len(good) > 0.99


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    w = quality.train(docs, labels.filter("doc_id % 2 = 0"))
    got = quality.classify(docs, w, F.col("source"), F.col("lang")).join(labels.filter("doc_id % 2 = 1"), "doc_id").select("_q.kept", "quality").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) / len(got) > 0.97


def test_sparse_sites_shrink_to_their_host(spark):
    docs = spark.createDataFrame([(i, ("plain words here " if i % 40 else "JUNK!! ") * 9, "h1" if i % 2 else "h2", f"p{i % 7}") for i in range(400)] + [(900, "plain words here", "h1", "rare")], "doc_id long, text string, host string, path string")
    labels = docs.select("doc_id", F.expr("if(text like 'JUNK%', 0, 1)").alias("quality"))
    w = quality.train(docs, labels)
    r = quality.classify(docs, w, F.col("host"), F.col("path")).filter("doc_id = 900").select("_q.*").first()
    assert abs(r.path_posterior - r.host_posterior) < 1e-6 and r.kept


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, "x"), (1, "", "s", None), (None, "a b", "s", "y")], "doc_id long, text string, source string, score string")
    out = quality.classify(docs, None, F.col("source"), F.lit(None).cast("string"))
    assert out.filter("_q.kept").count() == 3
    w = quality.fit(quality.np.stack([quality.features(t) for t in ("good text", "BAD!!", "fine words")]), quality.np.array([1.0, 0.0, 1.0]))
    assert quality.classify(docs, w, F.col("source"), F.col("score")).count() == 3
    assert quality.classify(docs.limit(0), w, F.col("source"), F.col("score")).count() == 0
    assert quality.train(docs, docs.select("doc_id", F.lit(1).alias("quality"))) is None


def test_posteriors_against_brute_force(spark):
    """The shrinkage, document by document, from the classifier's chances."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source", "lang")
    w = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r for r in quality.classify(docs, w, F.col("source"), F.col("lang")).select("doc_id", "_q.*").collect()}
    rows = docs.collect()
    p = {r.doc_id: 1 / (1 + math.exp(-max(-30, min(30, float(quality.features(r.text).astype(float) @ w[:-1] + w[-1]))))) for r in rows}

    def moments(site):
        by = defaultdict(list)
        for r in rows:
            by[site(r)].append(p[r.doc_id])
        mean = sum(p.values()) / len(p)
        within = max(1e-9, sum(x * x for x in p.values()) / len(p) - mean * mean)
        between = sum(len(x) * (sum(x) / len(x) - mean) ** 2 for x in by.values()) / len(p) - within * len(by) / len(p)
        return by, mean, min(1e6, max(1.0, within / max(1e-9, between)))

    hosts, mean, kh = moments(lambda r: r.source)
    paths, _, kp = moments(lambda r: (r.source, r.lang))
    odds = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    for r in rows:
        h, t, own = hosts[r.source], paths[r.source, r.lang], p[r.doc_id]
        host = (kh * mean + sum(h)) / (kh + len(h))
        path = (kp * host + max(0.0, sum(t) - own)) / (kp + len(t) - 1)
        score = 1 / (1 + math.exp(-(odds(own) + odds(path) - odds(mean))))
        x = got[r.doc_id]
        assert all(abs(a - b) < 1e-6 for a, b in zip((own, host, path, score), (x.doc_score, x.host_posterior, x.path_posterior, x.score), strict=True))
        assert x.kept == (x.score >= quality.THRESHOLD)


def test_clashing_names_and_a_very_long_text(spark):
    rows = [(i, "plain words here " * (60_000 if i == 3 else 9), f"h{i % 3}", 1, 2, 3, 4, 5, 6) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _p int, _s int, _host int, _path int, n int, _q int")
    w = quality.fit(quality.np.stack([quality.features(t) for t in ("good text", "BAD!!", "fine words")]), quality.np.array([1.0, 0.0, 1.0]))
    out = quality.classify(docs, w, F.col("source"), F.col("n"), out="found")
    assert out.columns == [*docs.columns, "found"] and out.count() == 30
    assert quality.classify(docs, w, F.col("source"), F.col("n")).filter("_q.kept is not null").count() == 30
