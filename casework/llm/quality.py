"""Quality classifier: document evidence and site posteriors, joined by hierarchical empirical Bayes.

A logistic model over shape features of the whole text (character classes and their successions,
word and line repetition) is fitted on a bounded sample of labelled rows and gives every document a
probability. These are summed by host and by path. The spread of the hosts' means (beyond what
sampling explains) gives the strength of the prior: a host's posterior is shrunk toward the global
mean, a path's toward its host's, sparse sites most. A document's score is its own evidence in log
odds plus the log odds of its path's posterior without itself, against the global mean. Documents
whose score is under ``threshold`` are rejected.

Very long texts are read whole, one at a time. Host and path are columns (or expressions); a null one is a site of its own. Null text: as empty.
Columns of docs keep their names, whatever these are; only one named as the result is replaced.
Labels: rows with a null id or label are left out; without both classes all documents get the prior
and are kept. Repeated rows: each counts. Empty tables: empty. Only the label sample (at most about
``SAMPLE_ROWS`` rows) and one row of global moments reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.llm.common import free_name, look_up, sampled, save

#: Labelled rows that the logistic model is fitted on, about.
SAMPLE_ROWS = 8_000
THRESHOLD = 0.5

# character classes: 0 lower, 1 upper, 2 digit, 3 space, 4 line end, 5 sentence mark, 6 other ASCII, 7 beyond ASCII
_CLASS = np.full(256, 6, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:?'\"()-")):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 7

N_FEATURES = 8 + 64 + 8


def features(text: str | None) -> np.ndarray:
    """Shape features of one text, all about 0 to 1."""
    out = np.zeros(N_FEATURES, np.float32)
    raw = (text or "").encode("utf-8", "replace")
    c = _CLASS[np.frombuffer(raw, np.uint8)]
    n = len(c)
    if not n:
        return out
    out[:8] = np.bincount(c, minlength=8) / n
    if n > 1:
        out[8:72] = np.bincount(c[:-1] * 8 + c[1:], minlength=64) / (n - 1)
    words = raw.split()
    w = len(words)
    lines = [x for x in raw.split(b"\n") if x]
    out[72] = min(1.0, np.log1p(w) / 10)
    if w:
        out[73] = len(set(words)) / w
        out[74] = (len(set(words)) / w) * out[72]
        out[75] = min(1.0, n / w / 20)
        out[76] = len(set(zip(words, words[1:], strict=False))) / max(1, w - 1)
    if lines:
        out[77] = len(set(lines)) / len(lines)
        out[78] = min(1.0, len(lines) / max(1, w))
        out[79] = min(1.0, max(map(len, lines)) / n)
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the constant) of a ridge logistic model, by Newton steps."""
    x = np.hstack([x.astype(float), np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge * max(1, len(x)) ** 0.5)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(reg), x.T @ (y - p) - reg * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> np.ndarray | None:
    """Weights of the document classifier; None without rows of both classes.

    Samples the labels by a hash of the id, at a rate that leaves about sample_rows of them.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).filter("id is not null and y is not null")
    known = known.filter(sampled(F.xxhash64("id"), sample_rows, max(1, known.count())))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    vec = F.pandas_udf(lambda s: s.map(lambda t: features(t).tobytes()), "binary")
    got = rows.select("y", vec("text").alias("x")).toArrow()
    y = got.column("y").to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    return fit(np.stack([np.frombuffer(b, np.float32) for b in got.column("x").to_pylist()]), y)


def _site(c: Column) -> Column:
    return F.concat(F.when(c.isNull(), "n").otherwise("s"), F.coalesce(c.cast("string"), F.lit("")))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, weights: np.ndarray | None, host: Column, path: Column, text_col: str = "text", threshold: float = THRESHOLD, out: str = "_q") -> DataFrame:
    """docs with ``out`` = struct(doc_score, host_posterior, path_posterior, score, kept); all rows stay."""
    if weights is None:
        even = F.lit(0.5)
        return docs.withColumn(out, F.struct(*[even.alias(c) for c in ("doc_score", "host_posterior", "path_posterior", "score")], F.lit(True).alias("kept")))
    w = weights

    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        x = np.stack([features(t) for t in texts]).astype(float)
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))))

    p = F.pandas_udf(score, "double")
    # first pass: sums by site
    lean = docs.select(_site(host).alias("_host"), _site(path).alias("_path"), p(F.col(text_col)).alias("p"))
    paths = save(lean.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("s2")))
    hosts = save(paths.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("s2").alias("hs2")))
    mean, host_k = _moments(hosts, "hn", "hs", "hs2")
    _, path_k = _moments(paths, "n", "s", "s2")
    shrunk = paths.join(hosts.hint("merge"), "_host").withColumn("host_posterior", (F.lit(host_k * mean) + F.col("hs")) / (F.lit(host_k) + F.col("hn")))
    sites = save(shrunk.select("_host", "_path", "n", "s", "host_posterior"))
    # second pass: each document against its path without itself
    h, t, own_p, s = (free_name(docs, x) for x in ("_host", "_path", "_p", "_s"))
    own = docs.select("*", _site(host).alias(h), _site(path).alias(t), p(F.col(text_col)).alias(own_p))
    rows = look_up(own, sites.select(F.col("_host").alias(h), F.col("_path").alias(t), F.struct("n", "s", "host_posterior").alias(s)), [h, t])
    posterior = (path_k * F.col(f"{s}.host_posterior") + F.greatest(F.col(f"{s}.s") - F.col(own_p), F.lit(0.0))) / (path_k + F.col(f"{s}.n") - 1)
    odds = _logit(F.col(own_p)) + _logit(posterior) - _logit(F.lit(mean))
    final = 1 / (1 + F.exp(-odds))
    found = F.struct(F.col(own_p).alias("doc_score"), F.col(f"{s}.host_posterior").alias("host_posterior"), posterior.alias("path_posterior"), final.alias("score"), (final >= threshold).alias("kept"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()], found.alias(out))


def _moments(sites: DataFrame, n: str, s: str, s2: str) -> tuple[float, float]:
    """The global mean, and the strength of the prior: how many documents the prior is worth."""
    tot, sm, sq, k = sites.agg(F.sum(n), F.sum(s), F.sum(s2), F.count("*")).first()
    if not tot:
        return 0.5, 1.0
    mean = sm / tot
    within = max(1e-9, sq / tot - mean * mean)
    between = sites.agg(F.sum((F.col(s) / F.col(n) - mean) ** 2 * F.col(n))).first()[0] / tot - within * k / tot
    return min(1 - 1e-6, max(1e-6, mean)), float(min(1e6, max(1.0, within / max(1e-9, between))))
