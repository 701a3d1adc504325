"""Language identification: family first, then one-versus-one linear support vector machines.

Texts become hashed counts of 1-, 2- and 3-byte sequences of their lower-cased letters, as square
roots of shares. On a bounded sample of labelled rows the mean vectors of the languages are merged
by likeness into families (half as many as languages); one-versus-one machines tell the families
apart, then those of the chosen family tell its languages apart. A document gets the language that
wins most duels, ties by margin; its score is the family's share of confidence times the
language's.

Very long texts are read whole, one at a time. Columns of docs keep their names; one named as the
result is replaced. Null text, or one without letters: ``und``, score 0. Null labels are not learned from. Repeated
rows: each counts. Without labelled rows every text is ``und``. Empty table: empty. The driver sees
counts by label and the sample (at most about ``SAMPLE_ROWS`` vectors); one map scores all rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.llm.common import sampled

#: Rows that the machines are fitted on, about, in equal parts by language.
SAMPLE_ROWS = 2_000
DIMS = 4096
UND = "und"

_LETTER = re.compile(r"[^\W\d_]")
_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def vector(text: str) -> np.ndarray:
    a = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_PLAIN) + b" ", np.uint8).astype(np.uint32)
    two = a[:-1] * np.uint32(257) + a[1:]
    three = two[:-1] * np.uint32(263) + a[2:]
    h = np.concatenate([a[a != 32], two * np.uint32(2654435761) >> np.uint32(20), three * np.uint32(2246822519) >> np.uint32(20)])
    x = np.sqrt(np.bincount(h, minlength=DIMS).astype(np.float32))
    return x / max(1e-9, float(np.linalg.norm(x)))


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 12) -> np.ndarray:
    """Weights of a linear machine (the last is the constant), by dual coordinate descent; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    w, alpha, q = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1)
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (w @ x[i]) - 1) / q[i], 0.0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class Duels:
    """One-versus-one machines between groups of rows."""

    def __init__(self, x: np.ndarray, group: np.ndarray):
        self.groups = sorted(set(group.tolist()))
        k = len(self.groups)
        self.pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
        self.w = np.zeros((len(self.pairs), x.shape[1] + 1))
        for r, (i, j) in enumerate(self.pairs):
            of = (group == self.groups[i]) | (group == self.groups[j])
            self.w[r] = svm(x[of], np.where(group[of] == self.groups[i], 1.0, -1.0))

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winner's number for each row, and its share of confidence."""
        k = len(self.groups)
        if k == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        margin = x @ self.w[:, :-1].T + self.w[:, -1]
        trust = 1 / (1 + np.exp(-np.clip(4 * margin, -30, 30)))
        wins, sure = np.zeros((len(x), k)), np.zeros((len(x), k))
        for r, (i, j) in enumerate(self.pairs):
            wins[:, i] += margin[:, r] > 0
            wins[:, j] += margin[:, r] <= 0
            sure[:, i] += trust[:, r]
            sure[:, j] += 1 - trust[:, r]
        best = np.argmax(wins + sure / (k + 1), axis=1)
        return best, sure[np.arange(len(x)), best] / (k - 1)


class Model:
    def __init__(self, x: np.ndarray, lang: np.ndarray):
        langs = sorted(set(lang.tolist()))
        center = {g: x[lang == g].mean(0) for g in langs}
        families = [[g] for g in langs]
        while len(families) > max(1, len(langs) // 2):
            near = [(-np.mean([center[a] @ center[b] / np.linalg.norm(center[a]) / np.linalg.norm(center[b]) for a in f for b in g]), i, j) for i, f in enumerate(families) for j, g in enumerate(families) if i < j]
            _, i, j = min(near)
            families[i] += families.pop(j)
        of = {g: k for k, f in enumerate(families) for g in f}
        number = np.array([of[g] for g in lang.tolist()])
        self.families = families
        self.top = Duels(x, number)
        self.inner = [Duels(x[number == k], lang[number == k]) for k in range(len(families))]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        out, score = [UND] * len(texts), np.zeros(len(texts))
        for start in range(0, len(texts), 256):
            have = [i for i in range(start, min(start + 256, len(texts))) if texts[i] and _LETTER.search(texts[i])]
            if not have:
                continue
            x = np.stack([vector(texts[i]) for i in have])
            family, trust = self.top(x)
            for k in set(family.tolist()):
                rows = np.flatnonzero(family == k)
                best, sure = self.inner[k](x[rows])
                for r, b, s in zip(rows, best, sure, strict=True):
                    out[have[r]] = self.inner[k].groups[b]
                    score[have[r]] = trust[r] * s
        return out, np.clip(score, 0.0, 1.0)


def train(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fits on rows where learn holds and the label is not null, sampled by a hash of the id to about sample_rows."""
    known = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return None
    each = max(10, sample_rows // len(counts))
    of = F.element_at(F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, n)]), F.col("lang"))
    vec = F.pandas_udf(lambda s: s.map(lambda t: vector(t).tobytes() if _LETTER.search(t) else None), "binary")
    got = known.filter(sampled(F.xxhash64("id"), each, of)).select("lang", "id", vec("text").alias("x")).filter("x is not null").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([("lang", "ascending"), ("id", "ascending"), ("x", "ascending")])
    return Model(np.stack([np.frombuffer(b, np.float32) for b in got.column("x").to_pylist()]), np.array(got.column("lang").to_pylist(), object))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "_lang") -> DataFrame:
    """docs with ``out`` = struct(lang_pred, score); all rows and columns stay."""

    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, score = model.predict([t if isinstance(t, str) else None for t in texts]) if model else ([UND] * len(texts), np.zeros(len(texts)))
        return pd.DataFrame({"lang_pred": langs, "score": score})

    udf = F.pandas_udf(predict, "lang_pred string, score double")
    return docs.withColumn(out, udf(F.col(text_col)))
