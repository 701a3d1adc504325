"""Exact top-k search by inner product: dual-tree search over cover trees.

Vectors become whole numbers floor(scale * x). The stated queries go out in blocks of a bounded
number of bytes; each task builds cover trees over blocks of its own rows (every node has a centre,
and a covering radius that holds all its descendants; children are chosen by distance, farthest
first) and walks query tree and data tree together. A pair of nodes is left out when no pair of
their vectors can reach the worst kth score of the query group:

    max <q, d>  <=  <q0, d0> + |q0| rd + |d0| rq + rq rd

The first bounds on kth scores come from a small sample of rows, so that every task prunes from
its start. Each task keeps k rows a query; the last step takes the k best of them.

Scores are exact: products of whole numbers in doubles as far as these hold them, else in 64-bit
numbers, else in Python's; a score beyond the 64-bit range is given as the end of that range.
Vectors that are null, or hold null or non-finite components, and rows with a null id take no
part. Vectors meet only vectors of their own length. Ties go to the smaller id. Repeated rows each
count; a query never meets its own row. Only the id and the vector are read, so that clashing names
do no harm; there are no texts. Empty table: empty.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.llm.common import sampled, save

SCALE = 1024
#: Bytes of a block of queries (numbers of 8 bytes).
QUERY_BYTES = 16 << 20
#: Rows of a tree, of a leaf, children of a node, rows that give the first bounds.
TREE_ROWS, LEAF, CHILDREN, SAMPLE = 2048, 64, 8, 1024


def vectors_of(col: pa.Array) -> list[np.ndarray | None]:
    """Each list as doubles; None where it is null or holds a null or non-finite number."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    values = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null becomes nan
    sizes = np.array([0 if n is None else n for n in col.value_lengths().to_pylist()])
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    return [None if null or bad[e] > bad[e - n] else values[e - n : e] for null, e, n in zip(col.is_null().to_pylist(), ends, sizes, strict=True)]


def whole_vectors(df: DataFrame, is_query: Column, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(row, id, asked, dim, v): the usable vectors as whole numbers, in doubles, in a binary; asked marks the queries."""

    def run(batches):
        for b in batches:
            keep, out = [], []
            for i, (k, x) in enumerate(zip(b.column("id").to_pylist(), vectors_of(b.column("v")), strict=True)):
                if k is not None and x is not None:
                    keep.append(i)
                    out.append(np.clip(np.floor(scale * x), -sys.float_info.max, sys.float_info.max))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("row").take(at), b.column("id").take(at), b.column("asked").take(at), pa.array([len(y) for y in out], pa.int32()), pa.array([y.tobytes() for y in out], pa.binary())], ["row", "id", "asked", "dim", "v"])

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asked"), F.col(vec_col).alias("v"))
    return rows.mapInArrow(run, "row long, id long, asked boolean, dim int, v binary")


class Tree:
    """A cover tree over the rows of x, built from the top; nodes hold (centre, radius, |centre|, children or None, rows)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.leaf = x, leaf
        self.root = self._build(np.arange(len(x)))

    def _build(self, rows: np.ndarray):
        x = self.x[rows]
        away = np.sqrt(((x - x[0]) ** 2).sum(1))
        radius = float(away.max())
        kids = None
        if len(rows) > self.leaf and radius > 0:
            near, best = np.zeros(len(rows), int), away.copy()
            n = 1
            while n < CHILDREN and (far := int(best.argmax())) >= 0 and best[far] > radius / 2:
                d = np.sqrt(((x - x[far]) ** 2).sum(1))
                closer = d < best
                near[closer], best[closer] = n, d[closer]
                n += 1
            if n > 1:
                kids = []
                for c in range(n):
                    own = np.flatnonzero(near == c)
                    if len(own):
                        first = own[best[own].argmin()]
                        kids.append(self._build(rows[np.concatenate([[first], own[own != first]])]))
        return (self.x[rows[0]], radius, float(np.sqrt((self.x[rows[0]] ** 2).sum())), kids, rows)


#: Marks a place that nothing has taken yet.
LEAST, NONE = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Best:
    """The k best (score, id) of each query so far; scores are 64-bit whole numbers."""

    def __init__(self, n: int, k: int, worst: np.ndarray | None = None):
        self.score = np.full((n, k), LEAST)
        self.id = np.full((n, k), NONE)
        self.floor = np.full(n, -np.inf) if worst is None else worst.astype(float)
        self.worst = self.floor.copy()

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Takes scores of queries q against rows; ids as a matrix, NONE where a pair does not count."""
        hit = (score >= self.worst[q][:, None]).any(1)
        if not hit.any():
            return
        s = np.hstack([self.score[q], score])[hit]
        i = np.hstack([self.id[q], ids])[hit]
        order = np.lexsort((i, ~s), axis=1)[:, : self.score.shape[1]]
        q = q[hit]
        self.score[q], self.id[q] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        self.worst[q] = np.where(self.id[q][:, -1] == NONE, self.floor[q], np.maximum(self.floor[q], self.score[q][:, -1]))


def products(q: np.ndarray, d: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of whole numbers, none of which has parts that sum to more than most, as 64-bit numbers."""
    if most < 2.0**53:
        return (q @ d.T).astype(np.int64)
    if most < 2.0**62:
        return q.astype(np.int64) @ d.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(q) @ whole(d).T, LEAST, NONE).astype(np.int64) if q.size and d.size else np.zeros((len(q), len(d)), np.int64)


def search(queries: Tree, q_row: np.ndarray, data: Tree, d_row: np.ndarray, d_id: np.ndarray, best: Best) -> int:
    """Walks both trees; returns how many pairs of vectors were scored."""
    scored = 0
    most = float(np.abs(queries.x).max(initial=0)) * float(np.abs(data.x).max(initial=0)) * max(1, data.x.shape[1])

    def bound(a, b) -> float:
        return float(a[0] @ b[0]) + a[2] * b[1] + b[2] * a[1] + a[1] * b[1]

    todo = [(queries.root, data.root)]
    while todo:
        a, b = todo.pop()
        top = bound(a, b)
        if top + 1 + 1e-9 * abs(top) < best.worst[a[4]].min():
            continue
        if a[3] is None and b[3] is None:
            s = products(queries.x[a[4]], data.x[b[4]], most)
            own = q_row[a[4]][:, None] == d_row[b[4]][None, :]
            s[own] = LEAST
            scored += s.size
            best.add(a[4], s, np.where(own, NONE, d_id[b[4]][None, :]))
        elif b[3] is None or a[3] is not None and a[1] > b[1]:
            todo += [(x, b) for x in a[3]]
        else:  # the most promising child is walked first
            todo += sorted(((a, y) for y in b[3]), key=lambda p: bound(*p))
    return scored


def _stack(v: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(v), np.float64).reshape(len(v), dim)


def top_k(df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, id, score): the k best rows for each row where is_query holds."""
    vectors = save(whole_vectors(df, is_query, id_col, vec_col, scale))
    asked = vectors.filter("asked")
    spark, found = df.sparkSession, []
    for dim, n in sorted((r.dim, r["count"]) for r in asked.groupBy("dim").count().collect()):  # one row a length
        data = vectors.filter(F.col("dim") == dim)
        blocks = -(-n * 8 * max(1, dim) // query_bytes)
        total = max(1, data.count())
        sample = data.filter(sampled(F.xxhash64("row", F.lit(7)), SAMPLE, total)).collect()
        for block in range(blocks):
            rows = asked.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == block)).collect()
            if rows:
                q = (np.array([r.row for r in rows]), np.array([r.id for r in rows]), _stack([bytes(r.v) for r in rows], dim))
                first = Best(len(rows), k)
                if sample:
                    search(Tree(q[2]), q[0], Tree(_stack([bytes(r.v) for r in sample], dim)), np.array([r.row for r in sample]), np.array([r.id for r in sample]), first)
                shared = spark.sparkContext.broadcast((*q, first.worst))
                found.append(save(data.mapInArrow(_walk(shared, k, dim), "q_row long, query_id long, vec_id long, score long")))
                shared.unpersist()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _walk(shared, k: int, dim: int):
    def run(batches):
        q_row, q_id, q, worst = shared.value
        tree, best = Tree(q), Best(len(q), k, worst)
        held: list[tuple] = []

        def walk(held):
            search(tree, q_row, Tree(_stack([h[2] for h in held], dim)), np.array([h[0] for h in held]), np.array([h[1] for h in held]), best)

        for b in batches:
            held += zip(b.column("row").to_pylist(), b.column("id").to_pylist(), b.column("v").to_pylist(), strict=True)
            while len(held) >= TREE_ROWS:
                walk(held[:TREE_ROWS])
                del held[:TREE_ROWS]
        if held:
            walk(held)
        at, slot = np.nonzero(best.id != NONE)
        yield pa.RecordBatch.from_arrays([pa.array(q_row[at]), pa.array(q_id[at]), pa.array(best.id[at, slot]), pa.array(best.score[at, slot])], ["q_row", "query_id", "vec_id", "score"])

    return run
