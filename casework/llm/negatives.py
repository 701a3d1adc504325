"""Hard negatives by angular triangle filtering.

Vectors become whole numbers floor(scale * x). Each stores its norm and its angles to
``REFERENCES`` directions, picked farthest first from a bounded sample. For an anchor a and a row
x with angles p and q to one direction, the triangle inequality of angles gives

    cos(p + q)  <=  cos(a, x)  <=  cos(p - q)

and so, times the norms, bounds on their score, widened by more than all rounding. Rows lie in
tiles of similar angles; a tile's smallest and largest angles and norms bound all its scores at
once. First the positives: the best rows of the anchor's own label, where a tile, then a row, is
left out whose upper bound is below the worst score kept. Each positive opens a window of scores
[share * positive, positive]; then only rows of other labels whose bounds overlap an open window
of the anchor get their whole-number score, and a window's lower end rises with the scores kept.

Positives meet by label: a label's rows are dealt into blocks, so that one with a third of all
rows is many tasks. For the negatives, rows and anchors are dealt into blocks along the directions
they lie nearest to; pairs of blocks none of whose bounds overlap are never sent. Each pair of
blocks is a task of bounded size, which keeps k rows a window. The driver holds a row for each
direction (with each other one), never one for each vector.

Scores are exact: see ``topk.products``. Vectors that are null or hold null or non-finite
components, and rows with a null label or id, take no part; vectors meet only vectors of their own
length; zero vectors score 0. Ties go to the smaller id. Repeated rows each count; an anchor never
meets its own row. A negative positive score leaves its window empty. Only the id, the vector and
the label are read, so that clashing names do no harm; there are no texts. Empty table: empty.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.llm.common import drop, look_up, sampled, save
from casework.llm.metric_join import pick_pivots
from casework.llm.topk import LEAST, NONE, Best, products, vectors_of

SCALE = 256
#: Directions, sample rows for each, rows of a block and of a tile, directions that bound single rows.
REFERENCES, SAMPLE, BLOCK, TILE, CLOSE = 32, 32, 8192, 64, 2
#: Angles from rounded cosines are off by less than 2e-8; bounds are widened by this share of the norms, and by 1.
SLACK = 1e-6


def _matrix(col, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, col)), np.float64).reshape(len(col), dim)


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms and unit vectors, safe for large numbers; a zero vector stays zero."""
    top = np.maximum(np.abs(x).max(1, initial=0), 1.0)[:, None]
    y = x / top
    size = np.sqrt((y * y).sum(1))[:, None]
    return (size * top)[:, 0], y / np.where(size > 0, size, 1)


def whole_vectors(df: DataFrame, is_anchor: Column, label: Column, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(row, id, label, asked, dim, v): the usable rows, v whole numbers in doubles in a binary."""

    def run(batches):
        for b in batches:
            keep, out = [], []
            for i, x in enumerate(vectors_of(b.column("v"))):
                if x is not None:
                    keep.append(i)
                    out.append(np.clip(np.floor(scale * x), -sys.float_info.max, sys.float_info.max))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in ("row", "id", "label", "asked")], pa.array([len(y) for y in out], pa.int32()), pa.array([y.tobytes() for y in out], pa.binary())], ["row", "id", "label", "asked", "dim", "v"])

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asked"), F.col(vec_col).alias("v"))
    return rows.filter("id is not null and label is not null").mapInArrow(run, "row long, id long, label long, asked boolean, dim int, v binary")


def with_angles(rows: DataFrame, dim: int, references: np.ndarray) -> DataFrame:
    """rows with the norm, the angles to the references and the nearest of these (home)."""

    def run(batches):
        for b in batches:
            norm, unit = _units(_matrix(b.column("v").to_pylist(), dim))
            angle = np.arccos(np.clip(unit @ references.T, -1, 1))
            angles = pa.ListArray.from_arrays(pa.array(np.arange(0, angle.size + 1, len(references), dtype=np.int32)), pa.array(angle.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(norm), angles, pa.array(angle.argmin(1).astype(np.int32))], [*b.schema.names, "norm", "angles", "home"])

    return rows.mapInArrow(run, "row long, id long, label long, asked boolean, dim int, v binary, norm double, angles array<double>, home int")


class Side:
    """Vectors of one side of a task."""

    def __init__(self, g: pd.DataFrame, dim: int):
        self.n = len(g)
        self.row, self.id, self.label = (g[c].to_numpy(np.int64) for c in ("row", "id", "label"))
        self.x, self.norm = _matrix(g.v, dim), g.norm.to_numpy(float)
        self.angle = np.stack(g.angles.to_numpy()) if self.n else np.zeros((0, 1))
        self.most = float(np.abs(self.x).max(initial=0))


def _scaled(cos: np.ndarray, low, high, up: bool) -> np.ndarray:
    """cos times a norm between low and high: the largest (smallest) it can be."""
    return cos * np.where((cos > 0) == up, high, low)


def tile_bounds(a: Side, lo: np.ndarray, hi: np.ndarray, norm_lo: np.ndarray, norm_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds on all scores of each anchor with each tile, whose angles lie in lo..hi."""
    least, most = np.zeros((a.n, len(lo))), np.full((a.n, len(lo)), np.pi)
    for r in range(lo.shape[1]):
        p = a.angle[:, r][:, None]
        least = np.maximum(least, np.maximum(lo[:, r] - p, p - hi[:, r]))
        s, t = p + lo[:, r], p + hi[:, r]
        most = np.minimum(most, np.where(t <= np.pi, t, np.where(s >= np.pi, 2 * np.pi - s, np.pi)))
    with np.errstate(over="ignore", invalid="ignore"):
        n_lo, n_hi = a.norm[:, None] * norm_lo, a.norm[:, None] * norm_hi
        slack = 1 + SLACK * n_hi
        return _scaled(np.cos(most), n_lo, n_hi, False) - slack, _scaled(np.cos(least), n_lo, n_hi, True) + slack


def row_bounds(a: Side, at: np.ndarray, d: Side, rows: slice, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds on the score of each of these anchors with each of these rows."""
    low, high = np.full((len(at), rows.stop - rows.start), -1.0), np.full((len(at), rows.stop - rows.start), 1.0)
    for r in references:
        p, q = a.angle[at, r], d.angle[rows, r]
        both, cross = np.outer(np.cos(p), np.cos(q)), np.outer(np.sin(p), np.sin(q))
        low, high = np.maximum(low, both - cross), np.minimum(high, both + cross)
    with np.errstate(over="ignore", invalid="ignore"):
        n = np.outer(a.norm[at], d.norm[rows])
        slack = 1 + SLACK * n
        return low * n - slack, high * n + slack


def _outside(low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Where bounds miss the windows; bounds that are no numbers miss nothing, and scores end with the 64-bit range."""
    return (np.maximum(high, LEAST) < least) | (np.minimum(low, NONE) > most)


class Tiles:
    """The rows of a task in tiles of similar angles."""

    def __init__(self, d: Side, size: int = TILE):
        self.d = d
        self.at = [slice(s, min(s + size, d.n)) for s in range(0, d.n, size)]
        starts = np.arange(0, d.n, size)
        self.lo, self.hi = np.minimum.reduceat(d.angle, starts), np.maximum.reduceat(d.angle, starts)
        self.norm_lo, self.norm_hi = np.minimum.reduceat(d.norm, starts), np.maximum.reduceat(d.norm, starts)
        self.close = np.argsort(self.lo + self.hi, axis=1)[:, :CLOSE]


def walk(a: Side, d: Side, window, take) -> tuple[int, int]:
    """Scores what may lie in an anchor's window; returns how many pairs were scored, and how many there are.

    window(anchors) gives the ends of what they still look for; take(anchors, rows, scores) keeps.
    """
    tiles, scored = Tiles(d), 0
    low, high = tile_bounds(a, tiles.lo, tiles.hi, tiles.norm_lo, tiles.norm_hi)
    for t in np.argsort(-high.max(0)):
        least, most = window(np.arange(a.n))
        at = np.flatnonzero(~_outside(low[:, t], high[:, t], least, most))
        if not len(at):
            continue
        rows = tiles.at[t]
        close = row_bounds(a, at, d, rows, tiles.close[t])
        open_ = ~_outside(*close, least[at][:, None], most[at][:, None])
        i, j = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        if not len(i):
            continue
        at, j = at[i], rows.start + j
        s = products(a.x[at], d.x[j], a.most * d.most * max(1, d.x.shape[1]))
        scored += s.size
        take(at, j, s)
    return scored, a.n * d.n


def _sides(left: pd.DataFrame, right: pd.DataFrame, dim: int) -> tuple[Side, Side]:
    right = right.assign(near=[float(x.min()) for x in right.angles]).sort_values(["home", "near", "row"], kind="stable")
    return Side(left, dim), Side(right, dim)


def _positives(dim: int, k: int):
    """Task: the k best rows of each anchor in one block of its label."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("anchor", "id", "score")})
        a, d = _sides(left, right, dim)
        best = Best(a.n, k)

        def take(at, j, s):
            own = a.row[at][:, None] == d.row[j][None, :]
            s[own] = LEAST
            best.add(at, s, np.where(own, NONE, d.id[j][None, :]))

        walk(a, d, lambda at: (best.worst[at], np.full(len(at), np.inf)), take)
        at, slot = np.nonzero(best.id != NONE)
        return pd.DataFrame({"anchor": a.row[at], "id": best.id[at, slot], "score": best.score[at, slot]})

    return run


def _negatives(dim: int, k: int, width: int):
    """Task: the k best rows of another label in each window of each anchor, in one pair of blocks."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("anchor", "positive", "id", "score")})
        a, d = _sides(left, right, dim)
        lo, hi = np.full((a.n, width), NONE), np.full((a.n, width), LEAST)
        for i, (x, y) in enumerate(zip(left.lo, left.hi, strict=True)):
            lo[i, : len(x)], hi[i, : len(y)] = x, y
        best = Best(a.n * width, k, lo.ravel())

        def window(at):
            worst = best.worst.reshape(a.n, width)[at]
            open_ = (worst <= hi[at]) & (lo[at] <= hi[at])
            return np.where(open_, worst, np.inf).min(1), np.where(open_, hi[at], -np.inf).max(1)

        def take(at, j, s):
            other = a.label[at][:, None] != d.label[j][None, :]
            for w in range(width):
                ok = other & (s >= lo[at, w][:, None]) & (s <= hi[at, w][:, None])
                some = np.flatnonzero(ok.any(1))
                if len(some):
                    best.add(at[some] * width + w, np.where(ok[some], s[some], LEAST), np.where(ok[some], d.id[j][None, :], NONE))

        walk(a, d, window, take)
        at, slot = np.nonzero(best.id != NONE)
        return pd.DataFrame({"anchor": a.row[at // width], "positive": at % width, "id": best.id[at, slot], "score": best.score[at, slot]})

    return run


def _top(df: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(df: DataFrame, is_anchor: Column, label: Column, n_positives: int = 5, k: int = 5, share: tuple[int, int] = (4, 5), id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each anchor and each of its n_positives best rows of the same label, the k best rows of
    other labels with share * positive_score <= negative_score <= positive_score; share is a
    fraction (over, under).
    """
    vectors = save(whole_vectors(df, is_anchor, label, id_col, vec_col, scale))
    out = df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for dim, n in sorted((r.dim, r["count"]) for r in vectors.groupBy("dim").count().collect()):  # one row a length
        out = out.union(_of_one_length(vectors.filter(F.col("dim") == dim), dim, n, n_positives, k, share, block))
    return out


def _of_one_length(vectors: DataFrame, dim: int, n: int, n_positives: int, k: int, share: tuple[int, int], block: int) -> DataFrame:
    wanted = REFERENCES * SAMPLE
    sample = vectors.filter(sampled(F.xxhash64("row", F.lit(13)), wanted, n)).select("v").collect() or vectors.select("v").limit(1).collect()
    references = pick_pivots(_units(_matrix([r.v for r in sample], dim))[1], REFERENCES) if dim else np.zeros((1, 0))
    rows = save(with_angles(vectors, dim, references))
    keep = ["row", "id", "label", "v", "norm", "angles", "home"]
    by = ["label", "left", "right"]
    # positives: blocks of each label's anchors with blocks of its rows
    sizes = save(rows.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("rights"), F.ceil(F.count_if("asked") / block).cast("int").alias("lefts")).filter("lefts > 0"))
    dealt = look_up(rows, sizes, ["label"], "inner")
    slot = lambda seed, of: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(of)).cast("int")
    # aliases: both sides come from one table
    anchors = dealt.filter("asked").select(*[F.col(c).alias(c) for c in keep], slot(1, "lefts").alias("left"), F.explode(F.expr("sequence(0, rights - 1)")).alias("right"))
    others = dealt.select(*keep, slot(2, "rights").alias("right"), F.explode(F.expr("sequence(0, lefts - 1)")).alias("left"))
    found = anchors.groupBy(*by).cogroup(others.groupBy(*by)).applyInPandas(_positives(dim, n_positives), "anchor long, id long, score long")
    positives = save(_top(found, ["anchor"], n_positives))
    # each positive's window; whole numbers, so that share * p is rounded up
    score, over, under = F.col("score").cast("decimal(38,0)"), F.lit(share[0]).cast("decimal(10,0)"), F.lit(share[1]).cast("decimal(10,0)")
    low = (-F.floor(-(score * over) / under)).cast("long")
    windows = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", low.alias("lo"), F.col("score").alias("hi"), F.col("id").alias("id")))).alias("w"))
    asked = rows.filter("asked").join(windows.withColumnRenamed("anchor", "row"), "row").select(*keep, F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))
    asked = save(asked)
    pairs = _meetings(rows, asked, references, block)
    kept = "row long, id long, label long, v binary, norm double, angles array<double>, home int"
    left = asked.mapInPandas(pairs(0), f"{kept}, lo array<long>, hi array<long>, left int, right int")
    right = rows.select(*keep).mapInPandas(pairs(1), f"{kept}, left int, right int")
    got = left.groupBy("left", "right").cogroup(right.groupBy("left", "right")).applyInPandas(_negatives(dim, k, n_positives), "anchor long, positive long, id long, score long")
    best = save(_top(got, ["anchor", "positive"], k))
    names = rows.filter("asked").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    of = positives.select("anchor", (F.col("rank") - 1).cast("long").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = best.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(of, ["anchor", "positive"]).join(names, "anchor")
    out = save(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    drop(rows, sizes, positives, asked, best)
    return out


def _meetings(rows: DataFrame, asked: DataFrame, references: np.ndarray, block: int):
    """How both sides are dealt: blocks along the homes, and the pairs of blocks whose bounds overlap a window."""
    n = len(references)
    ends = [F.struct(F.min(F.col("angles")[r]).alias("lo"), F.max(F.col("angles")[r]).alias("hi")) for r in range(n)]
    about = lambda df, *more: df.groupBy("home").agg(F.count("*").alias("n"), F.min("norm").alias("least"), F.max("norm").alias("most"), F.array(*ends).alias("ends"), *more).collect()
    data = {r.home: r for r in about(rows)}
    anchors = {r.home: r for r in about(asked, F.min(F.array_min("lo")).alias("lo"), F.max(F.array_max("hi")).alias("hi"))}
    meets = np.zeros((n, n), bool)
    for x, l in anchors.items():
        for y, r in data.items():
            least = max(0.0, max(max(e.lo - f.hi, f.lo - e.hi) for e, f in zip(l.ends, r.ends, strict=True)))
            most = np.pi
            for e, f in zip(l.ends, r.ends, strict=True):
                s, t = e.lo + f.lo, e.hi + f.hi
                most = min(most, t if t <= np.pi else 2 * np.pi - s if s >= np.pi else np.pi)
            with np.errstate(over="ignore", invalid="ignore"):
                lo_n, hi_n = np.float64(l.least) * r.least, np.float64(l.most) * r.most
                slack = 1 + SLACK * hi_n
                meets[x, y] = not _outside(_scaled(np.cos(most), lo_n, hi_n, False) - slack, _scaled(np.cos(least), lo_n, hi_n, True) + slack, l.lo, l.hi)
    count = [np.array([of[h].n if h in of else 0 for h in range(n)]) for of in (anchors, data)]
    first = [np.cumsum(c) - c for c in count]

    def blocks_of(side: int, home: int) -> range:
        return range(int(first[side][home] // block), int((first[side][home] + max(1, count[side][home]) - 1) // block) + 1)

    inside: list[dict[int, list[int]]] = [{}, {}]
    for side in (0, 1):
        for h in np.flatnonzero(count[side]):
            for b in blocks_of(side, int(h)):
                inside[side].setdefault(b, []).append(int(h))

    def partners(side: int, b: int) -> list[int]:
        own = inside[side][b]
        seen = meets[own].any(0) if side == 0 else meets[:, own].any(1)
        return sorted({x for h in np.flatnonzero(seen & (count[1 - side] > 0)) for x in blocks_of(1 - side, int(h))})

    def deal(side: int):
        def run(frames):
            known: dict[int, list[int]] = {}
            for g in frames:
                if not len(g):
                    continue
                share = (pd.util.hash_array(g.row.to_numpy(np.uint64) + np.uint64(side)) >> np.uint64(11)) / float(1 << 53)
                home = g.home.to_numpy()
                own = ((first[side][home] + np.floor(share * count[side][home])) // block).astype(np.int64)
                for b in np.unique(own):
                    if b not in known:
                        known[b] = partners(side, int(b))
                    part = g[own == b]
                    for x in known[b]:
                        yield part.assign(left=np.int32(b if side == 0 else x), right=np.int32(x if side == 0 else b))

        return run

    return deal
