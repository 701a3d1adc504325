"""Embedding near-duplicates: an exact metric range join over cells of pivots.

Copies of a vector are one vector with a count. Pivots, spread out among a sample, divide the unit
vectors into cells by the nearest pivot. A vector can only link to a vector of another cell if

    angle(x, pivot) <= radius of the cell + theta         (triangle inequality), and
    x . (own pivot - other pivot) / |own - other| <= sin theta     (the border between the cells)

so it is copied into those cells alone, and of each two cells only into the later one. Cells join
independently; a large cell is cut into blocks of ``BLOCK`` vectors, and each pair of blocks is a
task of bounded size that multiplies them strip by strip and checks what comes near the threshold
in doubles. A task gives link counts and spanning forests of its links, never its pairs. The
forests' connected components are the classes. Where most vectors are far from everything, the
conditions hold for most cells, and copies grow with the square of the vectors over ``BLOCK``.

Vectors that are null, zero, or hold null or non-finite components link with nothing, and so do
rows with a null id. Only the id and the vector are read, so that clashing names do no harm; there
are no texts. Vectors meet only vectors of their own length. Repeated rows are vectors of
their own. Empty table: empty. Pivots, cell radii and cell counts (at most ``MAX_PIVOTS`` rows)
are all that reaches the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.common import components, look_up, sampled, save
from casework.llm.topk import vectors_of

THRESHOLD = 0.9
#: Vectors of a block, and of a strip of it that is multiplied at once.
BLOCK, STRIP = 8192, 1024
MAX_PIVOTS = 4096
#: Distinct vectors for each pivot.
CELL_ROWS = 8192
SLACK = 1e-6


def unit_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, dim): v the unit vector as doubles in a binary, null for a vector that takes no part."""

    def run(batches):
        for b in batches:
            out = []
            for k, x in zip(b.column("id").to_pylist(), vectors_of(b.column("v")), strict=True):
                top = np.abs(x).max(initial=0) if x is not None and k is not None else 0
                if top > 0:
                    x = x / top
                    out.append((x / np.sqrt((x * x).sum())).tobytes())
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], ["id", "v"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    return rows.mapInArrow(run, "id long, v binary").withColumns({"dim": F.length("v"), "key": F.xxhash64("v"), "key2": F.xxhash64(F.lit(1), "v")})


def pick_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """n of the rows, farthest first."""
    picked, near = [0], x @ x[0]
    while len(picked) < min(n, len(x)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-9:
            break
        picked.append(far)
        near = np.maximum(near, x @ x[far])
    return x[picked]


def _matrix(v, dim_bytes: int) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, v)), np.float64).reshape(len(v), dim_bytes // 8)


def homes(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = x @ pivots.T
    home = c.argmax(1)
    return home, np.arccos(np.clip(c[np.arange(len(x)), home], -1, 1))


def visits(x: np.ndarray, home: np.ndarray, pivots: np.ndarray, radius: np.ndarray, theta: float) -> np.ndarray:
    """Which later cells each vector must visit, as a matrix of booleans."""
    c = x @ pivots.T
    own = c[np.arange(len(x)), home]
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    border = (own[:, None] - c) <= math.sin(theta) * apart[home] + SLACK
    near = np.arccos(np.clip(c, -1, 1)) <= radius[None, :] + theta + SLACK
    return border & near & (np.arange(len(pivots))[None, :] > home[:, None])


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component, kept) of each row: vectors with cosine >= threshold link."""
    rows = save(unit_vectors(df, id_col, vec_col))
    # copies meet in one row: the least id, how many
    distinct = save(rows.filter("v is not null").groupBy("key", "key2").agg(F.first("v").alias("v"), F.first("dim").alias("dim"), F.min("id").alias("uid"), F.count("*").alias("n")))
    links, edges = [], []
    for dim, count in sorted((r.dim, r["count"]) for r in distinct.groupBy("dim").count().collect()):  # one row a length
        found = save(_join(distinct.filter(F.col("dim") == dim), dim, count, threshold, block))
        links.append(found.filter("links > 0").select("key", "key2", "links"))
        edges.append(found.filter("a is not null").select("a", "b"))
    spark = df.sparkSession
    links = _union(links, spark, "key long, key2 long, links long").groupBy("key", "key2").agg(F.sum("links").alias("links"))
    comps = components(_union(edges, spark, "a long, b long"))
    of = distinct.select("key", "key2", "uid", "n").join(comps.withColumnRenamed("id", "uid").hint("merge"), "uid", "left")
    of = save(of.join(links.hint("merge"), ["key", "key2"], "left").select("key", "key2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "uid").alias("component")))
    out = look_up(rows.select("id", "key", "key2", F.col("v").isNotNull().alias("in")), of, ["key", "key2"])
    component = F.when(F.col("in"), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.when(F.col("in"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _union(frames: list[DataFrame], spark, schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for f in frames:
        out = out.union(f)
    return out


def _join(distinct: DataFrame, dim: int, count: int, threshold: float, block: int) -> DataFrame:
    """(key, key2, links) and spanning edges (a, b) between least ids, of the vectors of one length."""
    theta = math.acos(threshold)
    n_pivots = max(1, min(MAX_PIVOTS, count // CELL_ROWS))
    sample = distinct.filter(sampled(F.col("key2"), 8 * n_pivots, count)).select("v").collect() or distinct.select("v").limit(1).collect()
    pivots = pick_pivots(_matrix([r.v for r in sample], dim), n_pivots)

    def at_home(batches):
        for b in batches:
            home, away = homes(_matrix(b.column("v").to_pylist(), dim), pivots)
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(away)], ["home", "away"])

    size, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in distinct.select("v").mapInArrow(at_home, "home int, away double").groupBy("home").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():
        size[r.home], radius[r.home] = r.n, r.r

    def guests(batches):
        for b in batches:
            x = _matrix(b.column("v").to_pylist(), dim)
            seen = visits(x, homes(x, pivots)[0], pivots, radius, theta)
            yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(seen)[1].astype(np.int32))], ["cell"])

    guest = np.zeros(len(pivots), np.int64)
    for r in distinct.select("v").mapInArrow(guests, "cell int").groupBy("cell").count().collect():
        guest[r.cell] = r["count"]
    n_home, n_guest = np.maximum(1, -(-size // block)), -(-guest // block)

    def deal(batches):
        """Each vector to the block pairs of its cell (left, and right where it is the later one), and as a guest."""
        for b in batches:
            x = _matrix(b.column("v").to_pylist(), dim)
            key = b.column("key").to_numpy()
            home = homes(x, pivots)[0]
            seen = visits(x, home, pivots, radius, theta)
            salt = (key.astype(np.uint64) >> np.uint64(20)).astype(np.int64)
            own = salt % n_home[home]
            at, cell, left, right, side = [], [], [], [], []
            for i in range(len(x)):
                h, o = home[i], int(own[i])
                nh, ng = int(n_home[h]), int(n_guest[h])
                # right blocks: home blocks 0..nh-1, then guest blocks
                for j in [*range(o, nh), *range(nh, nh + ng)]:
                    at.append(i), cell.append(h), left.append(o), right.append(j), side.append(0)
                for j in range(o):
                    at.append(i), cell.append(h), left.append(j), right.append(o), side.append(1)
                for c in np.flatnonzero(seen[i]):
                    g = int(n_home[c] + salt[i] % n_guest[c])
                    for j in range(int(n_home[c])):
                        at.append(i), cell.append(c), left.append(j), right.append(g), side.append(1)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(cell, np.int32)), pa.array(np.array(left, np.int32)), pa.array(np.array(right, np.int32)), pa.array(np.array(side, np.int32)), *[b.column(c).take(take) for c in ("key", "key2", "uid", "n", "v")]],
                ["cell", "l", "r", "side", "key", "key2", "uid", "n", "v"],
            )

    dealt = distinct.select("key", "key2", "uid", "n", "v").mapInArrow(deal, "cell int, l int, r int, side int, key long, key2 long, uid long, n long, v binary")
    return dealt.groupBy("cell", "l", "r").applyInPandas(_cell(dim, threshold), "key long, key2 long, links long, a long, b long")


def linked(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have cosine >= threshold: all in single precision first, those in reach of its error in doubles."""
    c = left.astype(np.float32) @ right.astype(np.float32).T
    hit = c >= threshold
    i, j = np.nonzero(np.abs(c - threshold) < 1e-4)
    for s in range(0, len(i), 1 << 16):
        a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        hit[a, b] = np.einsum("ij,ij->i", left[a], right[b]) >= threshold
    return hit


def forest(hit: np.ndarray, left_id: np.ndarray, right_id: np.ndarray) -> list[tuple[int, int]]:
    """Edges of stars, one for each connected part of a two-sided link matrix."""
    out, open_l, open_r = [], hit.any(1), hit.any(0)
    while open_l.any():
        new_l = np.zeros(len(left_id), bool)
        new_l[int(open_l.argmax())] = True
        in_l, in_r = new_l.copy(), np.zeros(len(right_id), bool)
        while new_l.any():
            open_l &= ~new_l
            new_r = hit[new_l].any(0) & open_r
            open_r &= ~new_r
            in_r |= new_r
            new_l = hit[:, new_r].any(1) & open_l
            in_l |= new_l
        ids = np.unique(np.concatenate([left_id[in_l], right_id[in_r]]))
        out += [(int(x), int(ids[0])) for x in ids[1:]]
    return out


def _cell(dim: int, threshold: float):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        same = bool(g.l.iloc[0] == g.r.iloc[0])
        a, b = g[g.side == 0], g if same else g[g.side == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("key", "key2", "links", "a", "b")})
        left, right = _matrix(a.v, dim), _matrix(b.v, dim)
        of_a, of_b, n_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), b.n.to_numpy(np.int64)
        uid_a, uid_b, edges = a.uid.to_numpy(), b.uid.to_numpy(), []
        for s in range(0, len(a), STRIP):
            at = slice(s, s + STRIP)
            hit = linked(left[at], right, threshold)
            if same:
                hit[np.arange(len(hit)), np.arange(s, s + len(hit))] = False
            some = np.flatnonzero(hit.any(0))
            hit = hit[:, some]
            of_a[at] = hit @ n_b[some]
            of_b[some] += a.n.to_numpy(np.int64)[at] @ hit
            edges += forest(hit, uid_a[at], uid_b[some])
        parts = [(a, of_a)] + ([] if same else [(b, of_b)])
        frames = [pd.DataFrame({"key": p.key.to_numpy()[n > 0], "key2": p.key2.to_numpy()[n > 0], "links": n[n > 0]}, dtype="Int64") for p, n in parts]
        frames.append(pd.DataFrame(edges, columns=["a", "b"], dtype="Int64"))
        return pd.concat([f.reindex(columns=["key", "key2", "links", "a", "b"]).astype("Int64") for f in frames])

    return run
