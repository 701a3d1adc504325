"""Mixing sources to target weights: balanced sampling by the cube method.

Sources in code-point order, null last, weigh 5, 2, 1, repeating, and share the size of all
documents; a target stops at ``most`` times its source's size and the excess goes to the others
by weight. A document of a source with rate target/size is taken floor(rate) times, and once more
with the fractional part as inclusion probability. Which ones: the flight phase of the cube method
moves the probabilities of a block of documents through the null space of the constraints (size
total and document total), so that both totals stay, until at most two documents of the block are
undecided; the undecided ones of all blocks of a source meet in new blocks, until one block a
source remains. Its two or fewer undecided documents are the landing problem: the choice nearest
to the balance. Blocks are slices by a hash of id, size and text, so a source of a third of all rows is many tasks.

Null text: size 0, taken 0. Null source: a source of its own, last. Repeated rows: each counts.
Empty table: empty. Reruns agree: all random numbers come from hashes of the rows themselves.
Columns other than id, text and source are not read; clashing names do no
harm. Very long texts are counted whole, in the JVM.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casework.llm.common import free_name, look_up, save

WEIGHTS = (5, 2, 1)
MOST = 3
#: Documents of a block.
BLOCK = 256

WORD = "[^\\x20\\x09-\\x0D]+"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, key): the number of words of each whole text, and a hash of it."""
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text_col).alias("key"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, target), one row a source.

    The common level x of targets min(most * size, x * weight) is found by a few sums over the
    sources; the number of a source in code-point order comes from a sort by range.
    """
    per = save(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    # one row a source: number them by range partition, then inside each
    ranged = save(per.repartitionByRange(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id()))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("before"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int"))
    per = save(ranged.join(F.broadcast(starts), "part").select("source", "source_size", "n_docs", weight.cast("double").alias("weight")))
    total = float(per.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, F.lit(False)
    while total:
        full, rest = per.agg(F.sum(F.when(capped, most * F.col("source_size"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if not rest:
            break
        found = (total - float(full or 0)) / rest
        if found == level:
            break
        level, capped = found, F.lit(found) * F.col("weight") > most * F.col("source_size")
    return per.select("source", "source_size", "n_docs", F.when(capped, most * F.col("source_size")).otherwise(F.lit(level) * F.col("weight")).cast("double").alias("target"))


def flight(p: np.ndarray, size: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """The fast flight phase: probabilities at 0 or 1 but for two or fewer; sum(p) and sum(p * size) stay."""
    p = p.copy()
    order = [i for i in range(len(p)) if 0 < p[i] < 1]
    window: list[int] = []
    at = 0
    while True:
        while len(window) < 3 and at < len(order):
            window.append(order[at])
            at += 1
        if len(window) < 3:
            return p
        # u with u.1 = 0 and u.size = 0
        (a, b, c) = (size[i] for i in window)
        u = np.array([c - b, a - c, b - a], float)
        if not u.any():
            u = np.array([1.0, -1.0, 0.0])
        q = p[window]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min()
            down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)).min()
        q = q + up * u if random.random() * (up + down) < down else q - down * u
        q[np.abs(q) < 1e-9] = 0
        q[np.abs(q - 1) < 1e-9] = 1
        p[window] = q
        window = [i for i, v in zip(window, q, strict=True) if 0 < v < 1]


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The choice of the few undecided documents that is nearest to the balance of sizes, then of documents."""
    p = p.copy()
    open_ = [i for i in range(len(p)) if 0 < p[i] < 1]
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum((m >> j & 1) * size[i] - p[i] * size[i] for j, i in enumerate(open_))), abs(sum((m >> j & 1) - p[i] for j, i in enumerate(open_))), m))
    for j, i in enumerate(open_):
        p[i] = best >> j & 1
    return p


def cube(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows (id, source, size, key, p, n_docs) with p moved to 0 or 1, source by source."""
    def move(last: bool):
        def step(key, g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(["id", "size", "key", "p"], kind="stable", na_position="last")
            seed = zlib.crc32(repr(key).encode())
            p = flight(g.p.to_numpy(float), g["size"].to_numpy(float), np.random.default_rng(seed))
            return g.assign(p=land(p, g["size"].to_numpy(float)) if last else p)

        return step

    cols = ["id", "source", "size", "key", "p", "n_docs"]
    rows = rows.select(*cols)
    done, level = [], 0
    while True:
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block))
        keyed = rows.withColumn("part", F.pmod(F.xxhash64("id", "size", "key", F.lit(level)), blocks))
        last = (rows.agg(F.max("n_docs")).first()[0] or 0) <= block
        moved = save(keyed.groupBy("source", "part").applyInPandas(move(last), keyed.schema))
        if last:
            return union_all([*done, moved.select(*cols)])
        done.append(moved.filter("p = 0 or p = 1").select(*cols))
        # at most two of each block are left
        rows = moved.filter("p > 0 and p < 1").withColumn("n_docs", 2 * F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block))).select(*cols)
        level += 1


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(id, source, size, source_size, target, times, taken): how often the mix takes each document."""
    sized = save(sizes(docs, id_col, text_col, source_col))
    # a null source joins as a source of its own
    plain = lambda c: F.concat(F.when(c.isNull(), F.lit("n")).otherwise(F.lit("s")), F.coalesce(c.cast("string"), F.lit("")))
    per = save(targets(sized, weights, most).select(plain(F.col("source")).alias("of"), "source_size", "n_docs", "target"))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    rows = look_up(sized.withColumn("of", plain(F.col("source"))), per, ["of"]).select("id", "source", "size", "key", "n_docs", (rate - F.floor(rate)).alias("p"))
    placed = look_up(cube(rows, block).withColumn("of", plain(F.col("source"))), per, ["of"])
    times = F.floor(rate) + F.round("p").cast("long")
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", times.alias("times"), (F.when(F.col("size") > 0, times).otherwise(0) * F.col("size")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """docs as the mix takes them: each row as often as its ``times``, with the same columns."""
    row, times_, copy = (free_name(docs, x) for x in ("_row", "_times", "_copy"))
    rows = save(docs.select("*", F.monotonically_increasing_id().alias(row)))
    times = save(mix(rows, row, text_col, source_col, weights, most, block).filter("times > 0").select(row, F.col("times").cast("int").alias(times_)))
    return look_up(rows, times, [row], "inner").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times_)))).select(*[F.col(f"`{c}`") for c in docs.columns])
