"""MinHash near-duplicates: bottom-k sketches from one hash function, and exact Jaccard links.

A document's set is its distinct word shingles, as 64-bit hashes; documents with equal sets are
one node. One hash function orders all shingles; common ones (found by counters over all documents)
come last. A node's sketch is the k least of the others, where k follows from the share of common
shingles so that a pair at the threshold is missed with a chance under 1e-9. Each two neighbours in
a sketch make one retained value: two documents that share nothing but a frequent passage seldom
have the same neighbours. Nodes that consist of common shingles for more than ``1 - RARE`` retain
the least fifth of their set instead (the prefix that any pair at the threshold must share), so
nothing is left out there either. A shingle is common where its counter stands over ``LIST`` and
over four times the mean counter, so that long texts or large tables never make all of them common.

Inverted lists of the retained values give the candidates. Nodes that share a value share the
least node of its list, their centre, so all candidates of a pair lie below a common centre:

1. every node with that one of its centres that shares most values with it: pairs are filtered by
   size and by the estimate from the union of two short sketches (six deviations below the
   threshold), then verified on the full sets; the links give classes;
2. below a centre of at most ``SMALL`` nodes, the pairs of different classes, filtered and verified
   in the same way;
3. below a centre of at most ``BLOCK`` nodes, those outside its main class with all, on full sets
   in one task;
4. a centre of more nodes is a table of its own: shingles common among its nodes come last, its
   nodes get sketches in that order and new inverted lists, and steps 2 and 3 follow. What still
   meets below one centre then (nodes that share what is rare even there) meets in pairs of blocks.

The retained values of step 4 have the same guarantee as the first ones. Step 2 and 3 differ from
the dealt method in that blocks count full intersections without an estimate before. A link inside
a class is not looked for again, since the classes are all that is asked. The verified links'
connected components are the classes.

Lists are never gathered in one task: they are grouped by minimum and count, and joined. Null or
empty texts, or texts without words: an empty set, linked with nothing. Fewer words than a shingle
has: the whole sequence is the one shingle. Rows with equal ids are rows of one class only if their
texts link. A null id counts as larger than any other. Very long texts are whole sets; blocks are
bounded by shingles (``WEIGHT``) as well as by nodes. Only the id and the text are read, so that
clashing names do no harm. Empty table: empty. Only the counters (a fixed number) reach the driver.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casework.llm.common import components, drop, free_name, look_up, save
from casework.llm.metric_join import forest

WORDS, PERCENT = 5, 80
#: Counters over this number mark a common shingle; the least share of others for sketches.
LIST, RARE = 128, 0.5
#: Counters, and parts that they are summed in.
SLOT_BITS, PARTS = 22, 256
#: Counters of the nodes below one centre, how many of these nodes set their order, and over which share of them a shingle is common.
LOCAL_BITS, ORDER_NODES, LOCAL_COMMON = 16, 512, 0.05
SHORT = 32
#: Nodes of one centre that are compared as pairs; nodes, and shingles, of a block.
SMALL, BLOCK, WEIGHT = 32, 256, 500_000
MISS = 1e-9

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(raw: bytes | None, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of one text."""
    w = raw.lower().split() if raw else []
    if not w:
        return np.zeros(0, _U)
    h = np.array([xxhash.xxh3_64_intdigest(x) for x in w], _U)
    n = min(len(h), words)
    s = h[: len(h) - n + 1] + _U(n)
    for j in range(1, n):
        s = mix(s * _U(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
    return np.unique(mix(s))


@functools.lru_cache(1024)
def sketch_size(rare_percent: int, percent: int) -> int:
    """How many sketch values make a chance of MISS that no two neighbours agree, for a share of values outside the common ones."""
    most_apart = (100 - percent) / percent  # of a node's own size, in a pair at the threshold
    p = max(0.05, 1 - most_apart / max(0.01, rare_percent / 100))
    root = ((1 - p) + math.sqrt((1 - p) ** 2 + 4 * p * (1 - p))) / 2
    return math.ceil(math.log(MISS) / math.log(root))


def retained(s: np.ndarray, level: np.ndarray, percent: int, salt: int = 0) -> np.ndarray:
    """The retained values of a set: neighbours in its sketch, and the prefix where common shingles prevail."""
    if not len(s):
        return s
    lv = level[(s >> _U(64 - (len(level) - 1).bit_length())).astype(np.int64)]
    rare = s[lv == 0]
    share = len(rare) / len(s)
    out = []
    apart = (100 - percent) / percent
    if share >= (RARE - apart) * percent / 100 - 0.01:
        k = sketch_size(int(100 * share), percent)
        low = np.concatenate([np.array([0], _U), rare[:k], np.array([2**64 - 1][len(rare) > k :], _U)])
        out.append(mix(low[:-1] * _U(0xC2B2AE3D27D4EB4F) + low[1:] + _U(salt)))
    if share < RARE:
        n = len(s) - -(-percent * len(s) // 100) + 1
        out.append(mix((s[np.lexsort((s, lv))[:n]] ^ _U(0x165667B19E3779F9)) + _U(salt)))
    return np.unique(np.concatenate(out))


# --- passes over the texts ----------------------------------------------------------------------


def _raw(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, key): key tells apart texts of one id."""
    text = F.col(text_col).cast("binary")
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("key"))


def _count(words: int):
    """Counters of one task, in parts."""

    def run(batches):
        total, held, n = np.zeros(1 << SLOT_BITS, np.uint32), [], 0

        def add():
            slot, c = np.unique((np.concatenate(held) >> _U(64 - SLOT_BITS)).astype(np.uint32), return_counts=True)
            total[slot] += c.astype(np.uint32)
            held.clear()

        for b in batches:
            for t in b.column("text").to_pylist():
                held.append(shingles(t, words))
                n += len(held[-1])
                if n >= 1_000_000:
                    add()
                    n = 0
        if held:
            add()
        if total.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in total.reshape(PARTS, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    return run


def _add(batches):
    """Sums of the counters of each part as levels: 0, or how common."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, raw in zip(b.column("part").to_pylist(), b.column("counts").to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(raw), np.uint32)
            total[part] = total[part] + x if part in total else x.astype(np.int64)
    for part, x in total.items():
        level = as_levels(x, max(LIST, 4 * x.mean()))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["part", "levels"])


def as_levels(counts: np.ndarray, least: float) -> np.ndarray:
    return np.where(counts > least, np.minimum(255, 1 + 4 * np.log2(np.maximum(counts, 1) / least)), 0).astype(np.uint8)


def levels(docs: DataFrame, words: int) -> np.ndarray:
    """For each slot of shingle hashes 0, or how common it is (1 and more); one byte a slot."""
    counted = _raw(docs, docs.columns[0], "text").select("text").mapInArrow(_count(words), "part int, counts binary")
    got = counted.repartition("part").mapInArrow(_add, "part int, levels binary").toArrow()
    out = np.zeros((PARTS, (1 << SLOT_BITS) // PARTS), np.uint8)
    for part, raw in zip(got.column("part").to_pylist(), got.column("levels").to_pylist(), strict=True):
        out[part] = np.frombuffer(raw, np.uint8)
    return out.ravel()


def node_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes())


def _sketches(shared, words: int, percent: int):
    def run(batches):
        level = shared.value
        for b in batches:
            sets = [shingles(t, words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"),
                    b.column("key"),
                    pa.array([node_of(s) for s in sets], pa.uint64()).view(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([retained(s, level, percent).view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                ["id", "key", "node", "n", "keys"],
            )

    return run


def _sets(words: int):
    def run(batches):
        for b in batches:
            sets = [shingles(t, words) for t in b.column("text").to_pylist()]
            keep = pa.array([i for i, s in enumerate(sets) if len(s)], pa.int64())
            sets = [s for s in sets if len(s)]
            short = [(s[:SHORT] >> _U(32)).astype("<u4").tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(keep), b.column("key").take(keep), pa.array([node_of(s) for s in sets], pa.uint64()).view(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(short, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["id", "key", "node", "n", "short", "full"],
            )

    return run


# --- verification -------------------------------------------------------------------------------


def estimate(a: bytes, b: bytes) -> float:
    """Jaccard similarity from the least values of the union of two short sketches."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    k = max(len(x), len(y)) if min(len(x), len(y)) < SHORT else SHORT
    union = np.union1d(x, y)[:k]
    return float(np.isin(union, x, assume_unique=True)[np.isin(union, y, assume_unique=True)].sum()) / max(1, len(union))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _could(least: float):
    """A map over pairs that keeps those whose estimate is not under least."""

    def run(batches):
        for b in batches:
            ok = [estimate(x, y) >= least for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            at = pa.array(np.flatnonzero(ok), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in ("a", "b", "na")], ["a", "b", "na"])

    return run


def _linked_to_hub(percent: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        hub = g[g.side == 1]
        if not len(hub):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        one, rest = np.frombuffer(hub.full.iloc[0], _U), g[g.side == 0]
        ok = [linked(np.frombuffer(x, _U), one, percent) for x in rest.full]
        return pd.DataFrame({"a": rest.node[ok], "b": hub.node.iloc[0]}, dtype="int64")

    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of nodes, those that link, as a written table: by size, by estimate, then on the full sets.

    Full sets move once for each pair's a, and once for each b and block of its partners.
    """
    least = percent / 100 - 6 * math.sqrt(percent / 100 * (1 - percent / 100) / SHORT)
    left, right = (sets.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("short").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    near = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    near = save(near.select("a", "b", "na", "x", "y").mapInArrow(_could(least), "a long, b long, na long"))
    hubs = save(near.groupBy("b").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("na") / WEIGHT)).cast("int").alias("n_blocks")))
    ends = near.join(hubs.hint("merge"), "b").select("b", F.pmod(F.xxhash64("a"), F.col("n_blocks")).cast("int").alias("block"), F.col("a").alias("node"), F.lit(0).alias("side"))
    own = hubs.select("b", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), F.col("b").alias("node"), F.lit(1).alias("side"))
    rows = save(ends.union(own))
    out = save(_with_sets(rows, sets).groupBy("b", "block").applyInPandas(_linked_to_hub(percent), "a long, b long"))
    drop(near, hubs, rows)
    return out


def _with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows, a written table, with the full set of their node."""
    return look_up(sets.select("node", "full"), rows, ["node"], "inner")


def _one_each(sets: DataFrame, repeated: bool) -> DataFrame:
    """Of rows of sets those of the row that stands for the node; one of them, where rows repeat."""
    same = F.col("id").eqNullSafe(F.col("one.id")) & (F.col("key") == F.col("one.key"))
    out = sets.filter(same).select("node", "n", "short", "full")
    return out.dropDuplicates(["node"]) if repeated else out


def _block_links(percent: int):
    """Links between the nodes of side 0 and those of side 1 of a block, as a forest of stars."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        one, many = g[g.side == 0], g[g.side == 1]
        edges: list[tuple[int, int]] = []
        if len(one) and len(many):
            sets = [np.frombuffer(x, _U) for x in many.full]
            sizes = np.array([len(s) for s in sets])
            values = np.concatenate(sets)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], np.repeat(np.arange(len(sets)), sizes)[order]
            hit = np.zeros((len(one), len(many)), bool)
            for i, raw in enumerate(one.full):
                s = np.frombuffer(raw, _U)
                lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
                n = hi - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(sets))
                hit[i] = 100 * both >= percent * (len(s) + sizes - both)
            hit &= one.node.to_numpy()[:, None] != many.node.to_numpy()[None, :]
            edges = forest(hit, one.node.to_numpy(), many.node.to_numpy())
        return pd.DataFrame(np.array(edges, np.int64).reshape(-1, 2), columns=["a", "b"])

    return run


# --- below centres ------------------------------------------------------------------------------


def _mixed(member: DataFrame) -> DataFrame:
    """(center, total, weight, main, n_apart) of the centres whose nodes (center, node, n, label) are in more classes than one."""
    per_label = member.groupBy("center", "label").agg(F.count("*").alias("n_label"), F.sum("n").alias("weight"))
    centers = per_label.groupBy("center").agg(F.sum("n_label").alias("total"), F.sum("weight").alias("weight"), F.count("*").alias("n_labels"), F.max(F.struct("n_label", "label")).alias("main"))
    return centers.filter("n_labels > 1").select("center", "total", "weight", F.col("main.label").alias("main"), (F.col("total") - F.col("main.n_label")).alias("n_apart"))


def _pairs(member: DataFrame, centers: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different classes and of sizes that could link, below centres of few nodes."""
    few = save(member.join(centers.filter(F.col("total") <= SMALL).select("center").hint("merge"), "center", "left_semi"))
    x, y = (few.select("center", F.col("node").alias(c), F.col("label").alias(f"label_{c}"), F.col("n").alias(f"n_{c}")) for c in ("a", "b"))
    could = (F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    out = save(x.join(y.hint("merge"), "center").filter(could).select("a", "b").distinct())
    drop(few)
    return out


def _in_blocks(member: DataFrame, centers: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the nodes outside a centre's main class and all of its nodes, in pairs of blocks, as forests."""
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col("weight") / WEIGHT * F.col(n) / F.col("total"))).cast("int")
    big = centers.withColumns({"n_blocks": blocks("total"), "n_asking": blocks("n_apart")})
    every = save(member.join(big.hint("merge"), "center").select("center", "node", "n_blocks", "n_asking", (F.col("label") != F.col("main")).alias("apart")))
    many = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    slot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    one = every.filter("apart").select("center", many("n_blocks").alias("block"), slot("n_asking").alias("asking"), F.lit(0).alias("side"), "node")
    other = every.select("center", slot("n_blocks").alias("block"), many("n_asking").alias("asking"), F.lit(1).alias("side"), "node")
    rows = save(one.union(other))
    out = save(_with_sets(rows, sets).groupBy("center", "block", "asking").applyInPandas(_block_links(percent), "a long, b long"))
    drop(every, rows)
    return out


def _order(g: pd.DataFrame) -> pd.DataFrame:
    """How common each shingle is among nodes of one centre, as levels by slot."""
    slots = np.concatenate([np.unique((np.frombuffer(x, _U) >> _U(64 - LOCAL_BITS)).astype(np.int64)) for x in g.full])
    level = as_levels(np.bincount(slots, minlength=1 << LOCAL_BITS), max(2.0, LOCAL_COMMON * len(g)))
    return pd.DataFrame({"center": [g.center.iloc[0]], "level": [zlib.compress(level.tobytes(), 1)]})


def _local_keys(percent: int):
    def run(batches):
        level, of = None, None
        for b in batches:
            keys = []
            for center, raw, full in zip(b.column("center").to_pylist(), b.column("level").to_pylist(), b.column("full").to_pylist(), strict=True):
                if of != center:
                    level, of = np.frombuffer(zlib.decompress(raw), np.uint8), center
                keys.append(retained(np.frombuffer(full, _U), level, percent, center & (2**64 - 1)).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(keys, pa.list_(pa.int64()))], ["node", "keys"])

    return run


def _again(member: DataFrame, big: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Below centres of many nodes: new centres (center, node, n, label) from inverted lists in an order of their own."""
    own = save(member.join(big.select("center").hint("merge"), "center", "left_semi"))
    full = save(_with_sets(own, sets).select("center", "node", "full"))
    # any part of the nodes may set the order, as long as all follow it; the rank cut needs no node's set
    rank = F.row_number().over(Window.partitionBy("center").orderBy(F.xxhash64("node"), "node"))
    first = save(own.select("center", "node").withColumn("rank", rank).filter(F.col("rank") <= ORDER_NODES).select("center", "node"))
    order = save(look_up(full, first, ["center", "node"], "left_semi").groupBy("center").applyInPandas(_order, "center long, level binary"))
    keyed = full.join(order.hint("merge"), "center").select("center", "node", "level", "full").mapInArrow(_local_keys(percent), "node long, keys array<long>")
    stars, used = _stars(save(keyed))
    own_node = own.select("node", "n", "label").distinct()
    out = save(stars.select("center", "node").distinct().join(own_node.hint("merge"), "node").select("center", "node", "n", "label"))
    drop(own, full, first, order, stars, *used)
    return out


def _stars(keyed: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(node, center, count): how many lists of its values each node shares with their least node; and the tables behind it.

    keyed, a written table: (node, keys).
    """
    values = keyed.select("node", F.explode("keys").alias("key"))
    lists = save(values.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most").select("key", "least"))
    return save(values.join(lists.hint("merge"), "key").groupBy("node", F.col("least").alias("center")).count()), [keyed, lists]


# --- the classes --------------------------------------------------------------------------------


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(id, key, n, first, repeated) of each row, a written table: first = struct(no_id, id, key) of its class's first row."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    raw = _raw(texts, "id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(levels(texts, words))
    found = save(raw.mapInArrow(_sketches(shared, words, percent), f"id {kind}, key long, node long, n long, keys array<long>"))
    shared.unpersist()
    # copies are one node: the first of its rows stands for it
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "key")
    nodes = save(found.filter("n > 0").groupBy("node").agg(F.min(row).alias("one"), F.count("*").alias("copies")))
    stars, used = _stars(found.filter("n > 0").select("node", "keys"))
    in_lists = save(stars.select("node").distinct())
    wanted = save(look_up(nodes, in_lists, ["node"], "left_semi").select("node", F.struct("one.id", "one.key").alias("one")))
    repeated = not found.groupBy(F.col("id").isNull(), "id", "key").count().filter("count > 1").isEmpty()
    sets = save(_one_each(look_up(raw.mapInArrow(_sets(words), f"id {kind}, key long, node long, n long, short binary, full binary"), wanted, ["node"], "inner"), repeated))
    drop(wanted, in_lists, *used[1:])

    # of the least nodes of its lists, the one that shares most
    best = save(stars.filter("node <> center").groupBy("node").agg(F.max(F.struct("count", F.col("center").alias("b"))).alias("m")).select(F.col("node").alias("a"), "m.b"))
    edges = verify(best, sets, percent)
    labels = components(edges).select(F.col("id").alias("node"), F.col("component").alias("label"))
    size = sets.select("node", "n")
    member = save(stars.select("center", "node").join(labels.hint("merge"), "node", "left").join(size.hint("merge"), "node").select("center", "node", "n", F.coalesce("label", "node").alias("label")))
    centers = save(_mixed(member))
    drop(stars, best)

    # nodes of one centre that are still apart
    some, links = [_pairs(member, centers, percent)], []
    middle = centers.filter((F.col("total") > SMALL) & (F.col("total") <= BLOCK))
    links.append(_in_blocks(member, middle, sets, percent))
    big = centers.filter(F.col("total") > BLOCK)
    if not big.isEmpty():
        again = _again(member, big, sets, percent)
        inner = save(_mixed(again))
        some.append(_pairs(again, inner, percent))
        links.append(_in_blocks(again, inner.filter(F.col("total") > SMALL), sets, percent))
        drop(again, inner)
    pairs = save(functools.reduce(DataFrame.union, some).distinct())
    links.append(verify(pairs, sets, percent))
    labels = components(functools.reduce(DataFrame.union, [edges, *links]))
    drop(sets, member, centers, pairs, edges, *some, *links)

    # the first row of each class
    per = save(nodes.join(labels.select(F.col("id").alias("node"), "component").hint("merge"), "node", "left").select("node", "one", F.coalesce("component", "node").alias("component")))
    least = save(per.groupBy("component").agg(F.min("one").alias("first")))
    first = save(per.join(least.hint("merge"), "component").select("node", "first"))
    alone = F.when(F.col("n") == 0, row).otherwise(F.col("first"))
    out = save(look_up(found.select("id", "key", "node", "n"), first, ["node"]).select("id", "key", "n", alone.alias("first")))
    drop(found, nodes, per, least, first)
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row; a row without an id is kept where its class has none."""
    out = _classes(docs, id_col, text_col, words, percent)
    component = F.col("first.id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each class, with all columns: that of the least id (a null id last), then of one text.

    Works by row: rows that share an id but not a class all stay. Rows without words all stay.
    """
    found = _classes(docs, id_col, text_col, words, percent)
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))
    kept = save(found.filter(stays & (F.col("n") > 0)).groupBy(F.col("id").isNull().alias("no_id"), "id", "key").agg(F.count("*").alias("copies")))
    blank = save(found.filter("n = 0").select(F.col("id").isNull().alias("no_id"), "id", "key", F.lit(1).cast("long").alias("copies")).distinct())
    no_id, id_, key, copies = (free_name(docs, x) for x in ("no_id", "row_id", "text_key", "copies"))
    plain = lambda c: F.coalesce(c, F.lit(0).cast(docs.schema[id_col].dataType))
    wanted = save(kept.union(blank).select(F.col("no_id").alias(no_id), plain(F.col("id")).alias(id_), F.col("key").alias(key), F.col("copies").alias(copies)))
    text = F.col(f"`{text_col}`").cast("binary")
    rows = docs.withColumns({no_id: F.col(f"`{id_col}`").isNull(), id_: plain(F.col(f"`{id_col}`")), key: F.xxhash64(text)})
    rows = look_up(rows, wanted, [no_id, id_, key], "inner")
    once = rows.filter(F.col(copies) == 1)
    if not wanted.filter(F.col(copies) > 1).isEmpty():  # repeated rows
        once = once.unionByName(rows.filter(F.col(copies) > 1).dropDuplicates([no_id, id_, key]))
    drop(found, kept, blank)
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])
