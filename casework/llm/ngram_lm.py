"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

Tokens are the words of the whole text, lower-cased in A-Z, then one end. Training counts tokens
exactly (a table) and pairs of tokens, in packed blobs by slot, each shuffled once. Every pair,
also one seen once, enters the Bloom filter of its slot once for each level 1..q of its count's
logarithm; probing level by level until a miss gives the least count of the level back. A token's
probability is

    p(w | h) = (count(h w) + K p(w)) / (count(h) + K),    p(w) = (c + 1) / (N + V + 1)

so the probabilities of a history sum to 1 but for the quantising: counts are rounded down by less
than ``BASE`` times, so they sum to at most 1 and at least 1 / ``BASE``, false hits aside. A probe
for a pair that training lacks hits with a chance of about 2e-4 for the filter and as much for the
32 bits that tell keys of a slot apart.

The frequent tokens (at most ``DICT_ROWS`` entries, 16 bytes each) are broadcast with their exact
counts. Counts of other tokens reach the sums by a join; as histories they are kept in the filter,
in the slot of all their pairs. A slot holds the pairs of about ``SLOT_BYTES`` of text, whatever
the corpus. If all slots together have at most ``FILTER_BYTES``, they are broadcast to the workers
and the texts are scored where they are read. Beyond it nothing of the filter is broadcast: the
texts are read once all the same, their probes travel in packed blobs to the slots that answer
them, and sums by document travel back. Both ways give the same scores.

Tokens are known by 64-bit hashes. Null text: as empty (one end token). Repeated rows: each counts
and is scored. Null ids are kept and are in the training part. Very long texts are whole: a task
holds a batch of texts and one chunk of their tokens. Columns other than the id and the text are
not read, so that clashing names do no harm. Empty table: empty.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.common import save

#: Entries of the broadcast part of the token counts (16 bytes each).
DICT_ROWS = 1 << 19
#: Bytes of filter that may be broadcast.
FILTER_BYTES = 32 << 20
#: Bytes of training text for each slot of the filter.
SLOT_BYTES = 4 << 20
#: Tokens and documents of a chunk.
CHUNK_TOKENS, CHUNK_DOCS = 1_000_000, 1 << 16
BITS, PROBES = 20, 7
BASE, K = 1.5, 2.0
#: Base probabilities travel as steps of their logarithm; the last number marks one that is not known yet.
STEPS, UNKNOWN = 4096, 0xFFFF

_U = np.uint64
END, BEGIN = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
_TOTAL = _U(0x85EBCA6B2545F491)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h * _U(0x9E3779B97F4A7C15) + w)


def low(key: np.ndarray) -> np.ndarray:
    return (key & _U(0xFFFFFFFF)).astype("<u4")


def hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts one after the other, ends included, and the number of tokens of each."""
    f, out, sizes = xxhash.xxh3_64_intdigest, [], []
    for t in texts:
        words = t.lower().split() if t else []
        out += map(f, words)
        out.append(int(END))
        sizes.append(len(words) + 1)
    return np.array(out, _U), np.array(sizes, np.int64)


def histories(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    prev = np.empty_like(h)
    prev[1:] = h[:-1]
    prev[np.cumsum(sizes) - sizes] = BEGIN
    return prev


def slot_of(prev: np.ndarray, pair: np.ndarray, frequent: np.ndarray, n: int) -> np.ndarray:
    """The slot of each pair: that of the pair where its history is frequent, else that of its history."""
    return ((mix(np.where(frequent, pair, prev ^ _TOTAL)) >> _U(33)) % _U(n)).astype(np.int64)


class Dictionary:
    """The frequent tokens' hashes, sorted, and their counts; BEGIN counts as one of them."""

    def __init__(self, token: np.ndarray, count: np.ndarray, n_docs: int):
        self.token, self.count, self.n_docs = token, count, n_docs

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The count of each token, -1 where it is not here."""
        if not len(self.token):
            found = np.full(len(h), -1, np.int64)
        else:
            at = np.minimum(np.searchsorted(self.token, h), len(self.token) - 1)
            found = np.where(self.token[at] == h, self.count[at], -1)
        found[h == BEGIN] = self.n_docs
        return found


# --- the filter ---------------------------------------------------------------------------------


def levels(c: np.ndarray) -> np.ndarray:
    """1 + log of count, rounded down."""
    return 1 + np.floor(np.log(np.maximum(c, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def count_at(q: np.ndarray) -> np.ndarray:
    """The least count of a level; 0 for level 0. The levels 1 to 4 stand for their counts themselves."""
    return np.where(q > 0, np.ceil(BASE ** (np.maximum(q, 1) - 1.0) - 1e-9), 0.0)


def _bits(key: np.ndarray, level: np.ndarray | int, i: int, m: int) -> np.ndarray:
    x = mix(key.astype(_U) + _U(0x632BE59BD9B4E019) * np.asarray(level, _U))
    x = mix(x + _U(i)) >> _U(32)
    return ((x * _U(m)) >> _U(32)).astype(np.int64)


def segment(keys: np.ndarray, q: np.ndarray) -> bytes:
    """A filter that holds each key at levels 1..q."""
    m = max(64, (int(q.sum()) * BITS + 7) // 8 * 8)
    bits = np.zeros(m, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        own = keys[q >= level]
        for i in range(PROBES):
            bits[_bits(own, level, i, m)] = True
    return np.packbits(bits).tobytes()


def level_in(raw: bytes | None, keys: np.ndarray) -> np.ndarray:
    """The highest level up to which every level of each key is in a segment."""
    found = np.zeros(len(keys), np.int64)
    if not raw or not len(keys):
        return found
    raw = np.frombuffer(raw, np.uint8)
    live, level = np.arange(len(keys)), 1
    while True:
        for i in range(PROBES):
            at = _bits(keys[live], level, i, len(raw) * 8)
            live = live[(raw[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
            if not len(live):
                return found
        found[live] = level
        level += 1


# --- training -----------------------------------------------------------------------------------


def _chunks(batches):
    """(record batch, hashes, sizes) of chunks of rows."""
    for b in batches:
        texts = b.column("text").to_pylist()
        start, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or b"") // 2 + 1  # no text has more tokens
            if size >= CHUNK_TOKENS or i - start + 1 >= CHUNK_DOCS or i == len(texts) - 1:
                yield (b.slice(start, i + 1 - start), *hashes(texts[start : i + 1]))
                start, size = i + 1, 0


def _held(batches):
    """Hashes and sizes of about a chunk's tokens at a time, over several batches."""
    held, n = [], 0
    for _, h, sizes in _chunks(batches):
        held.append((h, sizes))
        n += len(h)
        if n >= CHUNK_TOKENS:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _count_tokens(batches):
    for h, _ in _held(batches):
        u, c = np.unique(h, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], ["token", "c"])


def _count_pairs(shared, slots: int):
    """Blobs of pair counts by slot: keys of those seen once, then of the others with their counts."""

    def run(batches):
        frequent = shared.value
        for h, sizes in _held(batches):
            prev = histories(h, sizes)
            pair = pair_key(prev, h)
            u, first, c = np.unique(pair, return_index=True, return_counts=True)
            prev = prev[first]
            known = frequent(prev) >= 0
            slot, key = slot_of(prev, u, known, slots), low(u)
            # a rare history is counted in the slot of its pairs
            rare, inv = np.unique(prev[~known], return_inverse=True)
            slot = np.concatenate([slot, slot_of(rare, rare, np.zeros(len(rare), bool), slots)])
            key = np.concatenate([key, low(mix(rare ^ _TOTAL))])
            c = np.concatenate([c, np.bincount(inv, c[~known], len(rare)).astype(np.int64)])
            order = np.lexsort((c > 1, slot))
            slot, key, c = slot[order], key[order], c[order]
            at = np.flatnonzero(np.diff(slot, prepend=-1))
            end = np.append(at[1:], len(slot))
            ones = [int((c[a:e] == 1).sum()) for a, e in zip(at, end, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot[at]), pa.array([key[a:e].tobytes() for a, e in zip(at, end, strict=True)], pa.binary()), pa.array([c[a + n : e].astype("<u8").tobytes() for a, e, n in zip(at, end, ones, strict=True)], pa.binary())],
                ["slot", "keys", "counts"],
            )

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """All blobs of one slot to its segment."""
    keys = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["keys"]])
    counts = []
    for k, c in zip(pdf["keys"], pdf["counts"], strict=True):
        more = np.frombuffer(c, "<u8")
        counts += [np.ones(len(k) // 4 - len(more), np.int64), more.astype(np.int64)]
    u, inv = np.unique(keys, return_inverse=True)
    bits = segment(u, levels(np.bincount(inv, np.concatenate(counts), len(u))))
    return pd.DataFrame({"slot": [int(pdf.slot.iloc[0])], "n_bytes": [len(bits)], "bits": [bits]})


class Counts:
    """What training gathers: token counts (a table), the filter by slot (a table), the frequent tokens, totals."""

    def __init__(self, tokens: DataFrame, parts: DataFrame, frequent: Dictionary, least: int, n: int, v: int, slots: int):
        self.tokens, self.parts, self.frequent, self.least, self.n, self.v, self.slots = tokens, parts, frequent, least, n, v, slots


def train(docs: DataFrame, text_col: str = "text", dict_rows: int = DICT_ROWS, slot_bytes: int = SLOT_BYTES) -> Counts:
    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    tokens = save(texts.mapInArrow(_count_tokens, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")))
    n, v, n_docs = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("token") == int(END.view(np.int64)), F.col("c"))), F.lit(0))).first()
    least, frequent = dictionary(tokens, int(n_docs), dict_rows)
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = max(1, -(-n_bytes // slot_bytes))
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    blobs = texts.mapInArrow(_count_pairs(shared, slots), "slot long, keys binary, counts binary")
    parts = save(blobs.groupBy("slot").applyInPandas(_merge, "slot long, n_bytes long, bits binary"))
    shared.unpersist()
    return Counts(tokens, parts, frequent, least, int(n), int(v), slots)


def dictionary(tokens: DataFrame, n_docs: int, rows: int = DICT_ROWS) -> tuple[int, Dictionary]:
    """The least count of the frequent tokens, and these: at most ``rows`` of them."""
    by = {int(r.j): int(r.n) for r in tokens.groupBy(F.floor(F.log2("c")).alias("j")).agg(F.count("*").alias("n")).collect()}
    least = 64
    while least and sum(n for j, n in by.items() if j >= least - 1) <= rows:
        least -= 1
    if least == 64:
        return 2**62, Dictionary(np.zeros(0, _U), np.zeros(0, np.int64), n_docs)
    got = tokens.filter(F.col("c") >= 2**least).toArrow()
    token = got.column("token").to_numpy().view(_U)
    order = np.argsort(token)
    return 2**least, Dictionary(token[order], got.column("c").to_numpy()[order], n_docs)


# --- scoring ------------------------------------------------------------------------------------

_ASK = ["low", "p", "doc", "often", "tail", "hist"]
#: Rows of a pass over the texts: what a document knows by itself (kind 2), sums of documents packed by chunk (3), tokens whose p(w) is not known yet (4).
_FOUND = {"kind": "int", "row": "long", "id": None, "n_tokens": "long", "n_known": "long", "base": "double", "score": "double", "docs": "binary", "sums": "binary", "token": "long", "count": "double", "minus": "double", "times": "long"}
_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def asks(h: np.ndarray, sizes: np.ndarray, frequent: Dictionary, n_all: float, slots: int):
    """What a chunk knows by itself, and what it asks each slot.

    Gives (known, base, score) sums by document of the frequent tokens, and a list of (slot, ask):
    keys, steps of log p(w), documents, how often (if more than once), hashes of tokens that are
    not frequent, keys of histories that are not.
    """
    n = len(sizes)
    doc = np.repeat(np.arange(n), sizes)
    prev = histories(h, sizes)
    u, inv = np.unique(h, return_inverse=True)
    count = frequent(u)[inv]
    here = count >= 0
    p = np.where(here, count + 1, 1) / n_all
    add = lambda x, on: np.bincount(doc[on], x[on], n)
    c_prev = np.empty(len(h), np.int64)
    c_prev[1:] = count[:-1]
    c_prev[np.cumsum(sizes) - sizes] = frequent.n_docs
    known = c_prev >= 0
    score = -add(np.log10(np.maximum(c_prev, 0) + K), known)
    # each pair of a document once
    pair = pair_key(prev, h)
    order = np.lexsort((pair, doc))
    new = np.ones(len(h), bool)
    new[1:] = (pair[order][1:] != pair[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    at = order[new]
    times = np.diff(np.append(np.flatnonzero(new), len(h)))
    steps = np.where(here, np.minimum(UNKNOWN - 1, np.round(-np.log10(p) * STEPS)), UNKNOWN).astype("<u2")
    slot = slot_of(prev[at], pair[at], known[at], slots)
    by = np.argsort(slot, kind="stable")
    at, times, slot = at[by], times[by], slot[by]
    key, step, of, token, rare_token = low(pair[at]), steps[at], doc[at].astype("<u2"), h[at], ~here[at]
    hist, rare_hist = low(mix(prev[at] ^ _TOTAL)), ~known[at]
    out = []
    cuts = np.flatnonzero(np.diff(slot, prepend=-1))
    for a, e in zip(cuts, np.append(cuts[1:], len(slot)), strict=True):
        often, rare = np.flatnonzero(times[a:e] > 1), np.flatnonzero(rare_hist[a:e])
        ask = (key[a:e], step[a:e], of[a:e], np.stack([often, times[a:e][often]]).astype("<i8"), token[a:e][rare_token[a:e]], np.stack([rare.astype("<u4"), hist[a:e][rare]]))
        out.append((int(slot[a]), tuple(x.tobytes() for x in ask)))
    return np.bincount(doc[here], count[here] > 0, n).astype(np.int64), add(np.log10(p), here), score, out


def answer(bits: bytes | None, asked: list[tuple]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Answers to asks of one slot, all in one: (documents, their sums), and (document, token, count, minus, times) of the tokens whose p(w) is not known yet.

    A document is the number of its ask times 65,536 plus its number in the chunk.
    """
    parts = [[np.frombuffer(x, t) for x, t in zip(ask, ("<u4", "<u2", "<u2", "<i8", "<i8", "<u4"), strict=True)] for ask in asked]
    sizes = np.array([len(x[0]) for x in parts])
    start = np.cumsum(sizes) - sizes
    key, steps, doc, tail = (np.concatenate([x[i] for x in parts]) for i in (0, 1, 2, 4))
    doc = np.repeat(np.arange(len(parts)), sizes) * CHUNK_DOCS + doc
    c = count_at(level_in(bits, key))
    minus, times = np.zeros(len(key)), np.ones(len(key), np.int64)
    rare, hist = (np.concatenate([x[5].reshape(2, -1)[i] + (at if not i else 0) for x, at in zip(parts, start, strict=True)]) for i in (0, 1))
    minus[rare] = np.log10(count_at(level_in(bits, hist.astype("<u4"))) + K)
    often, n = (np.concatenate([x[3].reshape(2, -1)[i] + (at if not i else 0) for x, at in zip(parts, start, strict=True)]) for i in (0, 1))
    times[often] = n
    open_ = steps == UNKNOWN
    value = times * (np.log10(c + K * 10.0 ** (-steps.astype(float) / STEPS)) - minus)
    docs, inv = np.unique(doc[~open_], return_inverse=True)
    return docs, np.bincount(inv, value[~open_], len(docs)), (doc[open_], tail, c[open_], minus[open_], times[open_])


def _batch(kind: pa.DataType, n: int, columns: dict, names: dict = _FOUND) -> pa.RecordBatch:
    """A batch of n rows with these columns (arrays, or one value), the others null."""
    out = []
    for name, t in names.items():
        t, x = _ARROW.get(t, kind), columns.get(name)
        out.append(pa.nulls(n, t) if x is None else x if isinstance(x, pa.Array) else pa.array(x if isinstance(x, (list, np.ndarray)) else [x] * n, t))
    return pa.RecordBatch.from_arrays(out, list(names))


def _answered(kind: pa.DataType, row0: np.ndarray, found):
    """Rows of the answers to asks of chunks that start at row0."""
    docs, sums, (doc, token, count, minus, times) = found
    cuts = np.searchsorted(docs, np.arange(len(row0) + 1) * CHUNK_DOCS)
    some = np.flatnonzero(np.diff(cuts))
    if len(some):
        low_ = (docs % CHUNK_DOCS).astype("<u2")
        yield _batch(kind, len(some), {"kind": 3, "row": row0[some], "docs": [low_[cuts[i] : cuts[i + 1]].tobytes() for i in some], "sums": [sums[cuts[i] : cuts[i + 1]].tobytes() for i in some]})
    if len(doc):
        yield _batch(kind, len(doc), {"kind": 4, "row": row0[doc // CHUNK_DOCS] + doc % CHUNK_DOCS, "token": token, "count": count, "minus": minus, "times": times})


def _own(rows: pa.RecordBatch, sizes, known, base, score) -> dict:
    return {"kind": 2, "row": rows.column("row"), "id": rows.column("id"), "n_tokens": sizes, "n_known": known, "base": base, "score": score}


def _score_here(shared, n_all: float, slots: int):
    def run(batches):
        frequent, bits = shared.value
        for rows, h, sizes in _chunks(batches):
            *own, out = asks(h, sizes, frequent, n_all, slots)
            kind = rows.schema.field("id").type
            yield _batch(kind, rows.num_rows, _own(rows, sizes, *own))
            for slot, ask in out:
                yield from _answered(kind, rows.column("row")[:1].to_numpy(), answer(bits.get(slot), [ask]))

    return run


_ASKED = {"slot": "long", "bits": "binary", **{f"a_{c}": "binary" for c in _ASK}, **{c: _FOUND[c] for c in ("kind", "row", "id", "n_tokens", "n_known", "base", "score")}}


def _ask(shared, n_all: float, slots: int):
    """Rows that go to the slots: kind 1 asks, kind 2 what is known already."""

    def run(batches):
        frequent = shared.value
        for rows, h, sizes in _chunks(batches):
            *own, out = asks(h, sizes, frequent, n_all, slots)
            kind, row = rows.schema.field("id").type, rows.column("row").to_numpy()
            yield _batch(kind, rows.num_rows, {"slot": row % slots, **_own(rows, sizes, *own)}, _ASKED)
            blobs = dict(zip([f"a_{c}" for c in _ASK], map(list, zip(*(a for _, a in out), strict=True)), strict=True))
            yield _batch(kind, len(out), {"slot": [s for s, _ in out], "kind": 1, "row": int(row[0]), **blobs}, _ASKED)

    return run


def _answer(batches):
    """Rows in order of slot and kind: a slot's filter, then what it is asked."""
    slot, bits = -1, None
    for b in batches:
        kinds, slots, rows = (b.column(c).to_numpy() for c in ("kind", "slot", "row"))
        kind = b.schema.field("id").type
        of_slots = np.flatnonzero(kinds < 2)
        # asks of one slot that stand together are answered together
        new = np.flatnonzero((np.diff(slots[of_slots], prepend=-1) != 0) | (kinds[of_slots] == 0) | (np.diff(kinds[of_slots], prepend=0) != 0))
        for at in np.split(of_slots, new[1:]) if len(of_slots) else ():
            if kinds[at[0]] == 0:
                slot, bits = slots[at[0]], b.column("bits")[int(at[0])].as_py()
            else:
                asked = list(zip(*(b.column(f"a_{c}").take(pa.array(at)).to_pylist() for c in _ASK), strict=True))
                yield from _answered(kind, rows[at], answer(bits if slots[at[0]] == slot else None, asked))
        at = pa.array(np.flatnonzero(kinds == 2))
        if len(at):
            yield _batch(kind, len(at), {c: b.column(c).take(at) for c in _ASKED if c in _FOUND})


def _unpacked(batches):
    """Sums of documents from rows (row, docs, sums) in order of row, the first row of a chunk."""
    row0, total = None, np.zeros(0)

    def out():
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(row0 + at), pa.array(total[at])], ["row", "score"])

    for b in batches:
        for row, docs, sums in zip(*(b.column(c).to_pylist() for c in ("row", "docs", "sums")), strict=True):
            if row != row0:
                if row0 is not None:
                    yield out()
                row0, total = row, np.zeros(CHUNK_DOCS)
            total[np.frombuffer(docs, "<u2")] += np.frombuffer(sums)
    if row0 is not None:
        yield out()


def score(docs: DataFrame, counts: Counts, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of each whole text, log10."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    n_all, slots = float(counts.n + counts.v + 1), counts.slots
    schema = lambda names: ", ".join(f"{c} {t or kind}" for c, t in names.items())
    # consecutive numbers in each partition, so that a chunk is known by its first
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    if (counts.parts.agg(F.sum("n_bytes")).first()[0] or 0) <= filter_bytes:
        got = counts.parts.select("slot", "bits").toArrow()
        shared = spark.sparkContext.broadcast((counts.frequent, dict(zip(got.column("slot").to_pylist(), got.column("bits").to_pylist(), strict=True))))
        found = keyed.mapInArrow(_score_here(shared, n_all, slots), schema(_FOUND))
    else:
        shared = spark.sparkContext.broadcast(counts.frequent)
        asked = keyed.mapInArrow(_ask(shared, n_all, slots), schema(_ASKED))
        filters = counts.parts.select("slot", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("row"), "bits")
        met = asked.unionByName(filters, allowMissingColumns=True).repartition(max(1, slots // 2), "slot").sortWithinPartitions("slot", "kind")
        found = met.mapInArrow(_answer, schema(_FOUND))
    found = save(found)
    packed = found.filter("kind = 3").select("row", "docs", "sums").repartition("row").sortWithinPartitions("row").mapInArrow(_unpacked, "row long, score double")
    # tokens that are not in the broadcast part get their counts by a join
    known = counts.tokens.filter(F.col("c") < counts.least)
    tail = found.filter("kind = 4").select("row", "token", "count", "minus", "times").join(known.hint("merge"), "token", "left").withColumn("p", (F.coalesce("c", F.lit(0)) + 1) / F.lit(n_all))
    tails = tail.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("times") * F.log10("p")).alias("base"),
        F.sum(F.col("times") * (F.log10(F.col("count") + K * F.col("p")) - F.col("minus"))).alias("score"),
    )
    every = found.filter("kind = 2").select("row", "id", "n_tokens", "n_known", "base", "score").unionByName(packed, allowMissingColumns=True).unionByName(tails, allowMissingColumns=True)
    total = every.groupBy("row").agg(F.max("id").alias("id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    return total.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.col("base").alias("base_score"), F.least("score", F.lit(0.0)).alias("score"))
