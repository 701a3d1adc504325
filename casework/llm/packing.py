"""Packing token sequences into windows: non-negative least squares over length combinations.

Every document becomes its ids and an end id. Whole windows are cut from its start; what is left
is a remainder shorter than the window. The histogram of remainder lengths (window - 1 numbers at
most, whatever the input) goes to the driver. There shallow combinations (one to three lengths)
that fill a window exactly, or a power of two, are enumerated; non-negative least squares solves
how often each should repeat to use up the histogram; the counts are rounded down to what is
there. What remains is packed greedily in blocks that repeat: the largest that fits, and where
nothing fits, the head of the largest one left closes the window (cut at a multiple of ``STEP``
ids; its tail is an item like any other). The plan is a list of runs "the pieces of documents
k0..k1 of length l sit at these offsets in sequences b.." whose size depends on the window alone.
It goes to the tasks; each document finds its place by its rank among those of its length. Ranks
come from counts by (length, slice of rows) and from the order inside one slice, so that a length
that a third of the rows share is not one task. The crc32 of a piece follows from those of the
beginnings of the remainder, which the tokenizing step leaves for every ``STEP`` ids.

Very long texts are encoded whole, one at a time. Null text: as empty (one end id). Repeated rows: each is packed. Null ids are kept.
Empty table: an empty result. Columns other than the id and the text are not read, so
that clashing names do no harm.
"""

from __future__ import annotations

import bisect
import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casework.llm.common import save

WINDOW = 1024
END_ID = 0
#: Rows of one slice, for ranks; ids of one slice that holds them.
SLICE_ROWS, SLICE_IDS = 2_000, 4_000_000
#: Combinations that the solver weighs, a number that depends on the window alone.
MAX_PATTERNS = 4_000
#: Ids between the places where a remainder may be cut; documents of a block that repeats.
STEP, BLOCK = 8, 1_024


class Encoder:
    """Ids as little-endian 32-bit numbers of the byte-level BPE vocabulary in a tokenizer's JSON file.

    The file's own library gives the same ids at a fifth of the speed; the merges run in tiktoken.
    As there, the string of an added token in a text becomes that token's id.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from public_tokenizers import PATTERN

        # the byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from 256
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        file = json.load(open(path, encoding="utf-8"))
        model = file["model"]
        added = {x["content"]: x["id"] for x in sorted(file.get("added_tokens", []), key=lambda x: -len(x["content"]))}
        ids = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte for c in t)}
        merged = {bytes(byte[c] for c in "".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]}
        ranks = {t: i for t, i in ids.items() if len(t) == 1 or t in merged}
        self._own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def __call__(self, text: str) -> bytes:
        return self._own.encode_to_numpy(text, allowed_special="all").tobytes()


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenize(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_ids: bool = True) -> DataFrame:
    """(id, n_tokens, crcs, heads, ids): the ids with the end id, as binary if kept, the crc32 of each piece of a window, and those of the beginnings of the last one, every STEP ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches):
        enc, end = encoder(vocabulary), np.array([END_ID], "<u4").tobytes()
        for b in batches:
            n, crcs, heads, kept = [], [], [], []
            for t in b.column("text").to_pylist():
                ids = enc(t or "") + end
                n.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[i : i + 4 * window]) for i in range(0, len(ids), 4 * window)])
                heads.append(beginnings(ids[len(ids) // (4 * window) * 4 * window :]))
                kept.append(ids if keep_ids else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(heads, pa.binary()), pa.array(kept, pa.binary())], ["id", "n_tokens", "crcs", "heads", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, f"id {kind}, n_tokens long, crcs array<long>, heads binary, ids binary")


def beginnings(ids: bytes) -> bytes:
    """crc32 of the first STEP, 2 STEP ... ids, as 32-bit numbers."""
    out, crc, size = [], 0, 4 * STEP
    for i in range(0, len(ids) - size, size):
        crc = zlib.crc32(ids[i : i + size], crc)
        out.append(crc)
    return np.array(out, "<u4").tobytes()


_ZEROS = bytes(4 * 65_536)


def crc_of_end(whole: int, beginning: int, n_bytes: int) -> int:
    """crc32 of the last n_bytes of a text, from that of the text and of what stands before them (crc32 is linear)."""
    zeros = _ZEROS[:n_bytes] if n_bytes <= len(_ZEROS) else bytes(n_bytes)
    return whole ^ ~zlib.crc32(zeros, ~beginning & 0xFFFFFFFF) & 0xFFFFFFFF


def patterns(lengths: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Combinations of one to three of the lengths, in descending order, whose sum is the window (or one length that is a power of two)."""
    there = set(lengths.tolist())
    out: list[tuple[int, ...]] = [(x,) for x in there if x & (x - 1) == 0]
    out += [(a, window - a) for a in there if 2 * a >= window and window - a in there]
    three = [(a, b, window - a - b) for a in there for b in there if a >= b >= window - a - b > 0 and window - a - b in there]
    if len(three) > MAX_PATTERNS:  # spread evenly over all of them; what is left out, the greedy step packs
        three = [three[i] for i in np.linspace(0, len(three) - 1, MAX_PATTERNS).astype(int)]
    return out + sorted(set(three), reverse=True)


def nnls(a: np.ndarray, h: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 with |a x - h| least, by accelerated projected gradients."""
    if not a.shape[1]:
        return np.zeros(0)
    step = 1 / max(1e-9, np.linalg.norm(a, 2) ** 2)
    x = y = np.full(a.shape[1], h.sum() / max(1.0, a.sum()))
    t = 1.0
    for _ in range(rounds):
        z = np.maximum(0, y - step * (a.T @ (a @ y - h)))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = z + (t - 1) / s * (z - x), z, s
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, int, int, list[tuple[int, int, int, int]]]], int]:
    """Runs (length, k0, k1, pieces), and the number of sequences; a piece is (first sequence, offset, start, size).

    Of the documents of rank k0 <= k < k1 among those of the length, the ids start..start + size sit
    at the offset of sequence first + k - k0. Every rank of every length is in exactly one run, and
    the pieces of a run hold all its ids.
    """
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    used = np.zeros_like(left)
    runs, sequences = [], 0

    def take(length: int, times: int) -> list[tuple[int, int, int, int]]:
        """A run of the next documents of the length, whose pieces are still to be given."""
        pieces: list[tuple[int, int, int, int]] = []
        runs.append((length, int(used[length]), int(used[length] + times), pieces))
        used[length] += times
        left[length] -= times
        return pieces

    lengths = np.flatnonzero(left)
    found = patterns(lengths, window)
    a = np.zeros((len(lengths), len(found)))
    row = {int(x): i for i, x in enumerate(lengths)}
    for j, p in enumerate(found):
        for x in p:
            a[row[x], j] += 1
    x = nnls(a, left[lengths].astype(float))
    for j in np.argsort(-x, kind="stable"):
        need: dict[int, int] = {}
        for v in found[j]:
            need[v] = need.get(v, 0) + 1
        times = min(int(np.floor(x[j] + 1e-6)), *(int(left[v] // k) for v, k in need.items()))
        if times > 0:
            offset = 0
            for v in found[j]:
                take(v, times).append((sequences, offset, 0, v))
                offset += v
            sequences += times
    while total := int(left.sum()):
        # a block of what remains, as often as it is there; a few of each length are left for the next, smaller one
        times = max(1, total // BLOCK)
        open_ = [(v, 0, take(v, times)) for v in np.flatnonzero(left >= times).tolist() for _ in range(int(left[v] // times))]
        sequences = _block(open_, times, sequences, window)
    return runs, sequences


def _block(open_: list[tuple[int, int, list]], times: int, sequences: int, window: int) -> int:
    """Packs items (size, start, pieces of their run), largest first, cutting one where nothing whole fits; returns the next sequence."""
    items = sorted(open_, key=lambda x: x[0])
    sizes = [x[0] for x in items]
    while items:
        room = window
        while room and items:
            at = bisect.bisect_right(sizes, room) - 1
            if at >= 0:
                size, start, pieces = items.pop(at)
                sizes.pop(at)
                pieces.append((sequences, window - room, start, size))
                room -= size
                continue
            head = room // STEP * STEP
            if not head:
                break
            size, start, pieces = items.pop()
            sizes.pop()
            pieces.append((sequences, window - room, start, head))
            rest = (size - head, start + head, pieces)
            at = bisect.bisect_left(sizes, rest[0])
            items.insert(at, rest)
            sizes.insert(at, rest[0])
            break
        sequences += times
    return sequences


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_ids: bool = True) -> DataFrame:
    """One row a piece: id, start, length, crc32, n_tokens, sequence_id, offset, ids (binary, null unless kept).

    Sequences hold at most ``window`` ids; offsets in a sequence have no gaps.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    tokens = save(tokenize(docs, vocabulary, id_col, text_col, window, keep_ids).withColumn("row", F.monotonically_increasing_id()))
    n_rows, n_ids = tokens.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    n_slices = max(1, n_rows // SLICE_ROWS, n_ids // SLICE_IDS if keep_ids else 0)
    rows = tokens.withColumn("slice", F.col("row") % n_slices)
    # how many of each remainder, and of whole windows (as length `window`), stand before each slice
    counted = rows.groupBy("slice", (F.col("n_tokens") % window).alias("length")).agg(F.count("*").alias("n"), F.sum(F.floor(F.col("n_tokens") / window)).alias("n_full"))
    whole = counted.groupBy("slice").agg(F.sum("n_full").alias("n")).select("slice", F.lit(window).cast("long").alias("length"), "n")
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = save(counted.select("slice", "length", "n").filter("length > 0").union(whole).select("slice", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    histogram = {int(r.length): int(r.n) for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    runs, n_sequences = plan({k: v for k, v in histogram.items() if k < window}, window)
    schema = f"{id_col} {kind}, start long, length long, crc32 long, n_tokens long, sequence_id long, offset long, ids binary"
    by_slice = rows.groupBy("slice").cogroup(starts.select("slice", "length", "before").groupBy("slice"))
    return by_slice.applyInPandas(_place(sorted(runs, key=lambda r: r[:2]), n_sequences, window, schema.split()[0]), schema)


def _place(planned: list, n_sequences: int, window: int, id_col: str):
    """Pieces of one slice of documents, given how many of each length stand before it."""
    runs = np.array([r[:2] for r in planned], np.int64).reshape(-1, 2)
    n_pieces = np.array([len(r[3]) for r in planned], np.int64)
    first_piece = np.cumsum(n_pieces) - n_pieces
    parts = np.array([p for r in planned for p in r[3]], np.int64).reshape(-1, 4)

    def place(docs, starts):
        docs = docs.sort_values("row", ignore_index=True)
        n = docs.n_tokens.to_numpy(np.int64)
        full, length = n // window, n % window
        begin = np.zeros(window + 1, np.int64)
        begin[starts.length.to_numpy(np.int64)] = starts.before
        # the rank of each document among those of its length
        order = np.argsort(length, kind="stable")
        first = np.searchsorted(length[order], length[order], "left")
        k = np.empty(len(n), np.int64)
        k[order] = np.arange(len(n)) - first
        k += begin[length]
        # the run that holds the rank: the last that starts at or before it
        key = lambda of, at: of.astype(np.int64) * (1 << 48) + at
        run = np.maximum(0, np.searchsorted(key(runs[:, 0], runs[:, 1]), key(length, k), "right") - 1)
        full_at = n_sequences + begin[window] + np.cumsum(full) - full
        cut = np.where(length > 0, n_pieces[run] if len(runs) else 0, 0)
        pieces = full + cut
        of = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        whole = piece < full[of]
        part = parts[np.where(whole, 0, (first_piece[run[of]] if len(runs) else 0) + piece - full[of])] if len(parts) else np.zeros((len(of), 4), np.int64)
        start = np.where(whole, piece * window, full[of] * window + part[:, 2])
        size = np.where(whole, window, part[:, 3])

        def crc(i: int) -> int:
            crcs, p = docs.crcs[of[i]], piece[i]
            if whole[i]:
                return int(crcs[p])
            heads, (_, _, s, m) = np.frombuffer(docs.heads[of[i]], "<u4"), part[i]
            e, rest = s + m, length[of[i]]
            end = int(crcs[full[of[i]]]) if e == rest else int(heads[e // STEP - 1])
            return crc_of_end(end, int(heads[s // STEP - 1]), int(4 * m)) if s else end

        out = docs[["id", "n_tokens"]].iloc[of].rename(columns={"id": id_col}).assign(
            start=start,
            length=size,
            crc32=[crc(i) for i in range(len(of))],
            sequence_id=np.where(whole, full_at[of] + piece, part[:, 0] + k[of] - (runs[run[of], 1] if len(runs) else 0)),
            offset=np.where(whole, 0, part[:, 1]),
            ids=[None if docs.ids[d] is None else bytes(docs.ids[d])[4 * s : 4 * (s + m)] for d, s, m in zip(of, start, size, strict=True)],
        )
        return out[[id_col, "start", "length", "crc32", "n_tokens", "sequence_id", "offset", "ids"]]

    return place
