"""Spelling variants: a trie over letter-group counts, searched with a surplus and a deficit of one each.

``word_counts`` gives the distinct words of all texts and how often each occurs: tasks sum what
they meet before anything moves. ``variants`` finds all pairs of words that differ by exactly one
inserted, deleted or replaced letter. Such an edit raises the count of one group of letters by one
at most, and lowers one by one at most. The trie arranges the words by the counts of successive
groups (``COARSE``, then ``FINE``). Its top is cut where a branch holds few enough words
(``BRANCH_ROWS``, or the ``MOST_BRANCHES``-th part of all words, if that is more), so that each
branch is a task of bounded size: a word stays in its own branch and visits, of the others that
the same search reaches within its budget, those that come later. A branch that many guests visit
is worked off in several blocks. In a task the trie goes on below the branch; the depth-first
search carries the words still alive, with what they have spent, and the words at its leaves are
verified letter by letter. Only sums for each word leave a task, never its pairs.

A word's form is its most frequent near word, if that occurs ``ratio`` times as often at least;
``root`` follows forms to the last, by doubling steps.

Null text: no words. Null id: as an empty one. Repeated rows count again. Ties of the form: the
smaller word by code points. Very long texts are read run by run, very long words compared one by
one. Empty table: empty. Only the id and the text (the word and its count) are read, so that
clashing names do no harm. What reaches the driver are the branches, whose number depends on the
parameters alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.llm.common import drop, look_up, save

#: Letters whose counts make up the levels of the trie; letters that are named nowhere are in the last group of each.
COARSE = ["eoumw", "nisdp", "tacgv"]
FINE = ["e", "n", "t", "a", "i", "o", "r", "h", "u", "s", "c", "l", "d", "gb", "fmw", "zyx", "pqv"]
LEVELS = len(COARSE) + len(FINE) + 2
BRANCH_ROWS, MOST_BRANCHES = 16_384, 50_000
#: Words that a task counts before it hands them on; characters of a text that are read at once.
HELD, AT_ONCE = 400_000, 1 << 20
#: Words of a trie's leaf; pairs that are compared at once; letters of words compared as arrays.
LEAF, PAIRS, SHORT = 8, 1 << 17, 40

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = 0, least_length: int = 1, least_count: int = 1) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case.

    With ``damage``, a run loses a letter where the crc32 h of "<id>:<run>" is divisible by it: the
    one at h modulo the length. So a known share of the words is misspelt.
    """

    def run(batches):
        held: Counter[str] = Counter()
        for b in batches:
            for k, t in zip(b.column("id").to_pylist(), b.column("text")):
                t = t.as_py() or ""
                own = Counter(_RUN.findall(t)) if len(t) <= AT_ONCE else Counter(m[0] for m in _RUN.finditer(t))
                before = zlib.crc32(f"{'' if k is None else k}:".encode())
                for w, n in own.items():
                    w = w.lower() if w.isascii() else w.translate(_LOWER)
                    if damage and not (h := zlib.crc32(w.encode(), before)) % damage:
                        w = w[: h % len(w)] + w[h % len(w) + 1 :]
                    if len(w) >= least_length:
                        held[w] += n
                if len(held) > HELD:
                    yield _counted(held)
                    held.clear()
        yield _counted(held)

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


def _groups(groups: list[str], first: int) -> np.ndarray:
    """The level of each Latin-1 letter; those in no group share the last level."""
    at = np.full(256, first + len(groups), np.int64)
    for i, g in enumerate(groups):
        at[list(g.encode("latin-1"))] = first + i
    return at


_AT = [_groups(COARSE, 0), _groups(FINE, len(COARSE) + 1)]
#: Levels of the coarse and of the fine groups: each set is a partition of the letters with a budget of its own.
_TOP = len(COARSE) + 1


def vectors(words: list[str]) -> np.ndarray:
    """A row of letter-group counts for each word; counts end at 255, which takes nothing from a difference of one below."""
    size = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    row = np.repeat(np.arange(len(words)), size) * LEVELS
    n = sum(np.bincount(row + at[letters], minlength=len(words) * LEVELS) for at in _AT)
    return np.minimum(n.reshape(len(words), LEVELS), 255).astype(np.uint8)


class Branches:
    """The top of the trie: which prefixes are cut further, and the branches that are not, with their words."""

    def __init__(self, inner: set[bytes], size: dict[bytes, int], most_guests: int):
        self.inner, self.depth = inner, 1 + max(map(len, inner), default=-1)
        self.names = sorted(size)  # the order decides who visits whom
        self.number = {p: i for i, p in enumerate(self.names)}
        self.below = defaultdict(set)
        for p in self.names:
            for t in range(len(p)):
                self.below[p[:t]].add(p[t])
        guests: Counter[int] = Counter()
        self.known: dict[bytes, list[int]] = {}
        for p, n in size.items():
            for x in self._reached(p, len(p)):
                guests[x] += n
        self.blocks = np.array([max(1, -(-guests[i] // most_guests)) for i in range(len(self.names))], np.int64)

    def home(self, vector: bytes) -> bytes:
        t = 0
        while vector[:t] in self.inner:
            t += 1
        return vector[:t]

    def _reached(self, vector: bytes, known: int) -> list[int]:
        """Later branches within the budget; levels of the vector from ``known`` on are open."""
        own, out = self.number[self.home(vector)], []
        todo = [(b"", (0, 0), (0, 0))]
        while todo:
            p, coarse, fine = todo.pop()
            if p not in self.inner:
                if (i := self.number[p]) > own:
                    out.append(i)
                continue
            t = len(p)
            for c in self.below[p]:
                spent = coarse if t < _TOP else fine
                if t < known:
                    d = c - vector[t]
                    spent = (spent[0] + (d > 0), spent[1] + (d < 0))
                    if abs(d) > 1 or max(spent) > 1:
                        continue
                todo.append((p + bytes([c]), spent, fine) if t < _TOP else (p + bytes([c]), coarse, spent))
        return out

    def reached(self, vector: bytes) -> list[int]:
        vector = vector[: max(self.depth, 0)]
        found = self.known.get(vector)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[vector] = self._reached(vector, len(vector))
        return found


def near(a: str, b: str) -> bool:
    """Whether one letter inserted, deleted or replaced makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


class Words:
    """Words as arrays of letters from the left and from the right, to compare many pairs at once."""

    def __init__(self, words: list[str]):
        self.words = words
        self.size = np.array([len(w) for w in words], np.int64)
        self.left, self.right = np.zeros((len(words), SHORT), np.uint8), np.zeros((len(words), SHORT), np.uint8)
        for i, w in enumerate(words):
            if len(w) <= SHORT:
                x = np.frombuffer(w.encode("latin-1"), np.uint8)
                self.left[i, : len(x)], self.right[i, : len(x)] = x, x[::-1]

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.size[i], self.size[j]
        low = np.minimum(a, b)
        hit = np.abs(a - b) <= 1
        same = [np.where((d := x[i] != x[j]).any(1), d.argmax(1), SHORT) for x in (self.left, self.right)]
        hit &= np.where(a == b, same[0] + same[1] == low - 1, same[0] + same[1] >= low)
        for k in np.flatnonzero(np.maximum(a, b) > SHORT):
            hit[k] = near(self.words[i[k]], self.words[j[k]])
        return hit


def search(home: np.ndarray, asked: np.ndarray, n_own: int):
    """Pairs (row of home, row of asked) whose counts differ within the budget, as arrays, in parts.

    The first n_own rows of asked are the rows of home; of these each pair comes once.
    """
    order = np.lexsort(home.T[::-1])
    v, q = home[order].astype(np.int16), asked.astype(np.int16)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = np.full(len(q), -1, np.int64)
    place[:n_own] = rank[:n_own]  # own rows look only at rows after them
    none = np.zeros(len(q), np.int8)
    todo = [(0, len(v), 0, np.arange(len(q)), none, none)]
    while todo:
        lo, hi, t, at, up, down = todo.pop()
        if not len(at):
            continue
        if t == _TOP:  # the fine groups have a budget of their own
            up, down = np.zeros(len(at), np.int8), np.zeros(len(at), np.int8)
        if hi - lo <= LEAF or t == LEVELS:
            yield from _leaf(v, q, place, lo, hi, t, at, up, down, order)
            continue
        values, starts = np.unique(v[lo:hi, t], return_index=True)
        ends = np.append(starts[1:], hi - lo)
        mine = q[at, t]
        for c, s, e in zip(values, starts, ends):
            d = mine - c
            u, w = up + (d > 0), down + (d < 0)
            keep = np.flatnonzero((np.abs(d) <= 1) & (u <= 1) & (w <= 1) & (place[at] < lo + e - 1))
            if len(keep):
                todo.append((lo + s, lo + e, t + 1, at[keep], u[keep].astype(np.int8), w[keep].astype(np.int8)))


def _leaf(v, q, place, lo, hi, t, at, up, down, order):
    """Checks what is left of the vectors; a large leaf of one vector goes on as it is."""
    step = max(1, PAIRS // (hi - lo))
    for s in range(0, len(at), step):
        a, u, w = at[s : s + step], up[s : s + step, None], down[s : s + step, None]
        ok = place[a][:, None] < np.arange(lo, hi)[None, :]
        for cut in (slice(t, max(t, _TOP)), slice(max(t, _TOP), LEVELS)):
            if cut.stop > cut.start:
                d = q[a, cut][:, None, :] - v[None, lo:hi, cut]
                ok &= ((np.maximum(d, 0).sum(2) + u) <= 1) & ((np.maximum(-d, 0).sum(2) + w) <= 1)
                u = w = 0
        i, j = np.nonzero(ok)
        if len(i):
            yield order[lo + j], a[i]


def _task(g: pd.DataFrame) -> pd.DataFrame:
    """(word, n_near, best_n, best): of a branch's words and its guests, all near pairs that hold one of the branch's own."""
    own = g[g.home]
    guests = g[~g.home]
    first = bool(g.block.iloc[0] == 0)
    word, n = np.concatenate([own.word.to_numpy(object), guests.word.to_numpy(object)]), np.concatenate([own.n.to_numpy(), guests.n.to_numpy()])
    empty = pd.DataFrame({"word": pd.Series([], dtype=object), "n_near": pd.Series([], dtype="int64"), "best_n": pd.Series([], dtype="int64"), "best": pd.Series([], dtype=object)})
    if not len(own) or not len(word):
        return empty
    words, all_vectors = Words(list(word)), vectors(list(word))
    asked = np.arange(len(word)) if first else np.arange(len(own), len(word))  # pairs inside the branch once
    count, best = np.zeros(len(word), np.int64), np.full(len(word), -1, np.int64)
    for i, j in search(all_vectors[: len(own)], all_vectors[asked], len(own) if first else 0):
        j = asked[j]
        hit = words.near(i, j)
        for x, y in ((i[hit], j[hit]), (j[hit], i[hit])):
            np.add.at(count, x, 1)
            for a, b in zip(x, y):
                if (c := best[a]) < 0 or n[b] > n[c] or n[b] == n[c] and word[b] < word[c]:
                    best[a] = b
    some = np.flatnonzero(count)
    return pd.DataFrame({"word": word[some], "n_near": count[some], "best_n": n[best[some]], "best": word[best[some]]}) if len(some) else empty


def near_words(words: DataFrame, branch_rows: int = BRANCH_ROWS) -> DataFrame:
    """(word, n_near, best_n, best) of a written table of distinct (word, n), for words that have a near one."""
    total = words.count()
    limit = max(branch_rows, total // MOST_BRANCHES)

    def counted(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in vectors(b.column("word").to_pylist())], pa.binary())], ["v"])

    prefixes = words.select("word").mapInArrow(counted, "v binary").groupBy("v").count().select("count", F.explode(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda t: F.substring("v", F.lit(1), t))).alias("p"))
    inner = {bytes(r.p) for r in prefixes.groupBy("p").agg(F.sum("count").alias("n")).filter(F.col("n") > limit).collect()}
    plain = Branches(inner, {}, 1)

    def at_home(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([plain.home(v.tobytes()) for v in vectors(b.column("word").to_pylist())], pa.binary())], ["p"])

    size = {bytes(r.p): r["count"] for r in words.select("word").mapInArrow(at_home, "p binary").groupBy("p").count().collect()}
    shared = words.sparkSession.sparkContext.broadcast((inner, size, 4 * limit))

    def deal(batches):
        branches = Branches(*shared.value)
        for b in batches:
            word = b.column("word").to_pylist()
            at, branch, block, home = [], [], [], []
            for i, (w, v) in enumerate(zip(word, vectors(word), strict=True)):
                v = v.tobytes()
                own = branches.number[branches.home(v)]
                for k in range(branches.blocks[own]):
                    at.append(i), branch.append(own), block.append(k), home.append(True)
                salt = zlib.crc32(w.encode())
                for x in branches.reached(v):
                    at.append(i), branch.append(x), block.append(salt % int(branches.blocks[x])), home.append(False)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(branch, pa.int32()), pa.array(block, pa.int32()), pa.array(home, pa.bool_()), b.column("word").take(take), b.column("n").take(take)], ["branch", "block", "home", "word", "n"])

    dealt = words.select("word", "n").mapInArrow(deal, "branch int, block int, home boolean, word string, n long")
    found = dealt.groupBy("branch", "block").applyInPandas(_task, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), form not null and no word its own form in any number of steps: where forms end, by doubling."""
    now = save(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = save(look_up(now, on, ["root"]).select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop(now)
        now = after
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def variants(words: DataFrame, ratio: Column | float = 2, branch_rows: int = BRANCH_ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct (word, n); words of letters up to U+00FF."""
    words = save(words.select("word", "n"))
    found = words.join(near_words(words, branch_rows), "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = save(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    last = roots(found.filter("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
