"""Token counts by the whole-token shortcut, for a piece model with byte fallback.

Pairs of neighbouring characters that stand together in no piece of the vocabulary are never
merged, so a text falls into pre-tokens that don't touch each other: each begins with its run of
spaces and ends before the next space or before a lone character (one that is part of no longer
piece, such as a line feed). ``prove`` shows this once on the driver, from the vocabulary alone,
and encodes every pre-token-shaped piece by itself to find those that give one token. In the tasks
a text's pre-tokens are counted; those proved whole count one each, and only the different others
go to the library's merges, whose counts of short ones a worker keeps (``KEPT`` at most, then it
starts anew). Texts are read in slices that end before a space, so that a very long text is never
one list; one very long word goes to the library whole.

Where the vocabulary doesn't allow the proof (a model that rewrites its input, or a piece with a
space inside), texts go to the library whole: the same counts, more slowly.

Null text: empty, no tokens. Special strings in a text are ordinary text, as is the library's
default. Repeated rows and null ids: each row is counted. Empty table: empty. Only the id and the
text are read, so that clashing names do no harm.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Characters of a slice, least; pre-tokens whose counts a worker keeps, and the longest of these.
SLICE, KEPT, SHORT = 1 << 18, 400_000, 64


@dataclass(frozen=True)
class Proof:
    """What holds of a model whatever the text: strings that are one token alone, and the lone characters."""

    model: bytes
    whole: frozenset[str]
    lone: str
    safe: bool


@functools.lru_cache(2)
def _library(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def prove(path: str) -> Proof:
    """Reads the model's file and proves where its texts may be cut and which strings are one token."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        model = f.read()
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(model)
    kinds = type(spec.pieces[0]) if spec.pieces else None
    normal = [p.piece for p in spec.pieces if p.type == kinds.NORMAL]
    rules = spec.normalizer_spec
    safe = (
        spec.trainer_spec.model_type == spec.trainer_spec.BPE
        and not rules.precompiled_charsmap
        and rules.add_dummy_prefix
        and rules.escape_whitespaces
        and not rules.remove_extra_whitespaces
        and not spec.trainer_spec.treat_whitespace_as_suffix
        and all(p.type != kinds.USER_DEFINED and p.type != kinds.UNUSED for p in spec.pieces)
        and not any(SPACE in p.lstrip(SPACE) for p in normal)
    )
    if not safe:
        return Proof(model, frozenset(), "", False)
    inner = {c for p in normal if len(p) > 1 for c in p}
    lone = "".join(c for c in map(chr, range(256)) if c not in inner and c not in (" ", SPACE))
    if not lone:
        return Proof(model, frozenset(), "", False)
    shaped = [p for p in normal if not set(p) & set(lone)]
    whole = {p for p, n in zip(shaped, merged(_library(model), shaped, lone), strict=True) if n == 1}
    return Proof(model, frozenset(whole), lone, True)


def merged(library, pre_tokens: list[str], lone: str) -> list[int]:
    """The library's count for each; a lone character before it holds off the space that the library sets before every text."""
    mark = "\n" if "\n" in lone else lone[0]
    before = len(library.encode(mark))  # num_threads=1: else each call starts threads of its own
    return [len(ids) - before for ids in library.encode([mark + p for p in pre_tokens], num_threads=1)]


def slices(text: str, size: int = SLICE):
    """The text in parts that begin with a space (but for the first) and don't end with one."""
    start, n = 0, len(text)
    while n - start > size:
        end = start + size
        while end > start and text[end - 1] in (" ", SPACE):  # not inside a run of spaces
            end -= 1
        at = max(text.rfind(" ", start, end), text.rfind(SPACE, start, end))
        while at > start and text[at - 1] in (" ", SPACE):
            at -= 1
        if at <= start:  # one long word: up to the space after it
            word = re.compile(f"[ {SPACE}]*[^ {SPACE}]+").match(text, start)
            at = word.end() if word else n
        if at >= n:
            break
        yield text[start:at]
        start = at
    yield text[start:]


class Counting:
    """Counts tokens in a worker."""

    def __init__(self, proof: Proof):
        self.proof, self.library, self.known = proof, _library(proof.model), {}
        lone = re.escape(proof.lone)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+|[{lone}]") if proof.safe else None

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if not self.proof.safe:
            return len(self.library.encode(text))
        total, first = 0, True
        for part in slices(text):
            part = part.replace(" ", SPACE)
            pre = Counter(self.cut.findall(SPACE + part if first else part))
            first = False
            rest = []
            for p, n in pre.items():
                if p in self.proof.whole:
                    total += n
                elif (k := self.known.get(p)) is not None:
                    total += n * k
                else:
                    rest.append(p)
            if rest:
                if len(self.known) > KEPT:
                    self.known.clear()
                for p, k in zip(rest, merged(self.library, rest, self.proof.lone), strict=True):
                    total += pre[p] * k
                    if len(p) <= SHORT:
                        self.known[p] = k
        return total


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of each row, by the model in this file."""
    proof = docs.sparkSession.sparkContext.broadcast(prove(model))  # as large as the vocabulary
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counting = Counting(proof.value)
        for b in batches:
            n_bytes, n_tokens = [], []
            for t in b.column("text"):  # one text at a time
                t = t.as_py() or ""
                n_bytes.append(len(t) if t.isascii() else len(t.encode()))
                n_tokens.append(counting(t))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
