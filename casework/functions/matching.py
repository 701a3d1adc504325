"""Which of many patterns a text has: one reading a text in Arrow batches, in place of a regular expression of the JVM for each.

The patterns are those of RE2, as in DuckDB: ``\\b``, ``\\s``, ``\\d`` and ``\\w`` are ASCII. A pattern
that looks ahead is tried without that first, then by Python's ``re`` on the few texts that are left.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_AHEAD = re.compile(r"\(\?![^()]*\)")
#: Patterns of one mask, a bit each.
MOST = 62


def masks(texts: pa.Array, patterns: Sequence[str]) -> pa.Array:
    """For each text the sum of 1 << i of the patterns i that it has; each different text is read once."""
    known = texts.dictionary_encode()
    different = known.dictionary
    out = pa.array([0] * len(different), pa.int64())
    for i, p in enumerate(patterns):
        hit = pc.match_substring_regex(different, pattern=_AHEAD.sub("", p))
        if _AHEAD.search(p):
            full = re.compile(p, re.ASCII)
            hit = pa.array([h and full.search(t) is not None for h, t in zip(hit.to_pylist(), different.to_pylist(), strict=True)], pa.bool_())
        out = pc.bit_wise_or(out, pc.multiply(hit.cast(pa.int64()), pa.scalar(1 << i, pa.int64())))
    return out.take(known.indices)


def found(c: Column, patterns: Sequence[str]) -> Column:
    """The mask of the patterns that a text has, null for null; see ``has``."""
    patterns = list(patterns)
    if len(patterns) > MOST:
        raise ValueError(f"at most {MOST} patterns")

    def find(texts: pa.Array) -> pa.Array:
        return masks(texts, patterns)

    return F.arrow_udf(find, "long")(c)


def has(mask: Column, i: int) -> Column:
    """Whether a mask has the pattern i."""
    return mask.bitwiseAND(F.lit(1 << i).cast("long")) != 0


def has_some(mask: Column, *at: int) -> Column:
    """Whether a mask has any of these patterns; of all, without them."""
    return (mask.bitwiseAND(F.lit(sum(1 << i for i in at)).cast("long")) if at else mask) != 0
