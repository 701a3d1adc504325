"""Personal data: anchors found by one Aho-Corasick pass, expanded by local parsers.

An automaton finds at-signs, plus signs, digits, URL schemes, identifier cues and street words in
one pass over the whole text. At each anchor a small deterministic parser expands to the left and
right, checks the found boundary (labels, octets, Luhn, digit counts) and gives a span. For the
four base kinds the expansion gives exactly the leftmost non-overlapping matches of

    email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip    [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)      every part at most 255
    card  [0-9]([\\x20-]?[0-9])+                       14 to 19 digits that pass Luhn
    phone \\+[0-9][\\x20().0-9-]+[0-9]                  10 to 15 digits

without those that fail the check. The method adds the kinds url, account and address.

Cues of accounts and secrets are found in any case, in a lower-cased copy of the same length. The
value after a cue runs to its own boundary, however long:

    IBAN in groups of four that passes mod 97, the longest such run, after any cue
    a value in quotes, or up to a space or quote, after ':' or '=' and a cue of SECRETS
    [A-Za-z0-9][A-Za-z0-9_-]{5,} with at least 4 digits, after any cue

Null text: as empty. Empty text: no spans. Rows of one id: one result each. Empty table: empty.
Columns other than the id and the text are not read, so that clashing names do no harm.
No shuffle: one map over the rows, memory bounded by a batch.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "address")

# Cue words.
CUES = ("account", "acct", "iban", "token", "password", "passwd", "secret", "api_key", "apikey", "api key", "ssn", "passport", "routing", "customer id", "user id")
#: Cues whose values need no digits where ':' or '=' says that a value follows.
SECRETS = frozenset(("token", "password", "passwd", "secret", "api_key", "apikey", "api key"))
STREETS = ("Street", "Avenue", "Road", "Lane", "Boulevard", "Drive", "Square", "Court")

SPANS = "array<struct<kind:string,start:int,end:int>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LABELS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"']+")
_LEAD = re.compile(r"(?:[ _]?(?:number|no\.?|nr\.?|id|key)(?![A-Za-z]))?[\"']?\s{0,3}([:=#]{0,2})\s{0,3}[\"']?", re.IGNORECASE)
_ACCOUNT = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{5,}")
_SECRET = re.compile(r"[^\s\"'<>]+")
_IBAN = re.compile(r"([A-Z]{2}[0-9]{2}(?:[ \u00a0-]?[A-Z0-9]{4}){2,7})([ \u00a0-]?[A-Z0-9]{1,3})?", re.IGNORECASE)
_HOUSE = re.compile(r"[0-9]{1,5}(?: [A-Z][A-Za-z'-]*){0,4} \Z")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def same_length_lower(text: str) -> str:
    """The text in lower case, character by character (only one character has a longer lower case)."""
    return text.replace("\u0130", "I").lower()


def iban_end(text: str, at: int) -> int:
    """The end of the longest run of groups of four (the last may be shorter) at a place that is an IBAN by mod 97, or 0."""
    m = _IBAN.match(text, at)
    if not m:
        return 0
    ends = [m.end(), m.end(1)]
    while ends[-1] - at > 12:
        ends.append(ends[-1] - 4 - (text[ends[-1] - 5] in " \u00a0-"))
    for end in ends:
        code = re.sub("[ \u00a0-]", "", text[at:end])
        whole = not text[end : end + 1].isalnum() and code in (code.upper(), code.lower())
        if whole and 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return end
    return 0


def value_span(text: str, last: int, secret: bool, poor: int) -> tuple[int, int, int]:
    """(start, end, poor) of the value after a cue that ends at last; an empty span if none. Values before poor have too few digits."""
    lead = _LEAD.match(text, last + 1)
    start = lead.end()
    if start == last + 1:
        return 0, 0, poor
    if end := iban_end(text, start):
        return start, end, poor
    if secret and lead[1]:
        quote = text[start - 1]
        if quote in "\"'":
            end = text.find(quote, start)
            if 0 <= text.find("\n", start, end) or end < 0:
                end = start
        if quote not in "\"'" or end == start:
            end = start + len(m[0].rstrip(".,;:!?)]}")) if (m := _SECRET.match(text, start)) else start
        if end - start >= 6:
            return start, end, poor
    if start >= poor and (m := _ACCOUNT.match(text, start)):
        if sum(map(m[0].count, "0123456789")) >= 4:
            return start, m.end(), poor
        poor = m.end()
    return 0, 0, poor


@functools.lru_cache(1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for what, words in (("@", "@"), ("+", "+"), ("d", "0123456789"), ("url", ["://"]), ("street", map(str.lower, STREETS))):
        for w in words:
            found.add_word(w, (what, len(w)))
    for cue in CUES:
        found.add_word(cue, ("secret" if cue in SECRETS else "cue", len(cue)))
    found.make_automaton()
    return found


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans of one text, by start, then by the order of KINDS."""
    out: list[tuple[int, int, int]] = []
    ends = {"email": 0, "ip": 0, "card": 0, "account": 0, "poor": 0, "url": 0}
    for last, (what, size) in automaton().iter(same_length_lower(text)):
        at = last - size + 1
        if what == "d":
            if at >= ends["ip"]:
                m = _LABELS.match(text, at)
                ends["ip"] = m.end()
                labels = m[0].split(".")
                start = at
                for k in range(0, len(labels) - 3, 4):
                    four = labels[k : k + 4]
                    end = start + sum(map(len, four)) + 3
                    if all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in four):
                        out.append((start, 1, end))
                    start = end + 1
            if at >= ends["card"]:
                m = _CARD.match(text, at)
                ends["card"] = m.end()
                if m.end() - at >= 14:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, 2, m.end()))
        elif what == "@":
            start = at
            while start > ends["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                ends["email"] = m.end()
                out.append((start, 0, m.end()))
        elif what == "+":
            if m := _PHONE.match(text, at):
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((at, 3, m.end()))
        elif what == "url":
            start = at
            while start > ends["url"] and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            if start < at and (m := _URL.match(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?)]}"))
                if end > last + 1:
                    ends["url"] = end
                    out.append((start, 4, end))
        elif what in ("cue", "secret"):
            if at >= ends["account"] and not (at and text[at - 1].isalnum()):
                start, end, ends["poor"] = value_span(text, last, what == "secret", ends["poor"])
                if end:
                    ends["account"] = end
                    out.append((start, 5, end))
        elif text[at : last + 1] in STREETS and not text[last + 1 : last + 2].isalpha() and (m := _HOUSE.search(text, max(0, at - 100), at)):
            out.append((m.start(), 6, last + 1))
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span as [KIND]; of spans that overlap, the one that starts first (then the longest) names it."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _spans(batches):
    for b in batches:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t or "")] for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, _SPAN_TYPE)], ["id", "spans"])


def _redacted(batches):
    for b in batches:
        texts = [t if t is None else redact_text(t, find(t)) for t in b.column("text").to_pylist()]
        i = b.schema.get_field_index("text")
        yield b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): all spans of each whole text, code-point offsets, ends exclusive, in order."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_spans, f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; all columns and rows stay."""
    plain = docs.select(*[F.col(c).alias("text" if c == text_col else f"_{i}") for i, c in enumerate(docs.columns)])
    return plain.mapInArrow(_redacted, plain.schema).toDF(*docs.columns)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
