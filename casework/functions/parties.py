"""Who pays, who receives, which program, how sure: Column functions over sentences that tell of money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casework.functions.matching import found, has
from casework.operators.ranking import case_of

# Noun phrases, verbs between parties, gates, programs.
PHRASE = r"[A-Z][A-Za-z]+(?:\s+(?:of|the|and|for|&)?\s*[A-Z][A-Za-z]+){0,5}"
LONG_PHRASE = r"[A-Z][A-Za-z]+(?:\s+(?:of|the|and|for|&)?\s*[A-Z][A-Za-z]+){1,5}"
CONTROL = r"\b(?:controlled?\s+by|overseen?\s+by|managed?\s+by|administered?\s+by|directed?\s+by|authorized?\s+by|approved?\s+by|led?\s+by|operated?\s+by)\b"
RECEIVE = r"\b(?:received?\s+by|awarded?\s+to|paid?\s+to|granted?\s+to|contracted?\s+(?:to|with)|given\s+to|allocated?\s+to|disbursed?\s+to|transferred?\s+to|issued?\s+to|directed?\s+to|funneled?\s+to|channeled?\s+to)\b"
RECIPIENT = r"\b(?:awarded?|issued?|granted?|contracted?|paid?|disbursed?|Awarded?|Issued?|Granted?|Contracted?|Paid?|Disbursed?)\b[^!?\n]{0,120}\bto\s+"
AWARD = r"\b(?:awarded?|allocated?|appropriated?|granted?|contracted?|disbursed?|transferred?|paid?|approved?|authorized?|procured?)\b"
MONEY_SIGN = r"\$[\d,.]+"
PROGRAM = r"\b(?:the\s+)?([A-Z][A-Za-z\s]{3,40}(?:Program|Project|Initiative|Fund|Act|Grant))\b"
PROGRAM_WORD = r"\b(?:program|project|initiative|fund|grant|contract|appropriation)\b"
EXPLICIT = r"\b(?:awarded|appropriated|contracted|disbursed|allocated|reimburse[d]?|procured|sole[\s-]source[d]?|no[\s-]bid|grant(?:ed)?)\b"
FLOW = r"\b(?:received|obtained|secured|paid(?:\s+out)?|funneled|channeled|transferred|redirected)\b"
GENERIC = r"\b(?:funded?|invested?|subsidized?|financed?)\b"
HEAD_WORDS = "in on at by from with during after before through under over into for of a an the this that these those its january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split()
BANNED = [
    "the office", "the program", "the agency", "the department", "the authority", "this office", "this program", "this department", "this agency",
    "the city", "the county", "the state", "the federal", "the administration", "the contractor", "the vendor", "the recipient", "the grantee", "the auditor",
]
ALIASES = {
    "metropolitan transportation authority": "MTA",
    "los angeles metropolitan transportation authority": "MTA",
    "la metro": "MTA",
    "office of inspector general": "Office of Inspector General",
    "oig": "Office of Inspector General",
    "inspector general": "Office of Inspector General",
    "department of transportation": "Department of Transportation",
    "u.s. department of transportation": "Department of Transportation",
    "los angeles county": "LA County",
    "county of los angeles": "LA County",
    "city of los angeles": "City of Los Angeles",
    "la county": "LA County",
    "hud": "HUD",
    "department of housing and urban development": "HUD",
    "u.s. department of housing and urban development": "HUD",
    "apex construction group, inc.": "Apex Construction Group",
    "apex construction group inc": "Apex Construction Group",
    "ridgeline systems inc": "Ridgeline Systems Inc",
    "ridgeline systems, inc.": "Ridgeline Systems Inc",
}
TYPE_POINTS = {"FRAUD_MISUSE": 0.12, "CONTRACT": 0.10, "APPROPRIATION": 0.10, "GRANT": 0.05, "CUT_REALLOCATION": 0.05}


def is_party(c: Column) -> Column:
    """Whether a phrase can name a party: no stock phrase, no month or small word at its head, a capital, no short single word."""
    low = F.lower(F.trim(c))
    named = (F.length(F.trim(c)) >= 3) & ~low.isin(*BANNED) & ~F.substring_index(low, " ", 1).isin(*HEAD_WORDS) & (c != F.lower(c))
    return F.coalesce(named & ~(c.rlike("^[A-Z][a-z]+$") & (F.length(c) < 6)), F.lit(False))


def canonical(c: Column) -> Column:
    """The usual name behind an alias, else the name, trimmed."""
    names = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(names[F.regexp_replace(F.lower(F.trim(c)), r"\.$", "")], F.trim(c))


def _once(c: Column, f) -> Column:
    """f of a column that is computed once, however often f names it."""
    return F.transform(F.array(c), f)[0]


def _party(c: Column) -> Column:
    return _once(c, lambda x: F.when(is_party(x), canonical(x)))


def after(sentence: Column, verb: str) -> Column:
    """The first phrase behind the first of these verbs, if it can name a party."""
    rest = F.regexp_extract(sentence, rf"(?s)^.*?(?i:{verb})(.*)$", 1)
    return F.when(has(found(sentence, [f"(?i){verb}"]), 0), _party(F.regexp_extract(rest, rf"\b({PHRASE})\b", 1)))


def subject(sentence: Column) -> Column:
    """The longest phrase before the first amount or award verb that can name a party, the earlier of equal ones."""
    before = F.regexp_extract(sentence, rf"(?s)^(.+?)(?:{MONEY_SIGN}|(?i:{AWARD}))", 1)
    starts = sentence.rlike(rf"(?s)^(?:{MONEY_SIGN}|(?i:{AWARD}))")
    phrases = F.filter(F.regexp_extract_all(before, F.lit(rf"\b({PHRASE})\b"), F.lit(1)), is_party)
    best = F.array_min(F.transform(phrases, lambda x, i: F.struct((-F.length(x)).alias("size"), i.alias("at"), x.alias("name"))))
    return F.when(~starts, _once(best["name"], canonical))


def controller(sentence: Column) -> Column:
    return F.coalesce(after(sentence, CONTROL), subject(sentence))


def receiver(sentence: Column) -> Column:
    """The party behind a verb of receiving, else the phrase after "verb ... to"."""
    return F.coalesce(after(sentence, RECEIVE), _party(F.regexp_extract(sentence, rf"{RECIPIENT}({PHRASE})\b", 1)))


def program(sentence: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(sentence, PROGRAM, 1)), F.lit(""))


def first_party(sentence: Column) -> Column:
    """The first phrase of two words or more that can name a party."""
    phrases = F.filter(F.regexp_extract_all(sentence, F.lit(rf"\b({LONG_PHRASE})\b"), F.lit(1)), is_party)
    return _once(F.try_element_at(phrases, F.lit(1)), canonical)


def entity(sentence: Column, controlled_by: Column, received_by: Column) -> Column:
    return F.coalesce(controlled_by, received_by, first_party(sentence))


def anchor_hits(sentence: Column, words: Column) -> Column:
    return F.size(F.filter(words, lambda w: F.contains(F.lower(sentence), w)))


def confidence(sentence: Column, signal_type: Column, named: Column, gate: str, words: Column | None = None) -> Column:
    """0 to 1 from gates, parties, type, program and, where the case has anchor words, their hits."""
    low = F.lower(sentence)
    f = found(low, [CONTROL, RECEIVE, gate, EXPLICIT, FLOW, GENERIC, PROGRAM_WORD])
    control, receive = has(f, 0), has(f, 1)
    points = F.when(has(f, 2), 0.20).otherwise(0.0) + case_of(0.0, (has(f, 3), 0.25), (has(f, 4), 0.15), (has(f, 5), 0.08)) + F.when(named.isNotNull(), 0.12).otherwise(0.0)
    points = points + case_of(0.0, (control & receive, 0.12), (control | receive, 0.07)) + case_of(0.0, *[(signal_type == t, x) for t, x in TYPE_POINTS.items()]) + F.when(has(f, 6), 0.05).otherwise(0.0)
    if words is not None:
        hits = anchor_hits(sentence, words)
        points = points + F.when(F.size(words) > 0, case_of(-0.05, (hits >= 3, 0.15), (hits == 2, 0.10), (hits == 1, 0.05))).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(points, 2)))


def display(raw: Column, amount: Column) -> Column:
    """An amount as it is shown: sign, number and one letter of scale, else digits in groups."""
    sign = case_of("$", (raw.rlike("(?i)£|GBP"), "£"), (raw.rlike("(?i)€|EUR"), "€"))
    scale = F.lower(F.regexp_extract(raw, r"(?i)(billion|million|thousand|trillion|bn|mn|tr|[bmkt])(?:\s*(?:USD|US dollars?|dollars?))?$", 1))
    letter = case_of("", (scale.isin("billion", "bn", "b"), "B"), (scale.isin("million", "mn", "m"), "M"), (scale.isin("thousand", "k", "t"), "K"), (scale.isin("trillion", "tr"), "T"))
    number = F.regexp_replace(F.regexp_replace(F.regexp_extract(raw, r"\d[\d,]*(?:\.\d+)?", 0), ",", ""), r"(\.\d*?)0+$", "$1")
    grouped = F.regexp_replace(F.format_number(amount, 2), r"\.?0+$", "")
    return F.when(letter != "", F.concat(sign, F.regexp_replace(number, r"\.$", ""), letter)).otherwise(F.concat(sign, F.when(amount == F.floor(amount), F.format_number(amount, 0)).otherwise(grouped)))
