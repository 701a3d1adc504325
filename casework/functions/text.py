"""Column functions over texts: markers, names, hosts, dates, amounts. No shuffles; of Python, Arrow batches for lists of patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.functions.matching import found, has

MARKERS = ("DIAG:[^\\]]*", "EXTRACTION_INCOMPLETE[^\\]]*", "EXTRACTION_FAILED[^\\]]*", "INVALID_CONTENT[^\\]]*", "WRAPPER_BLOCKED[^\\]]*", "FETCH_FAILED[^\\]]*")
MONTHS = "January February March April May June July August September October November December".split()
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " "}

# Event and signal types by the words of a sentence, the first that matches.
EVENT_WORDS = [
    (r"\b(?:launched?|opening|opened|created|founded|established|started|began|initiated)\b", "PROGRAM_LAUNCH"),
    (r"\b(?:contract\s+(?:awarded?|signed?|approved?|won)|awarded?\s+(?:a\s+)?contract)\b", "CONTRACT_AWARDED"),
    (r"\b(?:fund(?:ing|ed)\s+(?:approved?|granted?|allocated?|received?)|approved?\s+(?:funding|budget))\b", "FUNDING_APPROVED"),
    (r"\b(?:investigat(?:ed?|ing|ion)|probe(?:d|s)?|investigat(?:ing|ion)\s+(?:started?|opened?|launched?))\b", "INVESTIGATION_STARTED"),
    (r"\b(?:audit(?:ed?|ing|s)?|auditor(?:s)?|audit\s+(?:found?|showed?|revealed?))\b", "AUDIT"),
    (r"\b(?:lawsuit|litigation|sued?|complaint\s+filed?|legal\s+action|court\s+(?:ruling|order|decision))\b", "LEGAL_ACTION"),
    (r"\b(?:expand(?:ed?|ing|s)|expansion|program\s+expan(?:d|sion))\b", "PROGRAM_EXPANSION"),
    (r"\b(?:purchased?|acqui(?:red?|sition)|bought|property\s+(?:deal|sale|transaction))\b", "PROPERTY_ACQUISITION"),
    (r"\b(?:polic(?:y|ies)\s+(?:change|changed?|updated?|new|reform)|reform(?:ed?|s)?)\b", "POLICY_CHANGE"),
]
SIGNAL_WORDS = [
    (r"\b(?:fraud|embezzl|kickback|brib(?:e|ery)|misappropriat|stolen|diverted|siphoned|laundered|phantom|fictitious|overbill|ghost\s+employee)\b", "FRAUD_MISUSE"),
    (r"\b(?:change\s+order|cost\s+overrun|over.budget|cost.overage|budget\s+overrun|change\s+directive)\b", "COST_OVERRUN"),
    (r"\b(?:audit\s+finding|ig\s+report|oig|inspector\s+general|questioned\s+cost|disallow(?:ed?|ance)|unallowable|unsupported\s+cost|audit\s+exception)\b", "AUDIT_FLAG"),
    (r"\b(?:contract(?:ed?|s)?|sole.source|no.bid|procurement|awarded?\s+contract|rfp|rfq|task\s+order|indefinite\s+delivery|idiq)\b", "CONTRACT"),
    (r"\b(?:grant(?:ed?|s)?|subgrant|cooperative\s+agreement|assistance\s+agreement|subaward)\b", "GRANT"),
    (r"\b(?:appropriat(?:ed?|ion|ions)?|budget(?:ed?)?|allocated?|allocation|congressional|legislative|omnibus|continuing\s+resolution)\b", "APPROPRIATION"),
    (r"\b(?:cut|reduc(?:ed?|tion)|eliminated?|rescission|clawback|withh(?:eld?|olding)|frozen|freeze|pulled|recission|sequester)\b", "CUT_REALLOCATION"),
    (r"\b(?:paid?|payment(?:s)?|pay(?:ing|s)?|reimburse|disburs(?:ed?|ement)|expenditure|spent|expended|invoice|invoiced?|billable)\b", "EXPENDITURE"),
    (r"\b(?:fund(?:ed?|ing|s)?|financed?|award(?:ed?|s)?|invest(?:ed?|ment|ing)|subsidized?|capitalized?)\b", "PROGRAM_FUNDING"),
]
ACTION = r"\b(?:approved?|funded?|allocated?|appropriated?|awarded?|contracted?|charged?|investigated?|indicted?|announced?|launched?|signed?|enacted?|ordered?|expanded?|audited?|subpoenaed?|arrested?|convicted?|sentenced?|settled?|dismissed?|reformed?|initiated?|established?|created?|passed?|opened?|founded?|started?|began?|purchased?|acquired?|sued?)\b"
_NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
AMOUNT = rf"(?i)(?:USD|US\$|\$|£|€|GBP|EUR)\s*(?:{_NUMBER})(?:\s*(?:billion|million|thousand|trillion|bn|mn|tr|[bmkt])\b)?"
#: An amount without a sign needs a scale word.
UNSIGNED = rf"(?:{_NUMBER})\s*(?:billion|million|thousand|trillion|bn|mn|tr|[bmk])\b(?:\s*(?:USD|US dollars?|dollars?))?"
SCALES = {"billion": 1e9, "bn": 1e9, "b": 1e9, "million": 1e6, "mn": 1e6, "m": 1e6, "thousand": 1e3, "k": 1e3, "t": 1e3, "trillion": 1e12, "tr": 1e12}


def first_match(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    f, out = found(F.lower(c), [p for p, _ in rules]), F
    for i, (_, value) in enumerate(rules):
        out = out.when(has(f, i), value)
    return out.otherwise(default)


def event_type(c: Column) -> Column:
    return first_match(c, EVENT_WORDS, "EVENT")


def signal_type(c: Column) -> Column:
    return first_match(c, SIGNAL_WORDS, "FUNDING")


def strip_markers(c: Column) -> Column:
    """The text without its leading bracketed markers, each taken once in their order, trimmed."""
    for m in MARKERS:
        c = F.regexp_replace(c, rf"^\s*\[(?:[A-Z]+-)?{m}\]\s*", "")
    return F.trim(c)


def diag_map(c: Column) -> Column:
    """The k=v|k=v map of a leading [DIAG:...] marker; of a repeated key the last counts; null without a marker."""
    inner = F.regexp_extract(c, r"^\s*\[(?:[A-Z]+-)?DIAG:([^\]]*)\]", 1)
    pairs = F.filter(F.split(inner, r"\|"), lambda x: F.locate("=", x) > 1)
    keys = F.array_distinct(F.transform(pairs, lambda x: F.substring_index(x, "=", 1)))
    value = lambda k: F.element_at(F.transform(F.filter(pairs, lambda x: F.substring_index(x, "=", 1) == k), lambda x: F.regexp_replace(x, "^[^=]*=", "")), -1)
    return F.when(F.coalesce(inner, F.lit("")) != "", F.map_from_arrays(keys, F.transform(keys, value)))


def diag_value(c: Column, key: str) -> Column:
    """The value of one key of ``diag_map``, without the map."""
    inner = F.regexp_extract(c, r"^\s*\[(?:[A-Z]+-)?DIAG:([^\]]*)\]", 1)
    own = F.filter(F.split(inner, r"\|"), lambda x: F.startswith(x, F.lit(f"{key}=")))
    return F.substring(F.try_element_at(own, F.lit(-1)), len(key) + 2, 2**31 - 1)


def diag_fields(c: Column, numbers: tuple[str, ...] = ("score", "chars", "entities"), urls: tuple[str, ...] = ("url", "final_url"), names: tuple[str, ...] = ("status", "priority", "alignment")) -> Column:
    """The map's usual keys as a struct: numbers as integers, urls decoded, names as they are; null where absent."""
    m = diag_map(c)
    return F.struct(*[m[k].alias(k) for k in names], *[m[k].try_cast("int").alias(k) for k in numbers], *[F.try_url_decode(m[k]).alias(k) for k in urls])


def seed_map(c: Column) -> Column:
    """struct(fields, counts, reject_reasons, next_queries) of a [SEED:k=v|...] marker in a case's description; null without one.

    counts are the fields that are whole numbers; reject_reasons comes as R:n,R:n, next_queries
    with || between, both url-encoded.
    """
    inner = F.regexp_extract(c, r"\[(?:[A-Z]+-)?SEED:([^\]]+)\]", 1)
    pairs = F.filter(F.split(inner, r"\|"), lambda x: F.locate("=", x) > 1)
    keys = F.array_distinct(F.transform(pairs, lambda x: F.substring_index(x, "=", 1)))
    value = lambda k: F.element_at(F.transform(F.filter(pairs, lambda x: F.substring_index(x, "=", 1) == k), lambda x: F.regexp_replace(x, "^[^=]*=", "")), -1)
    fields = F.map_from_arrays(keys, F.transform(keys, value))
    decoded = lambda k: F.coalesce(F.try_url_decode(fields[k]), F.lit(""))
    reasons = F.filter(F.split(decoded("reject_reasons"), ","), lambda x: x.rlike(r"^.+:\d+$"))
    counted = F.map_from_entries(F.transform(reasons, lambda x: F.struct(F.regexp_replace(x, r":\d+$", ""), F.regexp_extract(x, r":(\d+)$", 1).cast("int"))))
    queries = F.filter(F.split(decoded("next_queries"), r"\|\|"), lambda x: x != "")
    numbers = F.map_filter(F.transform_values(fields, lambda k, v: v.try_cast("int")), lambda k, v: v.isNotNull())
    return F.when(inner != "", F.struct(fields.alias("fields"), numbers.alias("counts"), counted.alias("reject_reasons"), queries.alias("next_queries")))


def diag_encode(urls: tuple[str, ...] = (), **fields: Column) -> Column:
    """[DIAG:k=v|...] in the order given, without the keys whose value is null; those named in urls are url-encoded."""
    plain = lambda k, v: F.replace(F.url_encode(v.cast("string")), F.lit("+"), F.lit("%20")) if k in urls else v.cast("string")
    parts = [F.concat(F.lit(f"{k}="), plain(k, v)) for k, v in fields.items()]
    return F.concat(F.lit("[DIAG:"), F.concat_ws("|", *parts), F.lit("]"))


def mention_meta(c: Column) -> Column:
    """struct(role, topic, zone) of a [A:r=..|t=..|z=..] prefix, with defaults."""
    part = lambda k, default: F.coalesce(F.nullif(F.regexp_extract(c, rf"[:|]{k}=([^|\]]+)", 1), F.lit("")), F.lit(default))
    return F.struct(part("r", "UNKNOWN").alias("role"), part("t", "LOW").alias("topic"), part("z", "body").alias("zone"))


def plain_text(c: Column) -> Column:
    """Tags to spaces, the common character references decoded, other named ones to spaces, numeric ones dropped."""
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for k, v in ENTITIES.items():
        if k != "&amp;":
            c = F.replace(c, F.lit(k), F.lit(v))
    c = F.regexp_replace(c, r"&#x?[0-9a-fA-F]+;", "")
    c = F.regexp_replace(F.replace(c, F.lit("&amp;"), F.lit("\x01")), r"&[a-zA-Z]+;", " ")
    return F.trim(F.regexp_replace(F.replace(c, F.lit("\x01"), F.lit("&")), r"\s+", " "))


def host(c: Column) -> Column:
    """The host of a url without www., 'unknown' where there is none."""
    found = F.regexp_extract(F.lower(c), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.coalesce(F.nullif(F.regexp_replace(found, r"^www\.", ""), F.lit("")), F.lit("unknown"))


def clean_name(c: Column) -> Column:
    """A name without one leading preposition, then one article."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^(?:with|by|from|of|and|or|in|at|to|for|on)\s+", ""), r"(?i)^(?:the|an|a)\s+", ""))


def normalized_name(c: Column) -> Column:
    """A name as a key: no possessive, article or legal suffix, usual abbreviations in full, lower case."""
    c = F.trim(F.regexp_replace(F.trim(c), r"(?i)['’]s\s*$", ""))
    c = F.regexp_replace(c, r"(?i)^(?:The|A|An)\s+", "")
    for short, full in (("Dept", "Department"), ("Svcs", "Services"), ("Auth", "Authority"), ("Comm", "Commission"), ("Admin", "Administration")):
        c = F.regexp_replace(c, rf"(?i)\b{short}\b\.?", full)
    for suffix in (r"Inc\.?", r"LLC\.?", r"Corp\.?", r"Co\.?", r"Ltd\.?", r"L\.L\.C\.?", "Incorporated", "Corporation", "Limited"):
        c = F.regexp_replace(c, rf"(?i)\s*,?\s+{suffix}$", "")
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared words over the larger number of distinct words, of words of three letters or more."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 2))
    x, y = words(a), words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y)))


def sentences(df: DataFrame, text: str, least: int = 20) -> DataFrame:
    """df with pos and sentence: pieces after .!? and space or line ends, longer than ``least`` when trimmed."""
    return df.select("*", F.posexplode(F.split(F.col(text), r"(?<=[.!?])\s+|\n+")).alias("pos", "sentence")).filter(F.length(F.trim("sentence")) > least)


_FULL, _SHORT = "|".join(MONTHS), rf"(?:{'|'.join(x[:3] for x in MONTHS if x != 'May')})\.?"


def _month_and(c: Column, end: str) -> Column:
    """The first full month with such an end, else the first short one, else empty."""
    found = lambda months: F.nullif(F.regexp_extract(c, rf"(?i)\b(?:{months})\s+{end}", 0), F.lit(""))
    return F.coalesce(found(_FULL), found(_SHORT), F.lit(""))


def month_year(c: Column) -> Column:
    return _month_and(c, r"(?:20|19)\d{2}\b")


def month_day(c: Column) -> Column:
    return _month_and(c, r"\d{1,2}(?:,?\s+\d{4})?")


def date_from(c: Column, my: Column, md: Column) -> Column:
    """The date of a sentence with this month and year, or month and day (both may be empty)."""
    year = F.regexp_extract(c, r"\b((?:20|19)\d{2})\b", 1).try_cast("int")
    number = lambda m: F.array_position(F.array(*[F.lit(x[:3].lower()) for x in MONTHS]), F.lower(F.substring(m, 1, 3)))
    day = F.regexp_extract(md, r"^[A-Za-z]+\.?\s+(\d{1,2})", 1).try_cast("int")
    md_year = F.coalesce(F.regexp_extract(md, r"(\d{4})$", 1).try_cast("int"), F.lit(2001))
    make = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m.cast("int"), d), "yyyy-MM-dd")
    of_day = F.coalesce(make(md_year, number(md), day), make(md_year, F.lit(1), F.lit(1)))
    return F.when(my != "", make(F.regexp_extract(my, r"(\d{4})$", 1).cast("int"), number(my), F.lit(1))).when(md != "", of_day).otherwise(make(year, F.lit(1), F.lit(1)))


def event_date(c: Column) -> Column:
    """The date that a sentence names: month and year, month and day (a missing year is 2001), the full month before the short one, else a year's first day."""
    return date_from(c, month_year(c), month_day(c))


def amounts(c: Column) -> Column:
    """All amounts of money in a sentence, as written, in order."""
    return F.regexp_extract_all(c, F.lit(f"{AMOUNT}|{UNSIGNED}"), F.lit(0))


def amount_value(raw: Column) -> Column:
    """The value of an amount: its number times its scale word (also when glued to the digits), to cents."""
    number = F.regexp_replace(F.regexp_extract(raw, _NUMBER, 0), ",", "").try_cast("double")
    scale = F.lower(F.regexp_extract(raw, r"(?i)(billion|million|thousand|trillion|bn|mn|tr|[bmkt])(?:\s*(?:USD|US dollars?|dollars?))?$", 1))
    times = F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])
    return F.round(number * F.coalesce(times[scale], F.lit(1.0)), 2)


def currency(raw: Column) -> Column:
    return F.when(raw.rlike("(?i)£|GBP"), "GBP").when(raw.rlike("(?i)€|EUR"), "EUR").otherwise("USD")
