"""Queries over the rules on mentions, money, documents, sources and promotion."""

from pyspark.sql import functions as F

from casework.functions import mention_rules as rules
from casework.functions import pages, parties, relevance, targets, text
from casework.functions.documents import cleaned
from casework.operators import articles, extraction, findings, listed, money, overview, promotion
from casework.plans.document_plans import PLAIN_TEXT, _bodies, _dealt_view, _text_view, _view
from casework.sources.views import load


def _in(words):
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _list(words):
    return "[" + _in(words)[1:-1] + "]"


def _hits(text_, words):
    return f"len(list_filter({words if words.startswith('[') or words.isidentifier() else words}, lambda w: contains({text_}, w)))"


def _cases(of, values, other):
    return "case " + " ".join(f"when {of} = '{k}' then {v}::double" for k, v in values.items()) + f" else {other}::double end"


# --- mentions: names of all shapes in sentences -------------------------------------------------

NAMES = """select m.id, m.case_id, m.entity_type, m.confidence, m.zone, case m.id % 19 when 0 then concat('More ', m.entity_name) when 1 then 'The City' when 2 then '$5 million fund' when 3 then upper(concat(m.entity_name, ' of Old Town'))
        when 4 then concat(m.entity_name, ' Jordan Petrov') when 5 then 'Commission' when 6 then concat(m.entity_name, ' Subscribe') when 7 then 'HUD' when 8 then 'of' when 9 then concat('With ', m.entity_name) when 10 then 'Casey' else m.entity_name end as entity_name,
        concat(case m.id % 7 when 0 then 'Read more: ' when 1 then 'The federal judge said so. ' when 2 then 'A quarterback on the roster. ' when 3 then 'Shelter vouchers for tenants. ' else '' end, m.entity_name, ' - ', case m.id % 5 when 0 then 'no news' else s.sentence end) as context,
        split_part('crime_corruption,legal_lawsuit,policy_government,housing_homelessness,finance_funding,education_university,entertainment_film,sports,general', ',', cast(m.case_id % 9 as int) + 1) as intent
    from {mentions} m join {sentences} s on s.document_id = m.document_id and s.pos = m.id - m.document_id * 8"""
TERMS = ["harbor", "council", "audit"]


def _ruled(s, d):
    m = s.sql(NAMES, mentions=load(s, d, "mentions"), sentences=load(s, d, "sentences"))
    n, c = F.col("entity_name"), F.col("context")
    m = m.withColumn("kind", rules.corrected_type(n, F.col("entity_type")))
    return m.withColumns({"r": rules.role(c, F.col("kind")), "topic": rules.topic(n, c, F.array(*map(F.lit, TERMS)), F.col("intent"))})


def _rlike(c, patterns):
    plain = [p.replace("(?!\\s+department)", "").replace("'", "''") for p in ([patterns] if isinstance(patterns, str) else patterns)]
    return "(" + " or ".join(f"regexp_matches({c}, '{p}')" for p in plain) + ")"


def _topic_sql():
    low = "lower(concat_ws(' ', entity_name, context))"
    has = lambda p: f"regexp_matches({low}, '{p}')"
    out = "case "
    for kind, (words, high, medium) in rules.ON_TOPIC.items():
        off = {"housing_homelessness": f"({has(rules.STAR_TOPIC)} or {has(rules.SPORTS_TOPIC)} or {has(rules.WAR_TOPIC)}) and not {has(words)}", "education_university": f"{has(rules.SPORTS_TOPIC)} and not {has('university|college')}", "entertainment_film": has(rules.GOSSIP_TOPIC)}.get(kind, f"{has(rules.SPORTS_TOPIC)} and not {has(words)}")
        more = f"when {has(rules.PROBE_TOPIC)} and share >= 0.1 then 'MEDIUM' " if kind == "housing_homelessness" else ""
        out += f"when intent = '{kind}' then case when {off} then 'OFF_TOPIC' when {has(words)} and share >= {high} then 'HIGH' when {has(words)} or share >= {medium} then 'MEDIUM' {more}else 'LOW' end "
    off = f"(({has(rules.SPORTS_TOPIC)} or {has(rules.SCREEN_TOPIC)}) and share < 0.2) or ({has(rules.PRIVATE_TOPIC)} and not {has(rules.PROBE_TOPIC)} and share < 0.25) or ({has(rules.RESULTS_TOPIC)} and not {has(rules.PROBE_TOPIC)} and share < 0.2)"
    return out + f"else case when {off} then 'OFF_TOPIC' when share >= 0.6 then 'HIGH' when share >= 0.3 or {has(rules.PROBE_TOPIC)} then 'MEDIUM' else 'LOW' end end"


WORDS = "string_split_regex(trim(entity_name), '\\s+')"
PLAIN = f"len(list_filter({WORDS}, lambda w: lower(w) not in {_in(rules.CONNECTORS)}))"
MENU_FIRST = f"lower({WORDS}[1]) in {_in(rules.NAV_FIRST)}"
MERGED = f"""(case when len({WORDS}) >= 3 then len(list_filter({WORDS}, lambda w: regexp_full_match(w, '[A-Z][a-zA-Z''-]+'))) = len({WORDS}) and (
        (len({WORDS}) = 3 and {PLAIN} = 3 and len(list_filter({WORDS}, lambda w: regexp_full_match(w, '[A-Z][a-z][a-z]+'))) = 3)
        or (len({WORDS}) >= 4 and {PLAIN} = len({WORDS}) and len(regexp_extract_all(entity_name, '\\b[A-Z][a-z][a-z]+\\s+[A-Z][a-z][a-z]+\\b')) >= 2)
        or ({MENU_FIRST} and {PLAIN} >= 2) or regexp_matches(entity_name, '[a-z][A-Z]'))
    else len({WORDS}) = 2 and (regexp_matches(entity_name, '[a-z][A-Z]') or {MENU_FIRST}) end)"""
MENU_TEXT = "(" + " or ".join(f"starts_with(upper(trim(entity_name)), '{x}')" for x in rules.NAV_STARTS) + f" or {_rlike('entity_name', [rules.NAV_INSIDE, rules.NAV_ENDS])} or {_rlike('trim(entity_name)', rules.NAV_ALONE)})"
MISSHAPEN = f"""(length(trim(entity_name)) < 2 or len({WORDS}) > 5 or regexp_matches(trim(entity_name), '["''“”;:]') or (len({WORDS}) > 3 and trim(entity_name) = upper(trim(entity_name)))
    or {_rlike('trim(entity_name)', [rules.AMOUNT_NAME, rules.MARKS_NAME, rules.CUT_NAME, rules.URL_NAME, rules.VERB_START])} or length(trim(entity_name)) > 60
    or (kind = 'person' and (len({WORDS}) < 2 or len(list_filter({WORDS}, lambda w: regexp_matches(w, '^[A-Z]') or regexp_matches(w, '{rules.PARTICLES}'))) < len({WORDS}) or {WORDS}[1] in {_in(rules.PERSON_STARTS)})))"""
CROSS = f"""({_rlike('entity_name', rules.NAV_RESIDUE)} or ({MENU_FIRST} and length(entity_name) > length({WORDS}[1]) + 1) or (regexp_matches(lower(context), '{rules.NAV_BEFORE}')
    and strpos(lower(context), lower(entity_name)) - 1 > length(regexp_extract(lower(context), '(?s)^(.*?){rules.NAV_BEFORE}', 1)) and strpos(lower(context), lower(entity_name)) - 1 - length(regexp_extract(lower(context), '(?s)^(.*?){rules.NAV_BEFORE}', 1)) < 60))"""
AGENCY = _rlike("entity_name", rules.AGENCIES)
KIND = f"case when entity_type = 'person' then case when {_rlike('entity_name', [rules.ORG_FORMS, rules.ORG_WORDS])} then 'organization' when {AGENCY} or regexp_full_match(trim(entity_name), '[A-Z]{{2,6}}') then 'agency' else 'person' end when entity_type = 'organization' and {AGENCY} then 'agency' else entity_type end"
ROLE = "case when kind = 'agency' then 'GOVERNMENT_AGENCY' " + " ".join(f"when {_rlike('lower(context)', p)} then '{r}'" for p, r, _ in rules.ROLES) + " when kind = 'person' then 'PERSON' when kind = 'organization' then 'ORGANIZATION' when kind = 'location' then 'FACILITY' else 'UNKNOWN' end"
SHARE = f"len(list_filter({_list(TERMS)}, lambda t: contains(lower(concat_ws(' ', entity_name, context)), t))) / 3"
RULED = f"names as ({NAMES}), typed as (select *, {KIND} as kind, {SHARE} as share from names), ruled as (select *, {ROLE} as role, {_topic_sql()} as topic from typed)"
SERIOUS = f"intent in {_in(rules.SERIOUS)}"
REASON = f"""case when length(trim(entity_name)) < 3 then 'SHORT_FRAGMENT' when zone in {_in(rules.REJECTED_ZONES)} then 'ZONE_REJECT' when {MENU_TEXT} then 'NAV_RESIDUE' when {MISSHAPEN} then 'ARTIFACT_ENTITY' when {MERGED} then 'ARTIFACT' when {CROSS} then 'CROSS_STORY'
    when {_rlike('entity_name', rules.TITLE_FRAGMENTS)} then 'TITLE_FRAGMENT' when zone = 'tail' and length(trim(context)) < 80 and confidence < 0.68::double then 'BOILERPLATE_CONTEXT' when topic = 'OFF_TOPIC' then 'TOPIC_MISMATCH' when confidence < 0.48::double then 'LOW_CONFIDENCE'
    when {SERIOUS} and zone = 'tail' and topic = 'LOW' and role = 'UNKNOWN' then 'BOILERPLATE_CONTEXT' when topic = 'LOW' and role = 'UNKNOWN' and confidence < case when {SERIOUS} then 0.80::double else 0.65::double end then 'LOW_CONFIDENCE'
    when len({WORDS}) = 1 and kind <> 'person' and lower(trim(entity_name)) in {_in(rules.GENERIC_STUBS)} then 'BLOCKLIST' end"""


def _reasons(s, d):
    c = F.col
    return _ruled(s, d).select("id", "case_id", rules.reject_reason(c("entity_name"), c("kind"), c("confidence"), c("topic"), c("r.role"), c("context"), c("zone"), c("intent")).alias("reject_reason"))


# Names of each case's entities on lists, some on several.
LISTED = "select distinct name, split_part('blocked,leisure,celebrity,foreign,skipped,other', ',', cast(id % 6 as int) + 1) as list from {entities} union all select distinct split_part(lower(name), ' ', 1) as name, 'first_name' as list from {entities} where type = 'person' union all select 'Casey', 'skipped' union all select 'of', 'skipped'"
ON = lambda *lists: f"entity_name in (select name from listed where list in {_in(lists)})"
LISTED_RULES = f"""when {ON('blocked')} or ({ON('leisure')} and intent not in ('entertainment_film', 'sports')) then 'BLOCKLIST' when (kind = 'person' and {ON('celebrity')} and intent not in ('entertainment_film', 'sports')) or ({ON('foreign')} and {SERIOUS}) then 'TOPIC_MISMATCH'
    when kind = 'person' and len({WORDS}) = 1 and lower(trim(entity_name)) in (select name from listed where list = 'first_name') and role in ('UNKNOWN', 'PERSON') then 'COMMON_FIRST_NAME' """
LISTED_REASON = REASON.replace("then 'CROSS_STORY'\n    when", "then 'CROSS_STORY' " + LISTED_RULES + "\n    when", 1).replace("when " + MISSHAPEN, f"when {MISSHAPEN} or {WORDS}[1] in (select name from listed where list = 'skipped')", 1)


def _listed_reasons(s, d):
    m = listed.flagged(_ruled(s, d), _view(s, d, LISTED, "entities"), "entity_name")
    c = F.col
    return m.select("id", "case_id", rules.reject_reason(c("entity_name"), c("kind"), c("confidence"), c("topic"), c("r.role"), c("context"), c("zone"), c("intent"), listed.flags_of()).alias("reject_reason"))


# --- money: parties and confidence --------------------------------------------------------------


def _party(x):
    return f"""case when length(trim({x})) >= 3 and lower(trim({x})) not in {_in(parties.BANNED)} and split_part(lower(trim({x})), ' ', 1) not in {_in(parties.HEAD_WORDS)} and {x} <> lower({x}) and not (regexp_full_match({x}, '[A-Z][a-z]+') and length({x}) < 6)
        then case lower(trim({x})) {' '.join(f"when '{k}' then '{v}'" for k, v in parties.ALIASES.items())} else trim({x}) end end"""


NP, LNP = f"\\b({parties.PHRASE})\\b", f"\\b({parties.LONG_PHRASE})\\b"
AFTER = lambda verb: _party(f"regexp_extract(regexp_extract(sentence, '(?s)^.*?(?i:{verb})(.*)$', 1), '{NP}', 1)")
BEFORE = f"regexp_extract(sentence, '(?s)^(.+?)(?:{parties.MONEY_SIGN}|(?i:{parties.AWARD}))', 1)"
SUBJECT = f"list_sort(list_transform(list_filter(list_transform(regexp_extract_all({BEFORE}, '{NP}', 1), lambda x: {_party('x')}), lambda x: x is not null), lambda x, i: {{'s': -length(x), 'i': i, 'n': x}}))[1].n"
TOLD = f"from {{sentences}} where regexp_matches(lower(sentence), '{money.FUNDING_GATE}') and " + " and ".join(f"not regexp_matches(lower(sentence), '{p}')" for p in money.NO_FUNDING)
ANCHORS = ["harbor", "council", "program"]
WORDS_OF = lambda: F.array(*map(F.lit, ANCHORS))
ANCHOR_HITS = _hits("lower(sentence)", _list(ANCHORS))


def _points(named):
    low = lambda p: f"regexp_matches(lower(sentence), '{p}')"
    both = f"case when {low(parties.CONTROL)} and {low(parties.RECEIVE)} then 0.12::double when {low(parties.CONTROL)} or {low(parties.RECEIVE)} then 0.07::double else 0 end"
    types = "case signal_type " + " ".join(f"when '{t}' then {x}::double" for t, x in parties.TYPE_POINTS.items()) + " else 0 end"
    return f"""round(case when {low(money.FUNDING_GATE)} then 0.20::double else 0 end + case when {low(parties.EXPLICIT)} then 0.25::double when {low(parties.FLOW)} then 0.15::double when {low(parties.GENERIC)} then 0.08::double else 0 end + case when {named} is not null then 0.12::double else 0 end
        + {both} + {types} + case when {low(parties.PROGRAM_WORD)} then 0.05::double else 0 end + case when hits >= 3 then 0.15::double when hits = 2 then 0.10::double when hits = 1 then 0.05::double else -0.05::double end, 2)"""


def _typed(rules_):
    return "case " + " ".join(f"when regexp_matches(lower(sentence), '{p}') then '{t}'" for p, t in rules_) + " else 'FUNDING' end"


PARTIES = f"""told as (select document_id, pos, sentence, {_typed(text.SIGNAL_WORDS)} as signal_type, {ANCHOR_HITS} as hits, regexp_extract(sentence, '(?:\\$|USD )\\s*[0-9][0-9,]*(?:[.][0-9]+)?(?: million)?') as amount_raw {TOLD}),
    valued as (select *, round(cast(replace(regexp_extract(amount_raw, '[0-9][0-9,]*(?:[.][0-9]+)?'), ',', '') as double) * case when amount_raw like '%million' then 1000000 else 1 end, 2) as amount,
        '$' || case when amount_raw like '%million' then regexp_replace(regexp_replace(regexp_extract(amount_raw, '[0-9][0-9.]*'), '([.][0-9]*?)0+$', '\\1'), '[.]$', '') || 'M' else format('{{:,}}', cast(replace(regexp_extract(amount_raw, '[0-9][0-9,]*'), ',', '') as bigint)) end as amount_display from told where amount_raw <> ''),
    one as (select * from (select *, row_number() over (partition by document_id, amount_display order by pos) as rn from valued where amount >= 1000) where rn = 1),
    named as (select *, coalesce({AFTER(parties.CONTROL)}, {SUBJECT}) as controlled_by, coalesce({AFTER(parties.RECEIVE)}, {_party(f"regexp_extract(sentence, '{parties.RECIPIENT}({parties.PHRASE})\\b', 1)")}) as received_by, nullif(trim(regexp_extract(sentence, '{parties.PROGRAM}', 1)), '') as program_name from one),
    last as (select *, coalesce(controlled_by, received_by, list_filter(list_transform(regexp_extract_all(sentence, '{LNP}', 1), lambda x: {_party('x')}), lambda x: x is not null)[1]) as entity_name from named),
    signals as (select *, {_points('entity_name')} as financial_confidence from last)"""
STRIPPED = "select document_id, pos, regexp_replace(sentence, '([$]|USD )[0-9.,]+( million)?', 'funds') as sentence from {sentences}"
NO_AMOUNT = f"""bare as ({STRIPPED}), heard as (select *, {_typed(text.SIGNAL_WORDS)} as kind, {ANCHOR_HITS} as hits, nullif(regexp_extract(sentence, '{LNP}', 1), '') as phrase, substring(regexp_replace(trim(sentence), '\\s+', ' ', 'g'), 1, 250) as event_summary from bare
        where regexp_matches(lower(sentence), '{extraction.FUNDS_GATE}') and not regexp_matches(lower(sentence), '{extraction.OFFERS}') and {" and ".join(f"not regexp_matches(lower(sentence), '{p}')" for p in money.NO_FUNDING[:3])} and (regexp_matches(lower(sentence), '{parties.EXPLICIT}') or regexp_matches(lower(sentence), '{parties.FLOW}'))),
    some_ as (select * from (select *, row_number() over (partition by document_id, substring(event_summary, 1, 80) order by pos) as rn from heard where phrase is not null or regexp_matches(lower(sentence), '{extraction.PROGRAM_REF}')) where rn = 1),
    few as (select *, {_party('phrase')} as entity_name from (select *, row_number() over (partition by document_id order by pos) as k from some_) where k <= 5)"""


def _sentences(s, d):
    return load(s, d, "sentences").withColumn("words", WORDS_OF())


def _signals(s, d):
    return extraction.money_signals(_sentences(s, d))


def _non_numeric(s, d):
    return extraction.non_numeric_signals(s.sql(STRIPPED.replace("[$]", "[$]"), sentences=load(s, d, "sentences")).withColumn("words", WORDS_OF()))


# --- documents ----------------------------------------------------------------------------------

FETCHED = """select o_orderkey as id, case o_orderkey % 11 when 0 then '[FETCH_FAILED] gone' when 1 then concat('[WRAPPER_BLOCKED]', repeat(' text of a page', 12)) when 2 then cast(null as string) when 3 then 'short' when 4 then concat('[DIAG:status=failed|score=3] ', repeat('some body ', 20))
        else concat('[DIAG:status=', split_part('ok,partial,failed', ',', cast(o_custkey % 3 as int) + 1), case when o_orderkey % 5 = 0 then '|priority=NOISE' else '' end, '] ', repeat('The county budget for the shelter program was $5 in fraud probe. ', cast(o_custkey % 9 as int)), case when o_custkey % 4 = 0 then 'Press release of the day.' else '' end) end as raw_text,
        split_part('county.gov,example.com,prnewswire.com,apnews.com,blog.example.org,patch.com,x.com,courtlistener.com,', ',', cast(o_custkey % 9 as int) + 1) as domain, cast(o_orderkey % 7 as int) as n_entities from {orders}"""
BODIES = """select doc_id as id, concat(text, case doc_id % 5 when 0 then concat(' Sign in to read', repeat(concat(chr(10), 'Log in'), 9)) when 1 then ' Click here. Read more.' when 2 then concat(chr(10), chr(10), 'The council of the county approved the whole budget of the year, and the shelter program goes on.', chr(10), chr(10)) else '' end) as text from {documents}"""


def _fetched(s, d):
    return _view(s, d, FETCHED, "orders")


def _has(c, *words):
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _any(c, words):
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"


RAW = "coalesce(raw_text, '')"
BODY = f"trim(regexp_replace(regexp_replace(regexp_replace({RAW}, '^\\s*\\[DIAG:[^\\]]*\\]\\s*', ''), '^\\s*\\[WRAPPER_BLOCKED[^\\]]*\\]\\s*', ''), '^\\s*\\[FETCH_FAILED[^\\]]*\\]\\s*', ''))"
HOST = "lower(domain)"
NEWS = "select o_orderkey as id, o_orderkey % 50 as case_id, concat(split_part('Audit of,Season of,Budget for,Notes on', ',', cast(o_custkey % 4 as int) + 1), ' ', split_part('Harbor Housing,the roster,Metro Council,the box office', ',', cast(o_orderkey % 4 as int) + 1)) as title, concat(repeat('The city council of Harbor approved a grant for the housing program after an audit. ', cast(o_custkey % 23 as int)), case o_orderkey % 6 when 0 then 'The quarterback of the roster led the game and the playoff. ' when 1 then 'Press release. Media contact. ' when 2 then 'A film review of the album and the concert. ' else '' end) as text, split_part('county.gov,example.com,apnews.com', ',', cast(o_custkey % 3 as int) + 1) as domain, split_part('crime_corruption,legal_lawsuit,policy_government,housing_homelessness,finance_funding,education_university,entertainment_film,sports,general', ',', cast(o_orderkey % 9 as int) + 1) as intent, split_part('person_target,funding_target,general,scandal_target', ',', cast(o_orderkey % 4 as int) + 1) as mode, 'Harbor Housing Council' as target from {orders}"


def _news(s, d):
    n = _dealt_view(s, d, NEWS, "orders").withColumn("words", targets.anchor_words(F.col("target")))
    n = n.withColumns({"terms": F.split(F.lower("target"), " "), "anchor": relevance.anchor(F.col("words"), F.col("mode")), "boilerplate_ratio": cleaned(F.col("text"))["boilerplate_ratio"]})
    return relevance.document_relevance(n)


def _news_sql():
    title, body = "lower(title)", "lower(text)"
    inv, fluff = _list(relevance.INVESTIGATIVE), _list(relevance.FLUFF)
    none_in = lambda words: f"len(list_filter({words}, lambda w: not contains({title}, w) and contains({body}, w)))"
    base = ["harbor", "housing", "council"]
    words = "case mode " + " ".join(f"when '{m}' then {_list([*dict.fromkeys(base + x)][:8])}" for m, x in relevance.MODE_WORDS.items()) + f" else {_list(base)} end"
    strong = _list(base)
    against = f"case when mode <> 'person_target' then {_list(relevance.NOT_FOR_THINGS)} else [] end || case when mode not in ('event_target', 'scandal_target') then {_list(relevance.NOT_FOR_CALM)} else [] end"
    al = "case "
    for kind, (p, gain, loss) in relevance.ALIGNED.items():
        off = f"sports and not regexp_matches({title}, '\\b(university|college)\\b')" if kind == "education_university" else "sports"
        more = "when screen then {'t': 'mismatched', 'p': -20} " if kind == "housing_homelessness" else ""
        al += f"when intent = '{kind}' then case when regexp_matches(every, '{p}') then {{'t': 'aligned', 'p': {gain}}} when {off} then {{'t': 'mismatched', 'p': {loss}}} {more}else {{'t': 'partial', 'p': 0}} end "
    al += f"""when intent in ('finance_funding', 'policy_government') then case when sports then {{'t': 'mismatched', 'p': -22}} when screen then {{'t': 'mismatched', 'p': -18}} when regexp_matches(every, '{relevance.FUNDS_DOC}') then {{'t': 'aligned', 'p': 8}} else {{'t': 'partial', 'p': 0}} end
        when intent = 'entertainment_film' then case when regexp_matches(every, '{relevance.FILM_FUNDS}') then {{'t': 'aligned', 'p': 10}} when regexp_matches(every, '{relevance.GOSSIP_DOC}') then {{'t': 'mismatched', 'p': -20}} else {{'t': 'partial', 'p': 0}} end
        when intent = 'sports' then {{'t': case when sports then 'aligned' else 'partial' end, 'p': 0}} else {{'t': case when (sports or screen) and ft + fb >= 2 then 'mismatched' else 'partial' end, 'p': 0}} end"""
    return f"""with n as ({NEWS}), h as (select *, concat_ws(' ', {body}, {title}) as every, {_hits(title, strong)} > 0 as title_hit, {_hits(f'substring({body}, 1, 600)', strong)} > 0 as lead_hit, {words} as words, {against} as against, length(text) as size,
            {_hits(title, _list(base))} as qt, {none_in(_list(base))} as qb, {_hits(title, inv)} as it, {none_in(inv)} as ib, {_hits(title, fluff)} as ft, {none_in(fluff)} as fb, len(list_filter({_list(relevance.PR_WIRE)}, lambda w: contains({body}, w) or contains({title}, w))) as pr, {_hits('lower(domain)', _list(relevance.QUALITY_DOMAINS))} > 0 as good from n),
        a as (select *, len(list_filter(words, lambda w: contains({body}, w))) as overlap, len(words) as n_words, len(list_filter(against, lambda w: contains({title}, w) or contains(substring({body}, 1, 600), w))) > 0 as bad, regexp_matches(every, '{relevance.SPORTS_DOC}') as sports, regexp_matches(every, '{relevance.SCREEN_DOC}') as screen from h),
        b as (select *, cast(floor(case when title_hit then 35 else 0 end + case when lead_hit then 20 else 0 end + overlap::double / n_words * 35 + case when overlap >= 2 then 10 else 0 end + 0.5) as integer) as anchor_score, {al} as al from a),
        r as (select *, case when bad then 'incompatible' when anchor_score >= 40 then 'compatible' else 'partial' end as fit, 50 + 6.0::double * qt + 1.5::double * qb + 3.0::double * it + 0.8::double * ib - 5.0::double * ft - 1.5::double * fb + al.p + case when title_hit then 18 when lead_hit then 10 else 0 end + case when overlap >= 3 then 8 when overlap >= 1 then 3 else 0 end
            - case when bad then 20 else 0 end - case when overlap = 0 and n_words >= 2 and mode <> 'general' then 12 else 0 end + case when qt = 3 then 10 else 0 end + case when ib >= 5 then 5 else 0 end + case when size >= 1500 then 6 when size >= 500 then 3 when size < 100 then -15 when size < 200 then -8 else 0 end
            + case when good then 8 else 0 end - case when pr >= 2 then 18 when pr = 1 then 8 else 0 end - case when ft + fb >= 3 then 8 else 0 end as raw from b),
        s as (select *, cast(floor(greatest(0, least(100, case when al.t = 'mismatched' and qt = 0 and qb < 2 then least(raw, 15) when al.t = 'mismatched' and it = 0 and (sports or screen) then least(raw, 14) else raw end)) + 0.5) as integer) as score from r),
        p as (select *, case when score >= 65 then 'PRIORITY_A' when score >= 40 then 'PRIORITY_B' when score >= 18 then 'LOW_SIGNAL' else 'NOISE' end as priority from s)
        select id, score, priority, case when al.t = 'mismatched' and fit <> 'compatible' then 'OFF_TOPIC' when priority = 'NOISE' then 'CONTAMINATED' when anchor_score >= 60 and priority = 'PRIORITY_A' then 'CORE' when priority in ('PRIORITY_A', 'PRIORITY_B') then 'RELEVANT' else 'PERIPHERAL' end as tier, anchor_score, fit, al.t as topic from p"""


# --- promotion ----------------------------------------------------------------------------------

CASES = "select distinct o_orderkey % 50 as case_id, 'Harbor Council' as target, split_part('crime_corruption,legal_lawsuit,general,housing_homelessness,sports', ',', cast(o_orderkey % 50 % 5 as int) + 1) as intent, cast(o_orderkey % 50 % 4 as int) as n_aligned, cast(o_orderkey % 50 % 3 as int) as n_usable, cast(o_orderkey % 50 % 6 as int) as n_promoted, cast(o_orderkey % 50 % 20 as int) as n_documents, cast(o_orderkey % 50 % 4 as int) as main_support, o_orderkey % 50 % 7 = 0 as recovered, cast(o_orderkey % 50 % 9 as int) as n_detected from {orders}"
FACTS = "select o_orderkey as document_id, concat('Report of ', split_part('Harbor Council,Metro Bank,the day,Apex Trust', ',', cast(o_custkey % 4 as int) + 1)) as title, split_part('PRIORITY_A,PRIORITY_B,LOW_SIGNAL', ',', cast(o_orderkey % 3 as int) + 1) as priority, split_part('CORE,RELEVANT,PERIPHERAL,PERIPHERAL', ',', cast(o_custkey % 4 as int) + 1) as tier, split_part('low,med,high', ',', cast(o_custkey % 3 as int) + 1) as contamination from {orders}"
# Each tenth case has low topics alone, so that nothing passes and the late passes apply.
SEEN = """select m.id, m.document_id, m.case_id, case m.id % 5 when 0 then concat(m.entity_name, ' East') when 1 then concat(m.entity_name, ' West') when 2 then concat('Greater ', m.entity_name) else m.entity_name end as entity_name, m.entity_type, m.confidence, m.status, m.role,
    case when m.case_id % 10 = 9 then 'LOW' else m.topic end as topic, m.zone, concat('the ', case when m.id % 3 = 0 then 'budget' else 'news' end, ' of ', m.entity_name) as context from {mentions} m"""


def _features(s, d):
    seen = _view(s, d, SEEN, "mentions")
    own = seen.select("case_id", "entity_name").distinct().select("case_id", F.explode(F.array(text.normalized_name(F.col("entity_name")))).alias("name_key")).distinct().withColumn("cluster", F.col("name_key"))
    return promotion.features(seen, own, _view(s, d, FACTS, "orders"))


def _w(c, weights):
    return f"case {c} " + " ".join(f"when '{k}' then {v}" for k, v in weights.items()) + " else 0 end"


ROLE_W, TOPIC_W = _w("role", promotion.ROLE_WEIGHT), _w("topic", promotion.TOPIC_WEIGHT)
FEATURES = f"""seen as ({SEEN}), facts as ({FACTS}), joined as (select s.*, lower(trim(entity_name)) as cluster, f.title, f.priority, f.tier, f.contamination, s.zone in ('title', 'dek', 'lead') as front from seen s left join facts f using (document_id)),
    feats as (select case_id, cluster, count(distinct document_id)::int as n_documents, count(*)::int as n_mentions, max(confidence) as max_confidence, min(id) as first_id, min_by(entity_type, id) as type, arg_max(entity_name, {{'a': length(entity_name), 'b': -id}}) as display_name, (count(*) filter (contains(lower(title), cluster)))::int as title_hits,
        (count(*) filter (regexp_matches(context, '{promotion.MONEY_CONTEXT}')))::int as money_contexts, bool_or(entity_type = 'agency') as is_agency, arg_max(role, {{'a': {ROLE_W}, 'b': -id}}) as best_role, arg_max(topic, {{'a': {TOPIC_W}, 'b': -id}}) as best_topic, bool_or(front) as in_front, bool_or(coalesce(priority in ('PRIORITY_A', 'PRIORITY_B'), false)) as in_quality,
        bool_or(coalesce(priority = 'PRIORITY_A', false)) as in_a, bool_or(coalesce(tier = 'CORE', false)) as in_core, bool_or(coalesce(tier = 'RELEVANT', false)) as in_relevant, (count(*) filter (zone = 'tail'))::int as n_tail, (count(*) filter (topic = 'HIGH'))::int as n_high, (count(*) filter (topic = 'MEDIUM'))::int as n_medium, bool_and(coalesce(contamination = 'high', false)) as contaminated_only from joined group by 1, 2),
    weighed as (select *, {_w('best_role', promotion.ROLE_WEIGHT)} as role_weight from feats)"""
SER = f"intent in {_in(rules.SERIOUS)}"
TRUST = f"""round(least(0.99::double, max_confidence + case when n_documents >= 3 then 0.14::double when n_documents >= 2 then 0.09::double else 0 end + case when in_front then 0.08::double else 0 end + case when title_hits >= 2 then 0.10::double when title_hits >= 1 then 0.05::double else 0 end + case when money_contexts >= 1 then 0.06::double else 0 end + case when is_agency then 0.06::double else 0 end
    + case when in_a then 0.06::double when in_quality then 0.03::double else 0 end + case when in_core then 0.12::double when in_relevant then 0.06::double else 0 end + case when n_high >= 2 then 0.09::double when n_high >= 1 then 0.05::double else 0 end + case when n_medium >= 2 then 0.04::double else 0 end
    + case when role_weight >= 9 then 0.12::double when role_weight >= 7 then 0.08::double when role_weight >= 5 then 0.05::double when role_weight >= 3 then 0.02::double else -0.12::double end - (case best_topic when 'LOW' then 0.10::double when 'OFF_TOPIC' then 0.30::double else 0 end + case when type = 'person' and not contains(display_name, ' ') and title_hits = 0 then 0.30::double else 0 end
    + case when cluster in ('harbor', 'council') then 0.20::double else 0 end + case when n_tail = n_mentions then 0.18::double else 0 end + case when contaminated_only then 0.22::double else 0 end + case when {SER} and n_documents <= 1 and not in_front then 0.20::double else 0 end)), 4) + 0.0::double"""
GOOD, NAMED = "best_topic in ('HIGH', 'MEDIUM')", f"regexp_matches(display_name, '{rules.INSTITUTION}')"
PASS = f"""case when contaminated_only then null when n_documents >= 2 and {GOOD} and max_confidence >= 0.60::double and (role_weight >= 3 or {NAMED}) then 1
    when (in_front or title_hits >= 1) and role_weight >= 3 and {GOOD} and max_confidence >= 0.68::double and case when {SER} then (role_weight >= 7 or is_agency) and in_a and best_topic = 'HIGH' else role_weight >= 5 or type in ('agency', 'organization') or in_quality end then 2
    when {NAMED} and {GOOD} and max_confidence >= 0.62::double and in_quality then 3 end"""
DECIDED = f"""{FEATURES}, cases as (select case_id, intent, n_aligned, n_usable from ({CASES})), trusted as (select w.*, c.intent, c.n_aligned, c.n_usable, {TRUST} as trust, {PASS} as pass from weighed w join cases c using (case_id)),
    placed as (select *, pass is not null and row_number() over (partition by case_id order by pass nulls last, first_id) <= 5 as is_promoted from trusted),
    counted as (select *, sum(is_promoted::int) over (partition by case_id) as n_promoted, not is_promoted and not contaminated_only and best_topic <> 'OFF_TOPIC' and role_weight >= 3 as clean from placed),
    scored as (select *, clean and (in_core or in_relevant) and trust >= 0.50::double and n_promoted < 2 and n_aligned >= 2 as aligned from counted),
    extra as (select *, aligned and row_number() over (partition by case_id order by case when aligned then round(trust + case when in_core then 0.20::double else 0.08::double end + case when in_front then 0.10::double else 0 end, 4) end desc nulls last, first_id) <= 2 - n_promoted as is_extra from scored),
    after_ as (select *, clean and not is_extra and trust >= 0.55::double and n_usable > 0 and n_promoted + sum(is_extra::int) over (partition by case_id) = 0 as late from extra),
    lasts as (select *, late and row_number() over (partition by case_id order by case when late then round(trust + case when type in ('agency', 'organization') then 1.5::double else 0 end + case when in_quality then 2.0::double else 0 end, 4) end desc nulls last, first_id) <= 4 as is_late from after_)"""
NOISE = f"(best_topic = 'OFF_TOPIC' or contaminated_only or (role_weight < 3 and trust < 0.72::double) or (n_tail = n_mentions and trust < 0.75::double) or ({SER} and n_documents <= 1 and not in_front and trust < 0.80::double))"


def _decided(s, d):
    return promotion.promoted(_features(s, d), _view(s, d, CASES, "orders").select("case_id", "target", "intent", "n_aligned", "n_usable"))


def _mentioned(s, d, lists=None):
    docs = _bodies(s, d).withColumns({"intent": F.lit("finance_funding"), "terms": F.array(*map(F.lit, TERMS)), "lead_only": F.col("document_id") % 5 == 0})
    return extraction.extracted(docs, lists=lists)


FACTS_OF = """select o_orderkey as case_id, concat('Audit of the ', split_part('Harbor Housing Council,Metro Budget,city', ',', cast(o_custkey % 3 as int) + 1)) as title, split_part('person_target,funding_target,government_agency_target,scandal_target,organization_target,program_target,place_target,general', ',', cast(o_orderkey % 8 as int) + 1) as mode,
    split_part('crime_corruption,finance_funding,housing_homelessness,general', ',', cast(o_custkey % 4 as int) + 1) as intent, split_part('EMPTY,WEAK,STRONG', ',', cast(o_custkey % 3 as int) + 1) as quality, o_custkey % 5 as n_documents, o_custkey % 6 as n_entities, o_custkey % 2 as n_multi, o_custkey % 4 as n_confirmed, least(o_orderkey % 3, 2) as n_persons, least(o_custkey % 3, 2) as n_orgs,
    o_orderkey % 2 as n_agencies, o_orderkey % 5 as n_events, o_custkey % 2 as n_legal, o_orderkey % 4 as n_signals, o_orderkey % 2 as n_numeric, o_custkey % 7 as n_edges from {orders}"""
PEOPLE = [[], ["Jordan Petrov"], ["Jordan Petrov", "Casey Marsh"]]
GROUPS = [[], ["Harbor Council"], ["Harbor Council", "Metro Bank"]]


def _facts(s, d):
    pick = lambda lists, c: F.element_at(F.array(*[F.array(*map(F.lit, x)).cast("array<string>") for x in lists]), (F.col(c) + 1).cast("int"))
    return _view(s, d, FACTS_OF, "orders").withColumns({"persons": pick(PEOPLE, "n_persons"), "orgs": pick(GROUPS, "n_orgs")})


def _joined(rows):
    """SQL for a list of the codes whose conditions hold."""
    return "list_filter([" + ", ".join(f"case when {p} then '{c}' end" for p, c in rows) + "], lambda x: x is not null)"


GAPS = _joined([("n_documents = 0", "NO_DOCUMENTS"), ("n_documents between 1 and 2", "THIN_DOCUMENTS"), ("n_entities = 0", "NO_ENTITIES"), ("n_entities > 0 and n_multi = 0", "SINGLE_SOURCE_ENTITIES"), ("n_entities > 0 and n_multi = 0", "NO_CONFIRMED_ENTITY"), ("n_events = 0", "NO_EVENTS"), ("n_events between 1 and 2", "SPARSE_TIMELINE"),
    ("n_signals = 0 and mode in (''funding_target'', ''scandal_target'')".replace("''", "'"), "NO_SIGNALS_CRITICAL"), ("n_signals = 0 and mode not in ('funding_target', 'scandal_target')", "NO_SIGNALS"), ("n_signals = 1", "ONE_SIGNAL"), ("mode = 'person_target' and n_persons = 0", "TARGET_PERSON_UNSEEN"), ("mode = 'organization_target' and n_orgs = 0", "TARGET_ORGANIZATION_UNSEEN")])
FOUND = "list_filter([case when n_persons > 0 and n_orgs > 0 then 'PERSON_ORG_TIE' when n_persons >= 2 then 'PERSON_PAIR' when n_orgs > 0 then 'MAIN_ORG' end, case when n_numeric > 0 then 'TOP_AMOUNT' end, case when n_legal > 0 then 'LEGAL_EVENT' end, case when n_edges >= 3 then 'DENSE_NETWORK' when n_entities >= 3 then 'NO_LINKS' end, case when n_confirmed > 0 then 'CONFIRMED_ENTITIES' end], lambda x: x is not null)"
DO = _joined([("n_documents between 1 and 2", "EXPAND_DOCUMENTS"), ("n_entities >= 2 and n_events = 0", "MAP_RELATIONSHIP"), ("n_legal = 0", "SEARCH_OVERSIGHT_RECORDS"), ("n_signals > 0", "PULL_DISCLOSURES"), ("n_signals = 0", "REQUEST_SPENDING_RECORDS"), ("n_agencies > 0", "FILE_RECORDS_REQUEST"), ("true", "UPGRADE_SOURCES"), ("n_events < 3", "RECONSTRUCT_TIMELINE")])
OTHER = "mode in ('general')"
ANGLES = _joined([("mode = 'person_target'", "ACCOUNTABILITY"), ("mode = 'person_target' and n_signals > 0", "FOLLOW_MONEY"), ("mode = 'person_target' and n_orgs > 0", "AFFILIATIONS"), *[(f"mode in ('organization_target', 'government_agency_target') and {p}", c) for p, c in (("true", "OVERSIGHT"), ("n_signals > 0", "SPENDING"), ("n_persons > 0", "LEADERSHIP"))],
    *[(f"mode = 'funding_target' and {p}", c) for p, c in (("true", "GRANT_TRAIL"), ("true", "DELIVERY"), ("n_persons > 0", "BENEFICIARIES"))], *[(f"mode = 'scandal_target' and {p}", c) for p, c in (("true", "LEGAL_EXPOSURE"), ("true", "COVER_UP"), ("n_signals > 0", "MOTIVE"))],
    ("mode = 'program_target'", "EFFECTIVENESS"), ("mode = 'program_target'", "CONTRACTING"), ("mode = 'place_target'", "LOCAL_CORRUPTION"), ("mode = 'place_target' and n_signals > 0", "PUBLIC_FUNDS"), (f"{OTHER} and intent = 'crime_corruption'", "CORRUPTION_PATTERN"), (f"{OTHER} and intent = 'finance_funding'", "IRREGULARITIES"),
    (f"{OTHER} and intent = 'housing_homelessness'", "CONTRACT_ACCOUNTABILITY"), (f"{OTHER} and intent = 'general'", "AGGREGATION"), ("n_events > 0 and n_signals > 0", "MONEY_TIMELINE"), ("n_entities >= 4", "NETWORK")])
MENTIONED = "(list_transform({names}, lambda n: '\"' || n || '\" {end}'))"


def _ends_sql(names, ends):
    """Queries of each name before those of the next."""
    return f"flatten(list_transform({names}, lambda n: [{', '.join(chr(39) + chr(34) + chr(39) + ' || n || ' + chr(39) + chr(34) + ' ' + e + chr(39) for e in ends)}]))"


def _next_sql():
    pick = lambda lists, c: "case " + " ".join(f"when {c} = {i} then {x}::varchar[]" for i, x in enumerate(lists)) + " end"
    by = lambda names, ends: "case " + " ".join(f"when mode = '{m}' then {_ends_sql(names, ends[m]) if m in ends else '[]::varchar[]'}" for m in dict.fromkeys((*findings.PERSON_ENDS, *findings.ORG_ENDS)) if m) + f" else {_ends_sql(names, ends[''])} end"
    partner = "list_transform(orgs, lambda o: '\"' || o || '\" \"' || coalesce(persons[1], title) || '\" records OR contract')"
    board = "list_transform(persons, lambda p: '\"' || p || '\" \"' || coalesce(orgs[1], '') || '\" board OR salary OR conflict')"
    return f"""with f as (select *, {pick(PEOPLE, 'n_persons')} as persons, {pick(GROUPS, 'n_orgs')} as orgs, list_filter(string_split(lower(title), ' '), lambda w: length(w) > 4 and w not in ('about', 'these', 'their', 'there', 'which', 'where')) as words from ({FACTS_OF})),
        p as (select *, {by('persons', findings.PERSON_ENDS)} as pq, {by('orgs', findings.ORG_ENDS)} as oq from f),
        n as (select *, case when mode = 'person_target' then pq || {partner} when mode = 'organization_target' then oq || {board} when mode in ('funding_target', 'government_agency_target') then oq || pq else pq || oq end as named from p),
        x as (select *, case when len(words) >= 2 and len(named) < 5 then [array_to_string(words[1:3], ' ') || ' audit OR "inspector general" OR oversight'] else [] end as extra from n),
        t as (select *, named || extra || case when intent = 'crime_corruption' and len(named) + len(extra) < 5 then [array_to_string(words[1:2], ' ') || ' bribery OR kickback OR embezzlement OR fraud'] when intent = 'finance_funding' and len(named) + len(extra) < 5 then [array_to_string(words[1:2], ' ') || ' "no-bid contract" OR "sole source" OR procurement fraud'] else [] end as every from x)
        select case_id, array_to_string(list_filter(every, lambda v, i: list_position(every, v) = i)[1:6], ' / ') as queries from t"""


FOUND_RESULTS = """select o_orderkey as id, concat(split_part('Top 10 things,Harbor council audit,Watch: game,How to cook', ',', cast(o_custkey % 4 as int) + 1), ' of the county') as title, concat(repeat('A budget report for the housing program. ', cast(o_custkey % 7 as int)), 'end') as snippet,
    split_part('county.gov,tmz.com,apnews.com,laist.com', ',', cast(o_orderkey % 4 as int) + 1) as domain, split_part('pdf,web', ',', cast(o_orderkey % 2 as int) + 1) as kind, split_part('harbor council,los angeles audit', ',', cast(o_custkey % 2 as int) + 1) as query from {orders}"""


def _results_sql():
    t, sn, dm, q = "lower(title)", "lower(snippet)", "lower(domain)", "lower(query)"
    kw = _list(relevance.RESULT_WORDS)
    return f"""with r as ({FOUND_RESULTS}), w as (select *, list_filter(string_split({q}, ' '), lambda x: length(x) > 3) as ws from r), c as (select *, len(list_filter(ws, lambda x: contains({t}, x))) as tm, len(list_filter(ws, lambda x: contains({sn}, x))) as sm, {_any(q, relevance.LA_WORDS)} as la from w)
        select id, round(case when {' or '.join(f"regexp_matches({t}, '{p}')" for p in relevance.JUNK_TITLES)} then -3.0::double else 0 end + case when contains({t}, {q}) then 8 else 0 end + 2.5::double * tm + 0.8::double * sm + case when len(ws) >= 2 and tm = len(ws) then 4 else 0 end
            + case when la and ({_any(t, relevance.LA_WORDS)} or {_any(sn, relevance.LA_WORDS)}) then 2 else 0 end + case when la and {_any(dm, relevance.LA_HOSTS)} then 3 else 0 end + 1.5::double * {_hits(t, kw)} + 0.5::double * len(list_filter({kw}, lambda x: not contains({t}, x) and contains({sn}, x))) + case when kind = 'pdf' then 2 else 0 end
            + case when {_any(dm, relevance.RESULT_HOSTS)} then 3 else 0 end - case when {_any(dm, relevance.LIFESTYLE)} or {_any(t, relevance.LIFESTYLE)} then 10 else 0 end + case when length(snippet) > 200 then 1.0::double when length(snippet) > 100 then 0.4::double else 0 end - case when length(snippet) < 50 then 2 else 0 end, 4) as score from c"""


NOUNS = "select document_id % 50 as case_id, sentence from {sentences}"
OPEN = "select id as case_id from {cases} where id % 3 <> 0"

# Pages of which some lead elsewhere or ask for cookies.
WRAPPED = "select page_id, case when page_id % 7 = 0 then 'https://feedproxy.google.com/a' else url end as url, case page_id % 5 when 0 then concat('<title>Google News</title>', html) when 1 then concat('<p>We use cookies to help</p>', html) when 2 then concat('<p>Subscribe to continue</p>', html) else html end as html from {pages}"


def _counters_sql():
    has = lambda c, *x: f"count(*) filter ({c} in {_in(x)})"
    return f"""with news as ({_news_sql()}), of_case as ({NEWS}), {RULED}, {DECIDED},
        d as (select case_id, count(*) as documents, count(*) filter (n.id % 3 = 0) as failed, {has('priority', 'PRIORITY_A')} as priority_a, {has('priority', 'PRIORITY_B')} as priority_b, {has('priority', 'LOW_SIGNAL')} as low_signal, {has('priority', 'NOISE')} as noise,
            {has('tier', 'CORE')} as core_documents, {has('tier', 'RELEVANT')} as relevant_documents, {has('tier', 'CONTAMINATED')} as contaminated_documents from news n join (select id, case_id from of_case) o using (id) group by 1),
        r as (select case_id, {REASON} as why from ruled), m as (select case_id, count(*) as detected, count(*) filter (why is null) as admitted, count(*) filter (why is not null) as rejected, {has('why', 'ARTIFACT', 'ARTIFACT_ENTITY')} as artifact_rejected, {has('why', 'ARTIFACT_ENTITY')} as shape_rejected, {has('why', 'NAV_RESIDUE')} as nav_rejected from r group by 1),
        w as (select case_id, n_documents, case when is_promoted then 'promoted' when is_extra then 'supplemental' when is_late then 'fallback' when not {NOISE} and trust >= 0.62::double and role_weight >= 3 then 'held' else 'rejected' end as decision from lasts),
        e as (select case_id, {has('decision', 'promoted', 'supplemental', 'fallback')} as promoted, {has('decision', 'supplemental')} as supplemental, {has('decision', 'fallback')} as fallback, {has('decision', 'held')} as held, {has('decision', 'rejected')} as suppressed,
            coalesce(max(case when decision in ('promoted', 'supplemental', 'fallback') then n_documents end), 0) as main_support from w group by 1)
        select case_id, {', '.join(f'coalesce({x}, 0) as {x}' for x in COUNTERS)} from d full join m using (case_id) full join e using (case_id)"""


COUNTERS = "documents failed priority_a priority_b low_signal noise core_documents relevant_documents contaminated_documents detected admitted rejected artifact_rejected shape_rejected nav_rejected promoted supplemental fallback held suppressed main_support".split()

# The ends of first queries by mode, as their source lists them; an empty one is the target itself.
SEED_SQL = """when 'person_target' then ['', 'investigation', 'lawsuit', 'contract', 'funding', 'records', 'donations', 'payments', 'PAC', 'nonprofit', 'board', 'indictment', 'settlement', 'subpoena']
    when 'organization_target' then ['', 'contract', 'budget', 'audit', 'lawsuit', 'oversight', 'procurement', 'funding', 'grants', 'scandal', 'federal investigation', 'whistleblower', 'report']
    when 'government_agency_target' then ['', 'contract', 'budget', 'audit', 'lawsuit', 'oversight', 'procurement', 'funding', 'grants', 'scandal', 'federal investigation', 'whistleblower', 'report']
    when 'funding_target' then ['funding', 'spending', 'contract', 'grant', 'budget', 'appropriation', 'audit', 'procurement', 'misuse', 'oversight', 'fraud', 'payments']
    when 'scandal_target' then ['investigation', 'records', 'deposition', 'affidavit', 'indictment', 'complaint', 'audit', 'report', 'court filing', 'whistleblower', 'internal review', 'oversight']
    when 'program_target' then ['', 'budget', 'contracts', 'audit', 'oversight', 'funding', 'procurement', 'accountability', 'report', 'grant', 'investigation']
    when 'place_target' then ['', 'contracts', 'budget', 'corruption', 'audit', 'investigation', 'funding', 'officials', 'procurement', 'misconduct']
    when 'event_target' then ['', 'investigation', 'report', 'records', 'accountability', 'documents', 'officials', 'oversight', 'timeline']"""

PLANS = {
    "mention_roles": (
        lambda s, d: _ruled(s, d).select("id", "kind", F.col("r.role").alias("role")),
        f"with {RULED} select id, kind, role from ruled",
    ),
    "mention_topics": (
        lambda s, d: _ruled(s, d).select("id", "topic"),
        f"with {RULED} select id, topic from ruled",
    ),
    "reject_reasons": (_reasons, f"with {RULED} select id, case_id, {REASON} as reject_reason from ruled"),
    "listed_reasons": (_listed_reasons, f"with listed as ({LISTED}), {RULED} select id, case_id, {LISTED_REASON} as reject_reason from ruled"),
    "reject_histogram": (
        lambda s, d: extraction.reject_histogram(_reasons(s, d)),
        f"with {RULED}, reasons as (select case_id, {REASON} as reject_reason from ruled), n as (select case_id, reject_reason, count(*) as n from reasons where reject_reason is not null group by 1, 2) select case_id, reject_reason, n, cast(rank as integer) as rank from (select *, row_number() over (partition by case_id order by n desc, reject_reason) as rank from n) where rank <= 5",
    ),
    "admitted_mentions": (lambda s, d: _mentioned(s, d).filter("reject_reason is null").drop("context"), None),
    "screened_mentions": (lambda s, d: _mentioned(s, d, _view(s, d, LISTED, "entities")).drop("context"), None),
    "party_signals": (
        lambda s, d: _signals(s, d).select("document_id", "pos", "amount_display", "normalized_amount", "signal_type", "entity_name", "controlled_by", "received_by", "program_name", "financial_confidence"),
        f"with {PARTIES} select document_id, pos, amount_display, amount as normalized_amount, signal_type, entity_name, controlled_by, received_by, program_name, financial_confidence from signals",
    ),
    "loaded_signals": (
        lambda s, d: extraction.loaded(_signals(s, d), "ingest").select("document_id", "pos", "amount_display"),
        f"with {PARTIES} select document_id, pos, amount_display from signals where financial_confidence >= 0.55::double",
    ),
    "non_numeric_signals": (
        lambda s, d: _non_numeric(s, d).select("document_id", "pos", "signal_type", "event_summary", "entity_name", "controlled_by", "received_by", "program_name", "financial_confidence"),
        f"""with {NO_AMOUNT} select document_id, pos, 'NON_NUMERIC_' || kind as signal_type, event_summary, entity_name, {AFTER(parties.CONTROL)} as controlled_by, {AFTER(parties.RECEIVE)} as received_by, nullif(trim(regexp_extract(sentence, '{parties.PROGRAM}', 1)), '') as program_name,
            least(0.5::double, round(0.20::double + case when hits >= 2 then 0.20::double when hits = 1 then 0.10::double else 0 end + case when entity_name is not null then 0.10::double else 0 end, 2)) as financial_confidence from few""",
    ),
    "blocked_documents": (
        lambda s, d: _fetched(s, d).select("id", pages.is_blocked_for_analysis(F.col("raw_text")).alias("analysis"), pages.is_blocked_for_backfill(F.col("raw_text")).alias("backfill"), pages.is_purged(F.col("raw_text")).alias("purge"), pages.is_usable(F.col("raw_text")).alias("usable")),
        f"""with f as ({FETCHED}) select id, {_has(RAW, '[WRAPPER_BLOCKED]', '[EXTRACTION_FAILED]', '[FETCH_FAILED]', '[INVALID_CONTENT]')} or length(trim({RAW})) < 10 or length({BODY}) < 10 as analysis,
            {_has(RAW, '[WRAPPER_BLOCKED]', '[FETCH_FAILED]')} or (contains({RAW}, '[DIAG:') and {_has(RAW, 'status=failed', 'status=wrapper')}) or length(trim({RAW})) < 100 or length({BODY}) < 100 as backfill,
            {_has(RAW, '[WRAPPER_BLOCKED]', '[FETCH_FAILED]')} or (contains({RAW}, 'status=failed') and not {_has(RAW, 'status=ok', 'status=partial')}) as purge,
            case when contains({RAW}, '[DIAG:') then not {_has(RAW, 'status=failed', 'status=wrapper', 'priority=NOISE')} else length({RAW}) > 100 end as usable from f""",
    ),
    "source_tiers": (
        lambda s, d: _fetched(s, d).select("id", pages.credibility(F.col("domain"), F.col("raw_text"), F.col("id") % 2 == 0).alias("tier")),
        f"""with f as ({FETCHED}) select id, case when domain = '' and id % 2 <> 0 then null when regexp_matches({HOST}, '[.]gov$|[.]ca[.]gov|[.]state[.]|congress[.]|senate[.]gov|house[.]gov') then 'GOV' when {_any(HOST, pages.LEGAL)} then 'LEGAL' when {_any(HOST, pages.QUALITY_NEWS)} then 'QUALITY-NEWS'
            when {_any(HOST, pages.LOCAL_NEWS)} then 'LOCAL-NEWS' when {_any(HOST, pages.PR_HOSTS)} or {_any("lower(substring(coalesce(raw_text, ''), 1, 400))", pages.PR_PHRASES)} then 'PR-WIRE' when {_any(HOST, pages.LOW_SOURCES)} then 'LOW-SRC' else 'BLOG' end as tier from f""",
    ),
    "document_signals": (
        lambda s, d: _fetched(s, d).select("id", pages.signal(F.coalesce("raw_text", F.lit("")), F.col("n_entities")).alias("signal")),
        f"""with f as ({FETCHED}), n as (select id, n_entities, substring({RAW}, 1, 5000) as t from f), c as (select id, least(3, len(regexp_extract_all(t, '(?i){pages.FINANCIAL}'))) + least(3, 2 * len(regexp_extract_all(t, '(?i){pages.INVESTIGATIVE}'))) + least(2, len(regexp_extract_all(t, '(?i){pages.CONTEXT}')))
            + case when length(t) > 3000 then 1 else 0 end + case when n_entities >= 5 then 2 when n_entities >= 2 then 1 else 0 end as score from n) select id, case when score >= 7 then 'HIGH' when score >= 3 then 'MEDIUM' else 'LOW' end as signal from c""",
    ),
    "text_faults": (
        lambda s, d: _text_view(s, d, BODIES).select("id", pages.is_boilerplate(F.col("text")).alias("boilerplate"), pages.is_menu(F.col("text")).alias("menu"), pages.paragraphs(F.col("text")).alias("paragraphs"), pages.extraction_status(F.col("text"), F.lit(50)).alias("status")),
        f"""with b as ({BODIES}), n as (select *, lower(text) as low, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as lines, len(list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: trim(x)), lambda x: length(x) > 15)) as said,
                len(list_filter(list_transform(string_split_regex(text, '\\n\\n+'), lambda x: trim(x)), lambda x: length(x) >= 80 and regexp_matches(x, '[.!?]') and not {_any('lower(x)', pages.BOILERPLATE)})) as paragraphs from b),
            f as (select *, {_any('low', pages.HARD)} or {_hits('low', _list(pages.BOILERPLATE))} >= 2 as boilerplate, {_hits('low', _list(pages.MENU))} as found from n),
            m as (select *, (found >= 4 and length(text) < 1500) or found * 500 > length(text) * 3 or (len(lines) > 5 and len(list_filter(lines, lambda x: length(x) < 40)) > 0.6::double * len(lines)) or (length(text) > 400 and said < 2) as menu from f)
            select id, boilerplate, menu, cast(paragraphs as integer) as paragraphs, case when length(text) < 500 or not regexp_matches(text, '[A-Z][^.!?]{{40,}}[.!?]') or boilerplate or menu then 'invalid' when paragraphs >= 2 and length(text) >= 800 then 'valid' else 'partial' end as status from m""",
    ),
    "article_texts": (lambda s, d: articles.articles(load(s, d, "pages")), None),
    "result_scores": (
        lambda s, d: _view(s, d, FOUND_RESULTS, "orders").select("id", F.round(relevance.result_score(*[F.col(c) for c in ("title", "snippet", "domain", "kind", "query")]), 4).alias("score")),
        _results_sql(),
    ),
    "seed_counters": (
        lambda s, d: promotion.seed_counters(_news(s, d).select("case_id", "relevance.priority", "relevance.tier", (F.col("id") % 3 == 0).alias("failed")), _reasons(s, d), _decided(s, d)),
        _counters_sql(),
    ),
    "wrapper_pages": (
        lambda s, d: _view(s, d, WRAPPED, "pages").select("page_id", pages.is_wrapper(F.col("html"), F.col("url"), text.plain_text(F.col("html"))).alias("wrapper")),
        f"""with w as ({WRAPPED}), p as (select page_id, url, html, lower(substring(html, 1, 3000)) as head, {PLAIN_TEXT} as text from w)
            select page_id, contains(lower(url), 'news.google.com') or contains(lower(url), 'google.com/search') or contains(lower(url), 'accounts.google.com') or contains(lower(url), 'feedproxy.google.com')
                or contains(head, '<!doctype html>google') or contains(head, '<title>google news</title>') or (contains(head, 'news.google.com/articles') and length(html) < 10000)
                or (length(html) < 8000 and (regexp_matches(html, '(?i)accept.*cookies.*and.*continue') or regexp_matches(html, '(?i)before you continue to google') or regexp_matches(html, '(?i)we use cookies to')))
                or length(trim(text)) < 120 or (length(text) < 300 and (contains(lower(text), 'google news') or contains(lower(text), 'sign in to continue') or contains(lower(text), 'subscribe to continue') or contains(lower(text), 'enable javascript'))) as wrapper from p""",
    ),
    "document_relevance": (
        lambda s, d: _news(s, d).select("id", *[F.col(f"relevance.{c}").alias(c) for c in ("score", "priority", "tier", "anchor_score", "fit", "topic")]),
        _news_sql(),
    ),
    "cluster_trust": (
        lambda s, d: _decided(s, d).select("case_id", "cluster", "display_name", "type", "n_documents", "trust", "pass"),
        f"with {FEATURES}, cases as (select case_id, intent from ({CASES})) select w.case_id, cluster, display_name, type, n_documents, {TRUST} as trust, {PASS} as pass from weighed w join cases c using (case_id)",
    ),
    "promotions": (
        lambda s, d: _decided(s, d).select("case_id", "cluster", "decision"),
        f"with {DECIDED} select case_id, cluster, case when is_promoted then 'promoted' when is_extra then 'supplemental' when is_late then 'fallback' when not {NOISE} and trust >= 0.62::double and role_weight >= 3 then 'held' else 'rejected' end as decision from lasts",
    ),
    "recovered_nouns": (
        lambda s, d: promotion.recovered_nouns(_view(s, d, NOUNS, "sentences"), s.sql(OPEN, cases=load(s, d, "cases"))),
        f"""with open as ({OPEN}), said as (select * from ({NOUNS}) where case_id not in (select case_id from open)), nouns as (select case_id, regexp_matches(sentence, '{promotion.NEAR_FUNDS}') as near, unnest(regexp_extract_all(sentence, '\\b([A-Z][a-z]{{2,}}(?:\\s+[A-Z][a-z]{{2,}}){{0,3}})\\b', 1)) as noun from said),
            n as (select case_id, noun, count(*) as n, bool_or(near) as near from nouns where noun not in {_in(promotion.NO_NOUNS)} group by 1, 2), r as (select *, cast(n + case when near then 5 else 0 end as integer) as score from n where n >= 2 or near)
            select case_id, cast(rank as integer) as rank, noun, case when regexp_matches(noun, '{rules.INSTITUTION}') then 'organization' else 'person' end as type, score from (select *, row_number() over (partition by case_id order by score desc, noun) as rank from r) where rank <= 4""",
    ),
    "recovery_needs": (
        lambda s, d: promotion.recovery_need(_view(s, d, CASES, "orders")).select("case_id", "start_quality", "needs_recovery", "recovery_reason"),
        f"""with c as ({CASES}), q as (select *, case when n_promoted >= 2 and n_usable >= 2 then 'adequate' when n_promoted >= 1 then 'weak' else 'failed' end as start_quality from c), n as (select *, {SER} and (n_promoted < 3 or start_quality = 'failed') and n_documents < 12 as needs_recovery from q)
            select case_id, start_quality, needs_recovery, case when not needs_recovery then null when n_promoted < 1 then 'zero_promoted' when n_promoted < 3 then 'thin_graph' else 'weak_quality' end as recovery_reason from n""",
    ),
    "case_findings": (
        lambda s, d: _facts(s, d).select("case_id", *[F.array_join(x, ",").alias(n) for n, x in (("gaps", findings.gaps()), ("findings", findings.findings()), ("angles", findings.angles()), ("actions", findings.actions(F.col("quality"))))]),
        f"with f as ({FACTS_OF}) select case_id, array_to_string({GAPS}, ',') as gaps, array_to_string({FOUND}, ',') as findings, array_to_string(({ANGLES})[1:5], ',') as angles, case when quality = 'EMPTY' then 'RUN_INGEST,START_OFFICIAL' else array_to_string(({DO})[1:6], ',') end as actions from f",
    ),
    "next_queries": (lambda s, d: _facts(s, d).select("case_id", F.array_join(findings.next_queries(F.col("title")), " / ").alias("queries")), _next_sql()),
    "seed_queries": (
        lambda s, d: _facts(s, d).select("case_id", F.posexplode(findings.seed_queries(F.col("title"), F.col("mode"), F.col("intent"))).alias("pos", "query")).groupBy("case_id").agg(F.count("*").alias("n"), F.max("query").alias("last_query"), F.array_join(F.array_sort(F.collect_list("query")), " / ").alias("queries")),
        f"""with f as (select *, case when mode in ('person_target', 'organization_target', 'government_agency_target') then '"' || title || '"' else title end as base from ({FACTS_OF})),
            q as (select case_id, list_distinct(list_transform(case mode {SEED_SQL} else ['', 'investigation', 'contracts', 'funding'] || case intent when 'housing_homelessness' then ['shelter contracts', 'housing funding', 'program audit', 'accountability'] when 'finance_funding' then ['grant award', 'budget allocation', 'procurement']
                when 'crime_corruption' then ['indictment', 'fraud audit', 'corruption charges'] else ['program'] end end, lambda e: trim(base || ' ' || e))) as queries from f), e as (select case_id, unnest(queries) as query from q)
            select case_id, count(*) as n, max(query) as last_query, string_agg(query, ' / ' order by query) as queries from e group by 1""",
    ),
    "top_documents": (
        lambda s, d: overview.top_documents(load(s, d, "files").withColumn("score", F.col("id") % 97), "score"),
        "select case_id, cast(rank as integer) as rank, id, title from (select *, row_number() over (partition by case_id order by id % 97 desc, id) as rank from {files} where title <> '') where rank <= 10",
    ),
    "overview_documents": (
        lambda s, d: overview.overview_documents(load(s, d, "files")),
        "with s as (select id, case_id, coalesce(try_cast(nullif(regexp_extract(raw_text, 'score=(\\d+)', 1), '') as integer), 0) as score from {files}) select case_id, cast(rank as integer) as rank, id, score from (select *, row_number() over (partition by case_id order by score desc, id) as rank from s) where rank <= 8",
    ),
    "latest_events": (
        lambda s, d: overview.latest_events(load(s, d, "timeline")),
        "select case_id, cast(rank as integer) as rank, id, event_date from (select *, row_number() over (partition by case_id order by event_date desc, id) as rank from {timeline} where event_date is not null) where rank <= 5",
    ),
    "case_overview": (
        lambda s, d: overview.ratings(load(s, d, "cases"), load(s, d, "entities"), load(s, d, "files")),
        """with u as (select case_id, count(*) filter (case when contains(raw_text, '[DIAG:') then not (contains(raw_text, 'status=failed') or contains(raw_text, 'status=wrapper') or contains(raw_text, 'priority=NOISE')) else length(raw_text) > 100 end) as n from {files} group by 1), e as (select case_id, count(*) as n from {entities} group by 1)
            select c.id, coalesce(e.n, 0) as n_entities, coalesce(u.n, 0) as n_usable, case when coalesce(e.n, 0) >= 3 and coalesce(u.n, 0) >= 3 then 'STRONG BUILD' when coalesce(e.n, 0) >= 1 and coalesce(u.n, 0) >= 1 then 'MODERATE BUILD' when coalesce(u.n, 0) >= 1 then 'LOW CONFIDENCE' else 'EMPTY CASE' end as rating from {cases} c left join u on u.case_id = c.id left join e on e.case_id = c.id""",
    ),
    "valid_seeds": (
        lambda s, d: _view(s, d, "select o_orderkey as id, split_part('a,ab,12345,Harbor Council,a b,x1,!!,City', ',', cast(o_orderkey % 8 as int) + 1) as target from {orders}", "orders").select("id", pages.is_seed(F.col("target")).alias("valid")),
        "select o_orderkey as id, o_orderkey % 8 in (3, 7) as valid from {orders}",
    ),
    "build_qualities": (
        lambda s, d: promotion.build_quality(_view(s, d, CASES, "orders")).select("case_id", "build_status", "rating", "quality"),
        f"""with c as ({CASES}), k as (select case_id, case when n_promoted >= 3 and main_support >= 2 and not recovered then 1 when n_promoted = 2 and not recovered then 2 when recovered and n_promoted >= 2 then 3 when n_promoted >= 1 and n_usable >= 2 then 4 when n_detected > 0 and n_usable >= 1 then 5 when n_usable > 0 then 6 else 7 end as k from c)
            select case_id, (['summarized', 'graphed', 'graphed', 'graphed', 'analyzed', 'ingested', 'failed'])[k] as build_status, (['STRONG BUILD', 'PROVISIONAL BUILD', 'RECOVERED BUILD', 'WEAK BUILD', 'DEGRADED BUILD', 'LOW CONFIDENCE', 'EMPTY CASE'])[k] as rating, (['STRONG', 'PROVISIONAL', 'RECOVERED', 'WEAK', 'WEAK', 'WEAK', 'FAILED'])[k] as quality from k""",
    ),
}
