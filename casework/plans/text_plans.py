"""Queries over texts: markers, sentences, dates, amounts, pages."""

from pyspark.sql import functions as F

from casework.functions import text
from casework.operators import money, timeline
from casework.sources.views import load

MONTH = "(" + "|".join(text.MONTHS) + ")"
NUMBER = lambda m: f"list_position([{', '.join(repr(x.lower()) for x in text.MONTHS)}], lower(regexp_extract({m}, '^([A-Za-z]+)', 1)))"
MY, MD = f"regexp_extract(sentence, '\\b{MONTH}\\s+((?:20|19)\\d\\d)\\b', 0)", f"regexp_extract(sentence, '\\b{MONTH}\\s+\\d\\d?(?:,?\\s+\\d\\d\\d\\d)?', 0)"
DATED = f"""dated as (select *, case when my <> '' then make_date(cast(regexp_extract(my, '(\\d\\d\\d\\d)$', 1) as bigint), {NUMBER('my')}, 1)
        when md <> '' then make_date(coalesce(try_cast(regexp_extract(md, '(\\d\\d\\d\\d)$', 1) as bigint), 2001), {NUMBER('md')}, cast(regexp_extract(md, '^[A-Za-z]+\\s+(\\d\\d?)', 1) as bigint))
        when y <> '' then make_date(cast(y as bigint), 1, 1) end as event_date
    from (select *, {MY} as my, {MD} as md, regexp_extract(sentence, '\\b((?:20|19)\\d\\d)\\b', 1) as y from {{sentences}}))"""
WORDS = lambda rules, default: "case " + " ".join(f"when regexp_matches(lower(sentence), '{p}') then '{t}'" for p, t in rules) + f" else '{default}' end"
MONEY = text.AMOUNT.replace("{1,3}", "{1,3}")

ALL_EVENTS = f"""{DATED}, typed as (select *, substring(regexp_replace(trim(sentence), '\\s+', ' ', 'g'), 1, 200) as summary, {WORDS(text.EVENT_WORDS, 'EVENT')} as event_type, regexp_matches(lower(sentence), '{text.ACTION}') as acts from dated where event_date is not null),
    strict_one as (select * from (select *, row_number() over (partition by document_id, event_date, substring(summary, 1, 60) order by pos) as rn from typed where acts) where rn = 1),
    strict as (select *, row_number() over (partition by document_id order by pos) as place from strict_one qualify place <= 15),
    soft_one as (select * from (select *, row_number() over (partition by document_id, event_date, substring(summary, 1, 60) order by pos) as rn from typed where document_id not in (select document_id from strict) and (regexp_matches(sentence, '{timeline.PROPER_NOUN}') or regexp_matches(sentence, '{timeline.PROGRAM}'))) where rn = 1),
    soft as (select *, row_number() over (partition by document_id order by pos) as place from soft_one qualify place <= 8),
    all_events as (select document_id, pos, event_date, event_type, summary, false as soft_event from strict union all select document_id, pos, event_date, event_type, summary, true from soft)"""


def _events(s, d):
    e = load(s, d, "sentences").withColumns({"event_date": text.event_date(F.col("sentence")), "event_type": text.event_type(F.col("sentence"))})
    return e.filter(F.col("event_date").isNotNull() & F.lower("sentence").rlike(text.ACTION)).select("document_id", "pos", "event_date", "event_type")


def _money(s, d):
    m = load(s, d, "sentences").select("document_id", "pos", text.signal_type(F.col("sentence")).alias("signal_type"), F.posexplode(text.amounts(F.col("sentence"))).alias("k", "raw"))
    return m.select("document_id", "pos", "k", "raw", text.amount_value(F.col("raw")).alias("amount"), text.currency(F.col("raw")).alias("currency"), "signal_type").filter("amount >= 1000")


# Some events of sports and entertainment, by type or by words.
ODD_TYPE = "case when (document_id + pos) % 11 = 0 then 'Sports' else event_type end"
ODD_SUMMARY = "case when (document_id + pos) % 7 = 0 then concat('The box  office of the ', summary) when (document_id + pos) % 7 = 1 then concat('Seasons of ', summary) else summary end"


def _odd_events(s, d):
    return timeline.all_events(load(s, d, "sentences")).withColumns({"event_type": F.expr(ODD_TYPE), "summary": F.expr(ODD_SUMMARY)})


PLANS = {
    "diag_maps": (
        lambda s, d: load(s, d, "files").select("id", *[text.diag_map(F.col("raw_text"))[k].alias(k) for k in ("status", "score", "priority")]),
        "select id, nullif(regexp_extract(raw_text, '^\\[DIAG:(?:[^\\]]*\\|)?status=([^|\\]]*)', 1), '') as status, nullif(regexp_extract(raw_text, '^\\[DIAG:(?:[^\\]]*\\|)?score=([^|\\]]*)', 1), '') as score, nullif(regexp_extract(raw_text, '^\\[DIAG:(?:[^\\]]*\\|)?priority=([^|\\]]*)', 1), '') as priority from {files}",
    ),
    "diag_encoded": (
        lambda s, d: load(s, d, "files").select("id", text.diag_encode(id=F.col("id"), domain=F.col("source_domain"), date=F.col("publish_date")).alias("marker")),
        "select id, '[DIAG:' || concat_ws('|', 'id=' || id, 'domain=' || source_domain, 'date=' || cast(publish_date as varchar)) || ']' as marker from {files}",
    ),
    "stripped_bodies": (
        lambda s, d: load(s, d, "files").select("id", text.strip_markers(F.col("raw_text")).alias("body")),
        "select id, trim(regexp_replace(raw_text, '^\\s*\\[DIAG:[^\\]]*\\]\\s*', '')) as body from {files}",
    ),
    "page_hosts": (
        lambda s, d: load(s, d, "pages").groupBy(text.host(F.col("url")).alias("host")).agg(F.count("*").alias("n")),
        "select coalesce(nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\\.', ''), ''), 'unknown') as host, count(*) as n from {pages} group by 1",
    ),
    "page_plain_text": (
        lambda s, d: load(s, d, "pages").select("page_id", text.plain_text(F.col("html")).alias("body")),
        "select page_id, trim(regexp_replace(replace(regexp_replace(replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&apos;', chr(39)), '&nbsp;', ' '), '&#x?[0-9a-fA-F]+;', '', 'g'), '&amp;', chr(1)), '&[a-zA-Z]+;', ' ', 'g'), chr(1), '&'), '\\s+', ' ', 'g')) as body from {pages}",
    ),
    "name_keys": (
        lambda s, d: load(s, d, "entities").select("id", text.normalized_name(F.concat(F.lit("The "), F.col("name"), F.lit(", Inc."))).alias("name_key"), F.round(text.token_overlap(F.lower("name"), F.lit("harbor council group")), 4).alias("overlap")),
        "select id, lower(name) as name_key, round(coalesce(len(list_intersect(list_distinct(list_filter(string_split(lower(name), ' '), lambda w: length(w) > 2)), ['harbor', 'council', 'group'])) / greatest(len(list_distinct(list_filter(string_split(lower(name), ' '), lambda w: length(w) > 2))), 3), 0), 4) as overlap from {entities}",
    ),
    "sentence_counts": (
        lambda s, d: text.sentences(load(s, d, "documents").select("doc_id", "text"), "text").groupBy("doc_id").agg(F.count("*").alias("n")),
        "with pieces as (select doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+')) as s from {documents}) select doc_id, count(*) as n from pieces where length(trim(s)) > 20 group by 1",
    ),
    "capped_events": (
        lambda s, d: timeline.all_events(load(s, d, "sentences")).select("document_id", "pos", "event_date", "event_type", "soft_event"),
        f"""with {ALL_EVENTS} select document_id, pos, event_date, event_type, soft_event from all_events""",
    ),
    "windowed_events": (
        lambda s, d: timeline.in_year_window(timeline.all_events(load(s, d, "sentences")), load(s, d, "files")).select("document_id", "pos", "event_date"),
        f"with {ALL_EVENTS} select e.document_id, pos, event_date from all_events e left join {{files}} f on f.id = e.document_id where f.publish_date is null or abs(year(event_date) - year(f.publish_date)) <= 2",
    ),
    "event_titles": (
        lambda s, d: timeline.all_events(load(s, d, "sentences")).select("document_id", "pos", timeline.titled(F.col("event_type"), F.col("summary"), F.col("soft_event")).alias("title")),
        f"with {ALL_EVENTS} select document_id, pos, case when soft_event then '[SOFT][' || event_type || '] ' || substring(summary, 1, 110) else '[' || event_type || '] ' || substring(summary, 1, 120) end as title from all_events",
    ),
    "loaded_events": (
        lambda s, d: timeline.without_junk(_odd_events(s, d)).select("document_id", "pos", timeline.titled_plainly(F.col("event_type"), F.col("summary")).alias("title")),
        rf"""with {ALL_EVENTS}, odd as (select document_id, pos, {ODD_TYPE} as event_type, {ODD_SUMMARY} as summary from all_events)
            select document_id, pos, replace(event_type, '_', ' ') || ': ' || substring(summary, 1, 80) as title from odd where upper(event_type) not in ('SPORTS', 'ENTERTAINMENT', 'CELEBRITY', 'GAME')
            and not regexp_matches(summary, '(?i)\b(episode|season|recap|watch|documentary|film|movie|concert|game\s+result|match\s+result|tournament|playoff|bracket|stream\s+now|box\s+office)\b')""".replace("\\\\", "\\"),
    ),
    "sentence_signals": (
        lambda s, d: money.sentence_signals(load(s, d, "sentences")).select("document_id", "pos", "amount", "currency", "signal_type", "rank"),
        f"""with told as (select document_id, pos, {WORDS(text.SIGNAL_WORDS, 'FUNDING')} as signal_type, regexp_extract_all(sentence, '{MONEY}') as raws from {{sentences}} where regexp_matches(lower(sentence), '{money.FUNDING_GATE}') and not regexp_matches(lower(sentence), '{money.AD_COPY}')),
            each_ as (select document_id, pos, signal_type, unnest(range(len(raws))) as k, raws from told), valued as (select *, raws[k + 1] as raw from each_),
            v as (select document_id, pos, k, round(cast(replace(regexp_extract(raw, '[0-9][0-9,]*(?:\\.[0-9]+)?'), ',', '') as double) * case when raw ilike '%million' then 1000000 else 1 end, 2) as amount, 'USD' as currency, signal_type from valued),
            one as (select *, row_number() over (partition by document_id, amount, currency order by pos, k) as rn from v where amount >= 1000)
            select * from (select document_id, pos, amount, currency, signal_type, cast(row_number() over (partition by document_id order by pos, k) as integer) as rank from one where rn = 1) where rank <= 30""",
    ),
    "strict_events": (
        _events,
        f"with {DATED} select document_id, pos, event_date, {WORDS(text.EVENT_WORDS, 'EVENT')} as event_type from dated where event_date is not null and regexp_matches(lower(sentence), '{text.ACTION}')",
    ),
    "money_amounts": (
        _money,
        f"""with found as (select document_id, pos, {WORDS(text.SIGNAL_WORDS, 'FUNDING')} as signal_type, regexp_extract_all(sentence, '{MONEY}') as raws from {{sentences}}),
            each_ as (select document_id, pos, signal_type, unnest(range(len(raws))) as k, raws from found),
            valued as (select *, raws[k + 1] as raw from each_),
            v as (select document_id, pos, cast(k as integer) as k, raw, round(cast(replace(regexp_extract(raw, '[0-9][0-9,]*(?:\\.[0-9]+)?'), ',', '') as double) * case when raw ilike '%million' then 1000000 else 1 end, 2) as amount, case when raw like '%£%' then 'GBP' else 'USD' end as currency, signal_type from valued)
            select * from v where amount >= 1000""",
    ),
}
