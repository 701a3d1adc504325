"""Queries over whole documents, targets, results and mentions."""

from pyspark.sql import functions as F

from casework.functions import documents, targets, text
from casework.operators import feed, mentions
from casework.sources.views import VIEWS, load
from casework.tables import dealt

# Documents with lines of share rails, clocks and headlines between their own.
NOISY = "select doc_id, concat(case doc_id % 4 when 0 then concat('Share', chr(10), 'Read more', chr(10)) when 1 then concat('10:30 am', chr(10), 'Sponsored content', chr(10), 'Facebook Twitter Email share', chr(10)) when 2 then concat('Top stories', chr(10), 'The Quick Brown Fox Jumps', chr(10), 'Close', chr(10)) else '' end, text) as text from {documents}"
LINE_JUNK = "|".join(documents.BOILERPLATE_LINES)
HITS = " + ".join(f"cast(contains(low, '{w}') as integer)" for w in documents.SHARE_WORDS)
CLEANED = f"""noisy as ({NOISY}), lines as (select doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) as k, unnest(string_split(text, chr(10))) as line from noisy),
    marked as (select *, lower(trim(line)) as low from lines), kept as (select *, not (regexp_matches(low, '{LINE_JUNK}') or {HITS} >= 3 or (length(low) <= 25 and regexp_matches(low, '{documents.BUTTONS}'))) as keep from marked),
    cleaned as (select doc_id, any_value(text) as text, count(*) filter (not keep) as removed, regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) order by k) filter (keep), ''), '\\n\\n\\n+', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as body from kept group by doc_id)"""
TARGET = "concat(split_part('Audit of,Budget for,Office of,Friends of,Harbor', ',', cast(o_custkey % 5 as int) + 1), ' ', split_part('Housing Vouchers,City Council,Metro Trust Holdings,Jordan Petrov,State Election,Springfield', ',', cast(o_orderkey % 6 as int) + 1))"
TARGETS = f"select o_orderkey as id, case when o_orderkey % 7 = 0 then 'Jordan Petrov' when o_orderkey % 7 = 1 then 'Springfield, IL' else {TARGET} end as target from {{orders}}"
RESULTS = "select o * 8 + n as seq, o % 50 as case_id, concat('https://www.', split_part('a.gov,b.com,c.org,d.net', ',', cast(p % 4 as int) + 1), '/p/', cast(p % 90 as string)) as url, cast(q % 12 - 4 as double) as score from {lines}"


def _view(spark, d, sql, name):
    """A one-off view, from SQL that both engines run."""
    return spark.sql(sql, **{name: load(spark, d, name)})


def _dealt_view(spark, d, sql, name):
    """A one-off view whose rows are much larger than the table's: the narrow rows are dealt to all cores first, as a small file is one task."""
    return spark.sql(sql, **{name: dealt(load(spark, d, name))})


def _text_view(spark, d, sql):
    """A view of documents; a null text adds nothing to a concat, as in DuckDB."""
    return spark.sql(sql.replace("chr(10)", "char(10)"), documents=load(spark, d, "documents").fillna("", ["text"]))


def _cleaned(s, d):
    return _text_view(s, d, NOISY).withColumn("c", documents.cleaned(F.col("text")))


def _bodies(s, d):
    # lines meet by their document: they and their sentences are grouped where they are
    lines = s.sql(VIEWS["lines"], lineitem=load(s, d, "lineitem").repartition("l_orderkey"))
    return s.sql(VIEWS["sentences"], lines=lines).groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x.sentence), "\n").alias("text")).withColumn("case_id", F.col("document_id") % 50)


def _named(s, d):
    return s.sql(NAMED, mentions=load(s, d, "mentions"))


def _clusters(s, d):
    return mentions.clusters(_named(s, d).select("case_id", "entity_name", "id"))


def _case(rules):
    return " ".join(f"when regexp_matches(lower(target), '{p}') then '{v}'" for p, v in rules)


# Names of which some hold others; the greedy clusters, name by name with the heads so far.
NAMED = "select id, case_id, document_id, case when id % 7 = 0 then concat('Greater ', entity_name) when id % 11 = 0 then split_part(entity_name, ' ', 1) else entity_name end as entity_name, entity_type, confidence, zone from {mentions}"
CLUSTERS = f"""recursive named as ({NAMED}), keys as (select case_id, lower(trim(entity_name)) as name_key, min(id) as first_id from named group by 1, 2), n as (select *, row_number() over (partition by case_id order by first_id) as k from keys),
    r as (select case_id, 0::bigint as k, []::varchar[] as heads, '' as name_key, '' as cluster from n where k = 1
        union all select case_id, k, case when head is null then list_append(heads, name_key) else heads end, name_key, coalesce(head, name_key) from (
            select n.case_id, n.k, r.heads, n.name_key, list_filter(r.heads, lambda h: (contains(h, n.name_key) or contains(n.name_key, h)) and least(length(h), length(n.name_key)) >= 4)[1] as head from r join n on n.case_id = r.case_id and n.k = r.k + 1) x),
    clusters as (select case_id, name_key, cluster from r where k > 0)"""

# Fixed values of the density rule, as its source lists them.
STOCK = """['sign up for our newsletter', 'subscribe to our newsletter', 'click here to subscribe', 'sign in to continue', 'sign in to read', 'sign in to access', 'log in to continue', 'create a free account', 'buy a subscription', 'subscribe to continue', 'subscribe to read', 'subscribe to access',
    'become a member', 'unlock full access', 'already a subscriber', 'subscription required', 'follow us on', 'share this article', 'download the app', 'get the app', 'click here', 'read more', 'related articles', 'more stories', 'most popular', 'trending now', 'you may also like',
    'recommended for you', 'also read', 'terms of service', 'privacy policy', 'all rights reserved', 'javascript is required', 'enable javascript', 'please enable', 'cookie policy', 'we use cookies', 'your subscription', 'newsletter signup', 'advertisement', 'sponsored content']"""
WALLS = "['sign in to continue', 'sign in to read', 'subscribe to continue', 'subscribe to read', 'subscription required', 'unlock full access', 'create a free account to read', 'before you continue to google', 'enable javascript to continue', 'javascript is required to view']"
MENUS = "['sign in', 'log in', 'subscribe', 'newsletter', 'advertisement', 'related articles', 'click here', 'read more', 'most popular', 'trending', 'you may also like', 'follow us', 'download the app', 'share on', 'copy link', 'copied!', 'email this']"

# tags to spaces, character references decoded, as text.plain_text says
PLAIN_TEXT = "html"
for _what, _to in (("'<[^>]*>'", "' '"),):
    PLAIN_TEXT = f"regexp_replace({PLAIN_TEXT}, {_what}, {_to}, 'g')"
for _what, _to in (("'&lt;'", "'<'"), ("'&gt;'", "'>'"), ("'&quot;'", "chr(34)"), ("'&#39;'", "chr(39)"), ("'&apos;'", "chr(39)"), ("'&nbsp;'", "' '")):
    PLAIN_TEXT = f"replace({PLAIN_TEXT}, {_what}, {_to})"
PLAIN_TEXT = f"trim(regexp_replace(replace(regexp_replace(replace(regexp_replace({PLAIN_TEXT}, '&#x?[0-9a-fA-F]+;', '', 'g'), '&amp;', chr(1)), '&[a-zA-Z]+;', ' ', 'g'), chr(1), '&'), '\\s+', ' ', 'g'))"

PLANS = {
    "cleaned_bodies": (
        lambda s, d: _cleaned(s, d).select("doc_id", F.md5(F.col("c.cleaned")).alias("body_md5"), F.col("c.raw_chars").cast("long").alias("raw_chars"), F.col("c.cleaned_chars").cast("long").alias("cleaned_chars"), F.col("c.removed_lines").cast("long").alias("removed_lines"), "c.boilerplate_ratio"),
        f"with {CLEANED} select doc_id, md5(body) as body_md5, length(text) as raw_chars, length(body) as cleaned_chars, removed as removed_lines, round(case when length(text) > 0 then (length(text) - length(body)) / length(text) else 0 end, 4) as boilerplate_ratio from cleaned",
    ),
    "contamination": (
        lambda s, d: documents.contamination(_cleaned(s, d).select("doc_id", "text", F.col("c.boilerplate_ratio").alias("ratio")), "text", "ratio").select("doc_id", F.col("contamination_points").cast("int").alias("points"), "contamination"),
        f"""with {CLEANED}, own as (select doc_id, trim(line) as raw, lower(trim(line)) as low from lines where trim(line) <> ''),
            n as (select doc_id, count(*) as n, count(*) filter (regexp_matches(low, '{documents.MORE_STORIES}')) as more, count(*) filter (regexp_matches(low, '{documents.NAV_WORDS}') and length(raw) < 80) as nav, count(*) filter (regexp_matches(low, '{documents.CLOCK[0]}|{documents.CLOCK[1]}')) as clock,
                count(*) filter (regexp_matches(low, '{documents.PROMO}')) as promo, count(*) filter (length(raw) > 15 and length(raw) < 100 and regexp_matches(raw, '{documents.HEADLINE}')) as heads from own group by 1),
            r as (select c.doc_id, length(text) as size, round((length(text) - length(body)) / length(text), 4) as ratio, coalesce(n, 0) as n, coalesce(more, 0) as more, coalesce(nav, 0) as nav, coalesce(clock, 0) as clock, coalesce(promo, 0) as promo, coalesce(heads, 0) as heads from cleaned c left join n using (doc_id)),
            p as (select *, case when ratio > 0.45 then 3 when ratio > 0.25 then 2 when ratio > 0.12 then 1 else 0 end + case when nav > 0.15 * n then 3 when nav > 0.08 * n then 1 else 0 end + case when more > 0.05 * n then 2 else 0 end
                + case when more >= 3 then 2 else 0 end + case when promo >= 1 then 1 else 0 end + case when clock >= 5 then 1 else 0 end + case when heads >= 6 then 2 when heads >= 3 then 1 else 0 end as base from r),
            q as (select doc_id, cast(base + case when size < 2000 and base >= 3 then 2 else 0 end as integer) as points from p)
            select *, case when points >= 6 then 'high' when points >= 3 then 'med' else 'low' end as contamination from q""",
    ),
    "document_zones": (
        lambda s, d: load(s, d, "documents").select("doc_id", documents.zones(F.col("text")).alias("z")).select("doc_id", *[F.col(f"z.{c}").cast("long").alias(c) for c in ("title_end", "dek_end", "lead_end", "body_end", "sidebar_start")]),
        f"""with lines as (select doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) as k, unnest(string_split(text, chr(10))) as line from {{documents}}),
            placed as (select *, sum(length(line) + 1) over (partition by doc_id order by k) - length(line) - 1 as begins, length(trim(line)) > 40 as long_ from lines), ranked as (select *, sum(cast(long_ as integer)) over (partition by doc_id order by k) as n from placed),
            f as (select doc_id, any_value(length(text)) as size, min(begins + length(line)) filter (long_ and n = 1) as one, min(begins + length(line)) filter (long_ and n = 2) as two, min(begins + length(line)) filter (long_ and n = 4) as four, min(begins) filter (regexp_matches(lower(trim(line)), '{documents.SIDEBAR}')) as side from ranked group by 1)
            select doc_id, cast(coalesce(one, least(200, size)) as bigint) as title_end, cast(coalesce(two, least(coalesce(one, least(200, size)) + 300, size)) as bigint) as dek_end, cast(coalesce(four, floor(size * 0.35::double)) as bigint) as lead_end, cast(least(floor(size * 0.8::double), coalesce(side, size)) as bigint) as body_end, cast(coalesce(side, size) as bigint) as sidebar_start from f""",
    ),
    "content_density": (
        lambda s, d: load(s, d, "documents").select("doc_id", documents.density(F.col("text")).cast("int").alias("density")),
        rf"""with parts as (select doc_id, text, lower(text) as low, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 30) as said, list_filter(list_transform(string_split_regex(text, '\n\n+'), lambda x: trim(x)), lambda x: length(x) >= 80 and regexp_matches(x, '[.!?]') and len(list_filter({STOCK}, lambda w: contains(lower(x), w))) = 0) as paras,
                list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as lines, len(list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: trim(x)), lambda x: length(x) > 15)) as told from {{documents}}),
            n as (select *, length(text) as n, case when len(said) > 0 then list_sum(list_transform(said, lambda x: length(x))) / len(said) else 0 end as mean, len(regexp_extract_all(text, '(?i)\b\d{{4}}\b|\$[\d,.]+|\b\d+%|\b\d+\s+(?:million|billion|thousand)\b')) as numbers, len(list_filter({MENUS}, lambda w: contains(low, w))) as found from parts),
            p as (select *, case when n >= 2000 then 30 when n >= 1000 then 20 when n >= 600 then 12 when n >= 300 then 5 else 0 end + case when mean >= 80 then 30 when mean >= 50 then 20 when mean >= 30 then 10 else 0 end + least(20, len(paras) * 5) + least(10, numbers * 2)
                - case when len(list_filter({WALLS}, lambda w: contains(low, w))) > 0 or len(list_filter({STOCK}, lambda w: contains(low, w))) >= 2 then 40 else 0 end as points from n)
            select doc_id, cast(case when n < 50 then 0 else greatest(0, greatest(0, points) - case when (found >= 4 and n < 1500) or found * 500 > n * 3 or (len(lines) > 5 and len(list_filter(lines, lambda x: length(x) < 40)) > 0.6::double * len(lines)) or (n > 400 and told < 2) then 30 else 0 end) end as integer) as density from p""",
    ),
    "target_classes": (
        lambda s, d: _view(s, d, TARGETS, "orders").withColumn("m", targets.mode(F.col("target"))).select("id", targets.intent(F.col("target")).alias("intent"), "m.mode", "m.confidence"),
        f"""with t as ({TARGETS}) select id, case {_case(targets.INTENTS)} else 'general' end as intent, m.mode, cast(m.confidence as double) as confidence from (select *, case {' '.join(f"when regexp_matches(lower(target), '{p}') then struct_pack(mode := '{m}', confidence := {x})" for p, m, x in targets.MODES)}
            when regexp_matches(target, '{targets.PERSON}') and not regexp_matches(target, '{targets.NOT_PERSON}') then struct_pack(mode := 'person_target', confidence := 0.88) when regexp_matches(lower(target), '{targets.PLACE}') or regexp_matches(target, '^[A-Z][a-z]+,?\\s+[A-Z][A-Z]$') then struct_pack(mode := 'place_target', confidence := 0.78)
            when regexp_matches(lower(target), '{targets.EVENT}') then struct_pack(mode := 'event_target', confidence := 0.75) when len(string_split(target, ' ')) >= 3 then struct_pack(mode := 'topic_investigation', confidence := 0.60) else struct_pack(mode := 'general', confidence := 0.50) end as m from t)""",
    ),
    "anchor_words": (
        lambda s, d: _view(s, d, TARGETS, "orders").select("id", F.explode(targets.anchor_words(F.col("target"))).alias("word")),
        f"with t as ({TARGETS}), w as (select distinct id, unnest(regexp_split_to_array(lower(target), '[\\s,]+')) as word from t) select * from w where length(word) >= 3 and word not in ({', '.join(repr(x) for x in targets.STOP_WORDS)})",
    ),
    "chosen_results": (
        lambda s, d: feed.chosen(_view(s, d, RESULTS, "lines")).select("case_id", "rank", "seq", "url", "host", "score"),
        f"""with r as ({RESULTS}), one as (select *, regexp_extract(url, '://(?:www[.])?([^/]+)', 1) as host from (select *, row_number() over (partition by case_id, url order by seq) as rn from r) where rn = 1),
            few as (select * from (select *, row_number() over (partition by case_id, host order by seq) as hn from one) where hn <= 3 and score >= -2)
            select * from (select case_id, cast(row_number() over (partition by case_id order by score desc, seq) as integer) as rank, seq, url, host, score from few) where rank <= 12""",
    ),
    "document_mentions": (lambda s, d: mentions.mentions(_bodies(s, d)), None),
    "name_clusters": (lambda s, d: _clusters(s, d), f"with {CLUSTERS} select case_id, name_key, cluster from clusters"),
    "cluster_features": (
        lambda s, d: mentions.cluster_features(_named(s, d), _clusters(s, d)),
        f"""with {CLUSTERS}, m as (select n.*, c.cluster from named n join clusters c on c.case_id = n.case_id and c.name_key = lower(trim(n.entity_name))),
            f as (select case_id, cluster, count(distinct document_id) as n_documents, count(*) as n_mentions, max(confidence) as max_confidence, bool_or(zone in ('title', 'dek', 'lead')) as in_front, bool_or(entity_type = 'agency') as is_agency, min(id) as first_id from m group by 1, 2)
            select *, round(least(0.99::double, 0.3::double + 0.4::double * max_confidence + case when n_documents >= 3 then 0.2::double when n_documents >= 2 then 0.12::double else 0 end + case when in_front then 0.08::double else 0 end + case when is_agency then 0.05::double else 0 end), 4) as trust from f""",
    ),
    "plain_text_hosts": (
        lambda s, d: load(s, d, "pages").select("page_id", text.host(F.col("url")).alias("host"), (F.length(text.plain_text(F.col("html"))) < 900).alias("is_stub")),
        f"""select page_id, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\\.', '') as host, length({PLAIN_TEXT}) < 900 as is_stub from {{pages}}""",
    ),
}
