"""Queries that look up names, titles and what belongs to them."""

from pyspark.sql import functions as F

from casework.operators import dossier, search, triage
from casework.plans.case_plans import LOCKED, _quality
from casework.plans.document_plans import _view
from casework.sources.views import load
from casework.streaming import summaries

# Beginnings, middles and ends of names in any case, short ones, and some that nothing has in it.
QUERIES = "select distinct upper(split_part(name, ' ', 1)) as query from {entities} union select distinct substring(name, 3, 6) from {entities} union select 'r' union select 'AN' union select 'zzz' union select 'order 1' union select ''"
FLOWS = "select id, case_id, case when id % 5 = 0 then id + 999999 else case_id * 100 + id % 100 end as source_entity_id, case when id % 7 = 0 then cast(null as bigint) else case_id * 100 + id % 90 end as destination_entity_id, normalized_amount as amount, case id % 3 when 0 then 'EUR' when 1 then '' end as currency from {signals}"
LINKED = "select id, case_id, event_date, title, case when id % 3 = 0 then cast(null as bigint) else case_id * 100 + id % 110 end as linked_entity_id, case when id % 4 = 0 then id + 77777777 else document_id end as document_id from {timeline}"


def _mention_view(s, d):
    files = load(s, d, "files").withColumn("from_web", F.col("id") % 3 == 0)
    return triage.mention_view(load(s, d, "mentions"), load(s, d, "cases").filter("id % 9 <> 4"), files, status="pending")


def _lists(s, d):
    out = dossier.profile_lists(load(s, d, "entities"), load(s, d, "mentions"), load(s, d, "files"), load(s, d, "timeline"), 4)
    of = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat(x[a].cast("string"), F.lit(":"), x[b].cast("string"))), ",")
    return out.select("id", of("documents", "document_id", "n_mentions").alias("documents"), of("events", "event_id", "event_date").alias("events"))


def _facts(s, d):
    out = dossier.profile_facts(dossier.locked(_quality(s, d)).join(load(s, d, "entities").select("id", "type"), "id"), load(s, d, "mentions"), load(s, d, "signals"), load(s, d, "relationships"))
    return out.withColumn("questions", F.array_join("questions", ","))


NAME_KEY = "lower(trim(entity_name))"
COUNTED = f"counted as (select e.id, m.document_id, count(*) as n_mentions from {{entities}} e join {{mentions}} m on m.case_id = e.case_id and {NAME_KEY} = lower(trim(e.name)) where m.document_id is not null group by 1, 2)"

PLANS = {
    "registry_search": (
        lambda s, d: search.registry_search(load(s, d, "entities"), load(s, d, "mentions"), _view(s, d, QUERIES, "entities")),
        f"""with q as ({QUERIES}), m as (select {NAME_KEY} as k, count(*) as n_mentions, count(distinct document_id) as n_documents from {{mentions}} where status = 'approved' group by 1),
            r as (select e.id, case_id, name, type, coalesce(n_mentions, 0) as n_mentions, coalesce(n_documents, 0) as n_documents from {{entities}} e left join m on m.k = lower(trim(e.name)))
            select query, cast(row_number() over (partition by query order by n_mentions desc, id) as integer) as rank, r.* from q join r on query <> '' and contains(lower(name), lower(query))""",
    ),
    "title_search": (
        lambda s, d: search.title_search(load(s, d, "files"), _view(s, d, QUERIES, "entities")),
        f"with q as ({QUERIES}) select query, id, case_id, title from q join {{files}} f on query <> '' and contains(lower(title), lower(query))",
    ),
    "mention_view": (
        _mention_view,
        """with f as (select id, title, case when source_domain = '' and id % 3 <> 0 then null when source_domain like '%.gov' then 'GOV' when source_domain = 'apnews.com' then 'QUALITY-NEWS' when source_domain = 'prnewswire.com' then 'PR-WIRE' else 'BLOG' end as tier from {files})
            select m.id, m.document_id, m.case_id, entity_name, confidence, m.status, c.title as case_title, c.id is not null as case_exists, f.title as document_title, f.tier as source_tier
            from {mentions} m left join (select * from {cases} where id % 9 <> 4) c on c.id = m.case_id left join f on f.id = m.document_id where m.status = 'pending'""",
    ),
    "profile_documents": (
        lambda s, d: dossier.profile_documents(load(s, d, "entities"), load(s, d, "mentions"), load(s, d, "files")),
        f"with {COUNTED} select c.id, cast(row_number() over (partition by c.id order by n_mentions desc, document_id) as integer) as rank, document_id, n_mentions, title, source_domain from counted c left join {{files}} f on f.id = document_id",
    ),
    "profile_lists": (
        _lists,
        f"""with {COUNTED}, kept as (select * from counted where document_id in (select id from {{files}})), d as (select id, string_agg(document_id || ':' || n_mentions, ',' order by n_mentions desc, document_id) as documents from (select * from kept qualify row_number() over (partition by id order by n_mentions desc, document_id) <= 4) group by 1),
            e as (select id, string_agg(event_id || ':' || event_date, ',' order by event_date, event_id) as events from (select k.id, t.id as event_id, t.event_date from kept k join {{timeline}} t on t.document_id = k.document_id where t.event_date is not null qualify row_number() over (partition by k.id order by event_date, t.id) <= 4) group by 1)
            select n.id, documents, events from {{entities}} n left join d using (id) left join e using (id)""",
    ),
    "profile_facts": (
        _facts,
        f"""{LOCKED}, facts as (select l.id, l.case_id, l.n_documents, case e.type when 'person' then 'PERSON' when 'agency' then 'AGENCY' else 'ORGANIZATION' end as kind, (select count(*) from {{mentions}} m where m.status = 'approved' and m.case_id = l.case_id and lower(trim(m.entity_name)) = lower(trim(l.name))) as n_mentions,
                (select count(*) from {{signals}} s where s.case_id = l.case_id and lower(trim(s.entity_name)) = lower(trim(l.name))) as n_signals, coalesce((select sum(normalized_amount) from {{signals}} s where s.case_id = l.case_id and lower(trim(s.entity_name)) = lower(trim(l.name))), 0) as signal_total,
                (select count(*) from {{relationships}} r where r.entity_a_id = l.id) + (select count(*) from {{relationships}} r where r.entity_b_id = l.id) as n_edges from locked l join {{entities}} e on e.id = l.id),
            asked as (select *, list_filter([case when n_documents < 2 then 'MORE_SOURCES' end, case when n_signals = 0 and kind = 'AGENCY' then 'FIND_FLOWS' end, case when n_edges = 0 then 'MAP_LINKS' end, case when kind = 'PERSON' then 'AUTHORITY' end], lambda x: x is not null)[1:3] as codes from facts)
            select id, case_id, n_documents, n_mentions, n_signals, signal_total, n_edges, case when n_documents >= 3 and n_mentions >= 3 then 'STRONG' when n_documents >= 2 or n_mentions >= 2 then 'MODERATE' else 'LIMITED' end as strength, case when len(codes) = 0 then 'VERIFY' else array_to_string(codes, ',') end as questions from asked""",
    ),
    "named_flows": (
        lambda s, d: dossier.named_flows(_view(s, d, FLOWS, "signals"), load(s, d, "entities")),
        f"""with f as ({FLOWS}) select f.id, f.case_id, coalesce(nullif(a.name, ''), 'Entity ' || source_entity_id) as source_name, coalesce(nullif(b.name, ''), 'Entity ' || destination_entity_id) as destination_name, amount, coalesce(nullif(currency, ''), 'USD') as currency
            from f left join {{entities}} a on a.id = source_entity_id left join {{entities}} b on b.id = destination_entity_id""",
    ),
    "named_timeline": (
        lambda s, d: dossier.named_timeline(_view(s, d, LINKED, "timeline"), load(s, d, "entities"), load(s, d, "files")),
        f"with t as ({LINKED}) select t.id, t.case_id, event_date, t.title, coalesce(nullif(e.name, ''), 'Entity ' || linked_entity_id) as entity_name, coalesce(nullif(f.title, ''), 'Document ' || document_id) as document_title from t left join {{entities}} e on e.id = linked_entity_id left join {{files}} f on f.id = document_id",
    ),
    "named_evidence": (
        lambda s, d: dossier.named_evidence(load(s, d, "evidence"), load(s, d, "files").filter("id % 5 <> 2")),
        "select e.id, relationship_id, document_id, coalesce(nullif(f.title, ''), 'Document ' || document_id) as document_title from {evidence} e left join (select * from {files} where id % 5 <> 2) f on f.id = document_id",
    ),
    "case_money": (
        lambda s, d: summaries.case_money(load(s, d, "signals")).withColumn("largest", F.array_join("largest", ",")),
        f"""with s as (select *, coalesce(signal_type, '') not like 'NON_NUMERIC%' and coalesce(amount_display, '') <> 'NON-NUMERIC' as numeric from {{signals}}),
            top as (select case_id, string_agg(id, ',' order by normalized_amount desc, id) as largest from (select * from s where numeric and normalized_amount is not null qualify row_number() over (partition by case_id order by normalized_amount desc, id) <= 5) group by 1)
            select case_id, count(*) as n_signals, count(*) filter (numeric) as n_numeric, coalesce(sum(normalized_amount) filter (numeric), 0) as total, coalesce(any_value(largest), '') as largest, count(distinct {NAME_KEY}) as n_names, count(distinct document_id) as n_documents from s left join top using (case_id) group by 1""",
    ),
}
