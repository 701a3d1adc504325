"""Queries that compile cases, and dossier and registry queries."""

from pyspark.sql import functions as F

from casework.operators import compiling, dossier, graph, money
from casework.plans.graph_plans import ENDS
from casework.plans.money_plans import JUNK_NAME, NON_NUMERIC, NUMERIC
from casework.sources.views import load, load_all
from casework.tables import save

AS_OF = "2000-06-30"
STATS = "stats as (select case_id, entity_name, count(*) as n_mentions, count(distinct document_id) as n_documents, round(avg(confidence) + 1e-9, 2) as avg_confidence, round(max(confidence), 2) as max_confidence from {mentions} group by 1, 2)"
ORG = "(agency|administration|office|department|bureau|foundation|inc|corp|llc|ltd|group|institute|association|committee|commission|authority|ministry|council|union|party|government|court|senate|congress|parliament|university|college|hospital|bank|fund|company|firm|organization)"
RANKED = rf"""{STATS}, known as (select case_id, lower(trim(name)) as k, arg_max(type, id) as known_type, max(id) as entity_id from {{entities}} group by 1, 2),
    typed as (select s.*, k.entity_id, case when coalesce(known_type, 'unknown') <> 'unknown' then known_type when regexp_matches(lower(entity_name), '\b{ORG}\b') then 'organization'
            when regexp_matches(trim(entity_name), '^[A-Z][a-z]\S* +[A-Z][a-z]\S*$') then 'person' else 'organization' end as type,
            n_documents >= 2 or n_mentions >= 3 as is_primary, round(2 * n_mentions + 4 * n_documents + 8 * avg_confidence, 4) as score
        from (select *, entity_name as n from stats) s left join known k on k.case_id = s.case_id and k.k = lower(trim(s.entity_name)) where not {JUNK_NAME}),
    ranked as (select * from (select *, cast(row_number() over (partition by case_id, is_primary order by score desc, entity_name) as integer) as rank from typed) where rank <= case when is_primary then 6 else 4 end)"""
DIAG = lambda k: f"nullif(regexp_extract(raw_text, '^\\[DIAG:(?:[^\\]]*\\|)?{k}=([^|\\]]*)', 1), '')"
USABLE = f"""usable as (select *, coalesce({DIAG("status")}, 'unknown') as status, coalesce(try_cast({DIAG("score")} as integer), 0) as d_score, coalesce({DIAG("priority")}, 'PRIORITY_B') as priority, coalesce({DIAG("alignment")}, 'unknown') as alignment,
        coalesce(try_cast({DIAG("chars")} as integer), 0) as chars, coalesce(try_cast({DIAG("entities")} as integer), 0) as n_ents from {{files}} where coalesce({DIAG("status")}, 'unknown') not in ('failed', 'wrapper') and length(raw_text) >= 100)"""
EVENTS = f"""past as (select *, row_number() over (partition by case_id, event_date, substring(lower(title), 1, 60) order by id) as rn from {{timeline}} where event_date <= date '{AS_OF}'),
    names as (select distinct case_id, lower(n) as name from (select case_id, entity_name as n from {{mentions}}) where not {JUNK_NAME}),
    scored_events as (select p.*, case event_type when 'AUDIT' then 9 else 1 end as priority, (case event_type when 'AUDIT' then 9 else 1 end) * 10 + case when exists (select 1 from names x where x.case_id = p.case_id and contains(lower(p.title), x.name)) then 8 else 0 end as score from past p where rn = 1),
    top_events as (select case_id, cast(row_number() over (partition by case_id order by score desc, event_date, id) as integer) as rank, id, event_date, event_type, priority, score from scored_events qualify rank <= 8)"""
TITLED = "select id, case_id, case when id % 9 = 0 then 'Minutes of the Metro Council' when id % 9 = 1 then 'Notes on Jordan' else title end as title from {files}"
QUALITY = f"titled as (select distinct case_id, unnest(list_filter(string_split(lower(title), ' '), lambda w: length(w) > 3)) as word from ({TITLED}))," + """ quality as (
    select e.id, e.case_id, e.name, e.type, coalesce(a.n_documents, 0) as n_documents, coalesce(g.n_edges, 0) as n_edges, f.k is not null as financial, coalesce(a.avg_confidence, 0.5) as avg_confidence, exists (select 1 from titled t where t.case_id = e.case_id and list_contains(list_filter(string_split(lower(e.name), ' '), lambda w: length(w) > 3), t.word)) as in_title
    from {entities} e left join (select case_id, lower(trim(entity_name)) as k, count(distinct document_id) as n_documents, avg(confidence) as avg_confidence from {mentions} where status = 'approved' group by 1, 2) a on a.case_id = e.case_id and a.k = lower(trim(e.name))
    left join (select entity_id, count(*) as n_edges from ends group by 1) g on g.entity_id = e.id
    left join (select distinct case_id, lower(trim(n)) as k from (select case_id, unnest([entity_name, controlled_by, received_by]) as n from {signals}) where n is not null) f on f.case_id = e.case_id and f.k = lower(trim(e.name))),
    scored as (select id, case_id, name, type, n_documents, n_edges, financial, in_title, round(case when financial then 3 else 0 end + 3 * avg_confidence + 2 * n_documents / greatest(max(n_documents) over (partition by case_id), 1) + case when in_title then 2 else 0 end + 2 * least(n_edges / 3, 1.0), 4) as score from quality)"""
LOCKED = f"""with {ENDS}, {QUALITY}, locked as (select case_id, cast(row_number() over (partition by case_id order by score desc, id) as integer) as rank, id, name, score, n_documents from scored where n_documents >= 2 or financial or n_edges > 0 or type in ('agency', 'organization') or in_title qualify rank <= 12)"""
ACC = ", ".join(f"'{x}'" for x in dossier.ACCOUNTABILITY)

POWER = f"""{RANKED}, {ENDS}, deg as (select entity_id, count(*) as degree from ends group by 1), p as (select r.case_id, r.entity_id, entity_name, coalesce(degree, 0) as degree, 2 * coalesce(degree, 0) + 0.5::double * n_mentions + n_documents as score from ranked r left join deg on deg.entity_id = r.entity_id where is_primary),
    power as (select case_id, cast(row_number() over (partition by case_id order by score desc, entity_name) as integer) as rank, entity_id, entity_name, degree, score from p qualify rank <= 3)"""


def _load(s, d, *names):
    return load_all(s, d, *names)


def _ranked(s, d):
    return compiling.ranked_entities(*_load(s, d, "mentions", "entities"))


def _events(s, d):
    return compiling.ranked_timeline(*_load(s, d, "timeline", "mentions"), AS_OF)


def _quality_of_data(s, d):
    mentions, entities, timeline = _load(s, d, "mentions", "entities", "timeline")
    return compiling.data_quality(load(s, d, "cases"), load(s, d, "files"), compiling.ranked_entities(mentions, entities), compiling.ranked_timeline(timeline, mentions, AS_OF))


def _titled(s, files):
    return s.sql(TITLED, files=files)


def _scored(s, entities, mentions, edges, signals, files):
    """Quality of all entities, written once for all that reads it."""
    return save(dossier.entity_quality(entities, mentions, edges, signals, _titled(s, files)))


def _quality(s, d):
    *tables, files = _load(s, d, "entities", "mentions", "relationships", "signals", "files")
    return dossier.entity_quality(*tables, _titled(s, files))


def _case_quality(s, d):
    entities, mentions, edges, signals, files, cases, timeline = _load(s, d, "entities", "mentions", "relationships", "signals", "files", "cases", "timeline")
    locked = dossier.locked(_scored(s, entities, mentions, edges, signals, files))
    return dossier.case_quality(cases, locked, edges.filter("confidence >= 0.6"), money.numeric_signals(signals), dossier.accountability(timeline), files)


def _risk_flags(s, d):
    entities, mentions, edges, signals, files, cases, timeline = _load(s, d, "entities", "mentions", "relationships", "signals", "files", "cases", "timeline")
    return dossier.risk_flags(cases, dossier.locked(_scored(s, entities, mentions, edges, signals, files)), edges, signals, timeline, files)


PLANS = {
    "case_counts": (
        lambda s, d: compiling.case_counts(load(s, d, "cases"), entities=load(s, d, "entities"), documents=load(s, d, "files"), events=load(s, d, "timeline"), edges=load(s, d, "relationships"), pending=load(s, d, "mentions").filter("status = 'pending'")),
        """select c.*, (select count(*) from {entities} t where t.case_id = c.id) as n_entities, (select count(*) from {files} t where t.case_id = c.id) as n_documents, (select count(*) from {timeline} t where t.case_id = c.id) as n_events,
            (select count(*) from {relationships} t where t.case_id = c.id) as n_edges, (select count(*) from {mentions} t where t.case_id = c.id and status = 'pending') as n_pending from {cases} c""",
    ),
    "edges_touching": (
        lambda s, d: compiling.edges_touching(*_load(s, d, "cases", "relationships", "entities")),
        "select c.id, count(distinct r.id) as n_edges from {cases} c left join {entities} e on e.case_id = c.id left join {relationships} r on r.entity_a_id = e.id or r.entity_b_id = e.id group by 1",
    ),
    "mention_stats": (lambda s, d: compiling.mention_stats(load(s, d, "mentions")), f"with {STATS} select * from stats"),
    "ranked_documents": (
        lambda s, d: compiling.ranked_documents(load(s, d, "files"), load(s, d, "timeline").filter("not soft_event"), load(s, d, "signals").filter("normalized_amount is not null")),
        f"""with {USABLE}, s as (select *, id in (select document_id from {{timeline}} where not soft_event) as has_t, id in (select document_id from {{signals}} where normalized_amount is not null) as has_m from usable),
            scored as (select id, case_id, title, cast(d_score + case priority when 'PRIORITY_A' then 15 when 'PRIORITY_B' then 5 else 0 end + case alignment when 'matched' then 10 when 'partial' then 4 else 0 end + case when chars > 5000 then 8 when chars > 2000 then 4 else 0 end
                + case when has_t then 12 else 0 end + case when has_m then 14 else 0 end + case when n_ents >= 5 then 6 when n_ents >= 2 then 3 else 0 end as integer) as score,
                concat_ws(' | ', case when d_score > 0 then 'relevance=' || d_score end, case when priority = 'PRIORITY_A' then 'priority=A' end, case when alignment = 'matched' then 'aligned' end, case when has_t then 'has_timeline' end, case when has_m then 'has_financial' end) as reason from s)
            select *, cast(row_number() over (partition by case_id order by score desc, id) as integer) as rank from scored qualify rank <= 5""",
    ),
    "ranked_entities": (
        lambda s, d: _ranked(s, d).select("case_id", "entity_name", "type", "n_mentions", "n_documents", "is_primary", "score", "rank"),
        f"with {RANKED} select case_id, entity_name, type, n_mentions, n_documents, is_primary, score, rank from ranked",
    ),
    "ranked_timeline": (_events, f"with {EVENTS} select * from top_events"),
    "data_quality": (
        _quality_of_data,
        f"""with {USABLE}, {RANKED}, {EVENTS}, c as (select c.id, (select count(*) from usable u where u.case_id = c.id) as n_usable, (select count(*) from ranked r where r.case_id = c.id and is_primary) as n_primary, (select count(*) from top_events t where t.case_id = c.id) as n_events from {{cases}} c),
            q as (select *, least(n_usable, 5) as n_evidence, case when n_usable = 0 then 'EMPTY' when n_primary >= 2 and least(n_usable, 5) >= 3 and n_events >= 2 then 'STRONG' when n_primary >= 1 and least(n_usable, 5) >= 2 then 'MODERATE' else 'WEAK' end as quality from c)
            select *, cast(least(99, case quality when 'STRONG' then 80 + least(20, n_primary * 4 + least(n_events, 3) * 2) when 'MODERATE' then 45 + least(30, n_primary * 6 + least(n_events, 2) * 3) when 'WEAK' then 15 + least(25, n_primary * 5 + n_usable * 2) else 0 end) as integer) as confidence,
            case quality when 'STRONG' then 'STRONG' when 'MODERATE' then 'DEVELOPING' else 'SPARSE' end as health from q""",
    ),
    "power_nodes": (
        lambda s, d: compiling.power_nodes(_ranked(s, d), load(s, d, "relationships")),
        f"with {POWER} select * from power",
    ),
    "bridges": (
        lambda s, d: graph.bridges(load(s, d, "relationships"), load(s, d, "entities"), compiling.power_nodes(_ranked(s, d), load(s, d, "relationships"))),
        f"""with {POWER} select id, case_id, name from {{entities}} where id in (select entity_id from ends) and id not in (select entity_id from power where entity_id is not null)""",
    ),
    "key_relationships": (
        lambda s, d: compiling.key_relationships(load(s, d, "relationships")),
        "select case_id, cast(row_number() over (partition by case_id order by coalesce(confidence, 0) desc, id) as integer) as rank, id, entity_a_id, entity_b_id, relationship_type, confidence from {relationships} qualify rank <= 8",
    ),
    "case_totals": (
        lambda s, d: compiling.totals(load(s, d, "cases"), load(s, d, "files"), timeline=load(s, d, "timeline"), signals=load(s, d, "signals"), mentions=load(s, d, "mentions")),
        f"""with {USABLE} select c.*, (select count(*) from {{files}} t where t.case_id = c.id) as n_documents, (select count(*) from usable t where t.case_id = c.id) as n_usable, (select count(*) from {{timeline}} t where t.case_id = c.id) as n_timeline,
            (select count(*) from {{signals}} t where t.case_id = c.id) as n_signals, (select count(*) from {{mentions}} t where t.case_id = c.id) as n_mentions from {{cases}} c""",
    ),
    "early_signals": (
        lambda s, d: compiling.early_signals(_ranked(s, d), *_load(s, d, "signals", "timeline")),
        f"""with {RANKED}, hints as (select case_id, 1 as ord, cast(rank as bigint) as at_, 'entity' as kind, entity_name as label, 0.35::double as confidence from ranked where not is_primary and rank <= 3
            union all select case_id, 2, id, 'financial', coalesce(program_name, entity_name, substring(event_summary, 1, 60), 'Unknown'), coalesce(financial_confidence, 0.25) from {{signals}} where {NON_NUMERIC}
            union all select case_id, 3, id, 'timeline', substring(title, 1, 80), 0.3::double from {{timeline}} where soft_event)
            select case_id, cast(row_number() over (partition by case_id order by ord, at_) as integer) as rank, kind, label, confidence from hints qualify rank <= 6""",
    ),
    "oversight_flags": (
        lambda s, d: compiling.oversight(load(s, d, "cases"), _events(s, d), load(s, d, "signals"), _ranked(s, d), load(s, d, "files")),
        f"""with {RANKED}, {EVENTS}, t as (select case_id, min(event_date) filter (event_type in ('LEGAL_ACTION', 'AUDIT', 'INVESTIGATION_STARTED')) as first_legal, count(*) filter (event_type in ('FUNDING_APPROVED', 'CONTRACT_AWARDED')) as n_approvals from top_events group by 1),
            m as (select case_id, count(*) as n_signals, coalesce(sum(normalized_amount) filter (normalized_amount >= 1000000), 0) as large from {{signals}} group by 1), a as (select case_id, bool_or(type in ('government_agency', 'agency')) as has_agency from ranked where is_primary group by 1),
            f as (select case_id, bool_or(regexp_matches(lower(concat_ws(' ', source_domain, title)), '[.]gov|audit|inspector general')) as has_public from {{files}} group by 1)
            select c.id, first_legal is null and coalesce(n_signals, 0) > 0 as no_oversight, case when coalesce(n_signals, 0) > 0 then first_legal end as late_since, coalesce(has_agency, false) and first_legal is null as agency_unseen, coalesce(large, 0) > 0 and not coalesce(has_public, false) as no_public_source, coalesce(n_approvals, 0) >= 3 as many_approvals
            from {{cases}} c left join t on t.case_id = c.id left join m on m.case_id = c.id left join a on a.case_id = c.id left join f on f.case_id = c.id""",
    ),
    "overall_confidence": (
        lambda s, d: dossier.confidence(load(s, d, "cases"), dossier.locked(_quality(s, d)), load(s, d, "files"), money.numeric_signals(load(s, d, "signals"))),
        f"""{LOCKED}, {NUMERIC}, n as (select c.id, (select count(*) from locked l where l.case_id = c.id) as n_entities, (select count(*) from locked l where l.case_id = c.id and n_documents >= 3) as n_confirmed, (select count(*) from {{files}} f where f.case_id = c.id) as n_sources, (select count(*) from numeric_signals x where x.case_id = c.id) as n_signals from {{cases}} c)
            select *, case when n_entities = 0 then 'INSUFFICIENT' when n_confirmed >= 3 and n_sources >= 6 and n_signals > 0 then 'STRONG' when n_confirmed >= 2 and n_sources >= 4 then 'MODERATE' else 'PROVISIONAL' end as level from n""",
    ),
    "risk_flags": (
        _risk_flags,
        f"""{LOCKED} select c.id, coalesce(high_value, false) as high_value, coalesce(contract, false) as contract, coalesce(weak_edge, false) as weak_edge, coalesce(unattributed, false) as unattributed, coalesce(n_events, 0) > 0 and coalesce(n_signals, 0) > 0 as timing, coalesce(n_entities, 0) > 0 and coalesce(n_edges, 0) = 0 as unlinked from {{cases}} c
            left join (select case_id, bool_or(not coalesce(inferred_signal, false) and normalized_amount >= 1000000) as high_value, bool_or(signal_type in ('CONTRACT', 'CONTRACT_AWARDED')) as contract, count(*) as n_signals from {{signals}} group by 1) s on s.case_id = c.id
            left join (select case_id, bool_or(confidence < 0.4) as weak_edge, count(*) as n_edges from {{relationships}} group by 1) r on r.case_id = c.id left join (select case_id, bool_or(coalesce(source_domain, '') = '') as unattributed from {{files}} group by 1) f on f.case_id = c.id
            left join (select case_id, count(*) as n_events from {{timeline}} group by 1) t on t.case_id = c.id left join (select case_id, count(*) as n_entities from locked group by 1) l on l.case_id = c.id""",
    ),
    "entity_quality": (_quality, f"with {ENDS}, {QUALITY} select * from scored"),
    "locked_entities": (lambda s, d: dossier.locked(_quality(s, d)).drop("n_documents"), f"{LOCKED} select case_id, rank, id, name, score from locked"),
    "display_types": (
        lambda s, d: load(s, d, "entities").select("id", dossier.display_type(F.col("type")).alias("shown")),
        "select id, case type when 'person' then 'PERSON' when 'agency' then 'AGENCY' when 'organization' then 'ORGANIZATION' end as shown from {entities}",
    ),
    "accountability_timeline": (
        lambda s, d: dossier.accountability(load(s, d, "timeline")),
        f"select case_id, cast(row_number() over (partition by case_id order by event_date, id) as integer) as rank, id, event_date, event_type from {{timeline}} where event_date is not null and (event_type is null or event_type in ({ACC})) qualify rank <= 8",
    ),
    "evidence_order": (
        lambda s, d: dossier.evidence_order(load(s, d, "files")),
        "select case_id, cast(row_number() over (partition by case_id order by publish_date desc nulls last, id) as integer) as rank, id, publish_date from {files}",
    ),
    "entity_registry": (
        lambda s, d: dossier.registry(*_load(s, d, "entities", "mentions")),
        "select e.id, case_id, name, type, coalesce(n_mentions, 0) as n_mentions, coalesce(n_documents, 0) as n_documents from {entities} e left join (select lower(trim(entity_name)) as k, count(*) as n_mentions, count(distinct document_id) as n_documents from {mentions} where status = 'approved' group by 1) m on m.k = lower(trim(e.name))",
    ),
    "entity_profiles": (
        lambda s, d: dossier.profiles(*_load(s, d, "entities", "mentions")),
        """with m as (select case_id, lower(trim(entity_name)) as k, count(*) filter (status = 'approved') as a, count(*) filter (status = 'pending') as p, count(*) filter (status = 'rejected') as r, min(document_id) as first_document, max(document_id) as last_document, count(distinct document_id) filter (status = 'approved') as d from {mentions} group by 1, 2)
            select e.id, e.case_id, coalesce(a, 0) as n_approved, coalesce(p, 0) as n_pending, coalesce(r, 0) as n_rejected, coalesce(d, 0) as n_documents, first_document, last_document, case when d >= 3 and a >= 3 then 'STRONG' when d >= 2 or a >= 2 then 'MODERATE' else 'LIMITED' end as strength
            from {entities} e left join m on m.case_id = e.case_id and m.k = lower(trim(e.name))""",
    ),
    "latest_log": (
        lambda s, d: dossier.latest_log(load(s, d, "log"), 20),
        "select case_id, cast(row_number() over (partition by case_id order by created_at desc, id desc) as integer) as rank, id, event_type, case event_type when 'seed_no_promotion' then 'error' when 'extraction_failed' then 'warn' when 'graph_built' then 'success' when 'auth_login' then 'success' when 'query_run' then 'debug' else 'info' end as severity from {log} qualify rank <= 20",
    ),
    "severity_counts": (
        lambda s, d: dossier.severity_counts(load(s, d, "log")),
        "select case event_type when 'seed_no_promotion' then 'error' when 'extraction_failed' then 'warn' when 'graph_built' then 'success' when 'auth_login' then 'success' when 'query_run' then 'debug' else 'info' end as severity, count(*) as n from {log} group by 1",
    ),
    "fleet_counts": (
        lambda s, d: dossier.fleet(*_load(s, d, "cases", "entities", "files", "mentions")),
        "select (select count(*) from {cases}) as n_cases, (select count(*) from {cases} where status = 'open') as n_open, (select count(*) from {entities}) as n_entities, (select count(*) from {files}) as n_documents, (select count(*) from {mentions} where status = 'pending') as n_pending",
    ),
    "case_quality": (
        _case_quality,
        f"""{LOCKED}, {NUMERIC},
            acc as (select case_id, row_number() over (partition by case_id order by event_date, id) as rn from {{timeline}} where event_type in ({ACC}) qualify rn <= 8),
            p as (select c.id, cast(least(20, 3 * (select count(*) from locked l where l.case_id = c.id and n_documents >= 1) + 3 * (select count(*) from locked l where l.case_id = c.id and n_documents >= 2)) as integer) as entity_points,
                cast(least(20, 4 * (select count(*) from {{relationships}} r where r.case_id = c.id and confidence >= 0.6)) as integer) as edge_points,
                cast(least(25, (select coalesce(sum(5 + case when coalesce(entity_name, controlled_by, received_by) is not null then 3 else 0 end + case when normalized_amount >= 1000000 then 2 else 0 end), 0) from numeric_signals x where x.case_id = c.id)) as integer) as money_points,
                cast(least(15, 5 * (select count(*) from acc a where a.case_id = c.id)) as integer) as event_points,
                (select count(*) from {{files}} f where f.case_id = c.id) as n, (select count(*) from {{files}} f where f.case_id = c.id and contains(source_domain, '.gov')) as g from {{cases}} c),
            q as (select id, entity_points, edge_points, money_points, event_points, cast(least(20, 2 * n + 4 * g + case when n - g >= 2 then 2 else 0 end) as integer) as source_points from p),
            t as (select *, entity_points + edge_points + money_points + event_points + source_points as total from q)
            select *, case when total < 20 then 'RAW' when total < 45 then 'DEVELOPING' when total < 70 then 'COMPILED' else 'OPERATOR-READY' end as label from t""",
    ),
}
