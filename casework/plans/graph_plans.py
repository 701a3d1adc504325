"""Queries over entity graphs."""

from casework.operators import graph
from casework.sources.views import load, load_all

OF = """of as (select distinct e.case_id, e.id as entity_id, m.document_id from {entities} e join {mentions} m on m.case_id = e.case_id and lower(trim(m.entity_name)) = lower(trim(e.name)) where trim(e.name) <> '')"""
PAIRS = "pairs as (select a.case_id, a.entity_id as entity_a_id, b.entity_id as entity_b_id, count(*) as n_documents from of a join of b on a.case_id = b.case_id and a.document_id = b.document_id and a.entity_id < b.entity_id group by 1, 2, 3)"
ENDS = "ends as (select case_id, unnest([entity_a_id, entity_b_id]) as entity_id from {relationships})"
JUNK = "(with|by|from|of|and|or|the|a|an|co_mention|title_co_mention|cooccurrence|generic|unknown|mentioned|appears|found)"


def _load(s, d, *names):
    return load_all(s, d, *names)


# Tiers and priorities of documents; each fourth case has no aligned one.
TIERED = "select id, case_id, case when case_id % 4 = 1 then 'PERIPHERAL' else split_part('CORE,RELEVANT,PERIPHERAL,CONTAMINATED', ',', cast(id % 4 as int) + 1) end as tier, split_part('PRIORITY_A,PRIORITY_B,LOW_SIGNAL,NOISE', ',', cast(id % 7 % 4 as int) + 1) as priority from {files}"


def _tiered(s, d):
    return graph.seed_documents(s.sql(TIERED, files=load(s, d, "files")))


PLANS = {
    "seed_documents": (
        lambda s, d: _tiered(s, d).select("id", "case_id", "tier"),
        f"with t as ({TIERED}) select id, case_id, tier from t where case when case_id in (select case_id from t where tier in ('CORE', 'RELEVANT')) then tier in ('CORE', 'RELEVANT') else priority in ('PRIORITY_A', 'PRIORITY_B') end",
    ),
    "seed_strengths": (
        lambda s, d: graph.seed_strength(graph.seed_graph(*_load(s, d, "entities", "mentions"), _tiered(s, d))),
        f"""with t as ({TIERED}), good as (select id from t where case when case_id in (select case_id from t where tier in ('CORE', 'RELEVANT')) then tier in ('CORE', 'RELEVANT') else priority in ('PRIORITY_A', 'PRIORITY_B') end),
            m as (select * from {{mentions}} where document_id in (select id from good)), {OF.replace('{mentions}', 'm')}, {PAIRS} select case_id, count(*) as n_edges, count(*) filter (n_documents >= 2) as n_strong from pairs group by 1""",
    ),
    "co_mention_edges": (
        lambda s, d: graph.co_mention(*_load(s, d, "entities", "mentions")),
        f"with {OF}, {PAIRS} select *, case when n_documents >= 2 then 'repeated_association' else 'co_mention' end as relationship_type, case when n_documents >= 3 then 0.88::double when n_documents >= 2 then 0.8::double else 0.7::double end as confidence from pairs",
    ),
    "seed_edges": (
        lambda s, d: graph.seed_graph(*_load(s, d, "entities", "mentions"), load(s, d, "files").filter("not contains(raw_text, 'LOW_SIGNAL')")),
        f"""with m as (select * from {{mentions}} where document_id in (select id from {{files}} where not contains(raw_text, 'LOW_SIGNAL'))), {OF.replace('{mentions}', 'm')}, {PAIRS},
            front as (select distinct e.id from {{entities}} e join m on m.case_id = e.case_id and lower(trim(m.entity_name)) = lower(trim(e.name)) where m.zone in ('title', 'dek', 'lead')),
            marked as (select *, entity_a_id in (select id from front) and entity_b_id in (select id from front) as both_front from pairs)
            select case_id, entity_a_id, entity_b_id, n_documents, case when both_front then 'title_co_mention' when n_documents >= 2 then 'repeated_association' else 'co_mention' end as relationship_type,
            case when both_front then 0.88::double when n_documents >= 2 then 0.82::double else 0.7::double end as confidence from marked""",
    ),
    "provisional_edges": (
        lambda s, d: graph.provisional(load(s, d, "entities"), load(s, d, "relationships").filter("case_id % 3 <> 0")),
        """with bare as (select *, row_number() over (partition by case_id order by id) as rn from {entities} where case_id not in (select case_id from {relationships} where case_id % 3 <> 0))
            select a.case_id, a.id as entity_a_id, b.id as entity_b_id, 'provisional_co_mention' as relationship_type, 0.45::double as confidence from bare a join bare b on a.case_id = b.case_id and a.id < b.id where a.rn <= 5 and b.rn <= 5""",
    ),
    "suggested_edges": (
        lambda s, d: graph.suggested(*_load(s, d, "entities", "mentions", "relationships")),
        f"""with approved as (select * from {{mentions}} where status = 'approved'), {OF.replace('{mentions}', 'approved')}, {PAIRS},
            typed as (select p.*, concat_ws('|', least(a.type, b.type), greatest(a.type, b.type)) as kinds from pairs p join {{entities}} a on a.id = p.entity_a_id join {{entities}} b on b.id = p.entity_b_id
                where not exists (select 1 from {{relationships}} r where r.entity_a_id = p.entity_a_id and r.entity_b_id = p.entity_b_id)),
            scored as (select *, n_documents + case kinds when 'agency|person' then 2.0::double when 'organization|person' then 1.5::double when 'agency|organization' then 1.0::double when 'person|person' then -0.5::double when 'organization|organization' then 0.5::double else 0.0::double end as score from typed),
            graded as (select *, case when score >= 3.5 then 'HIGH' when score >= 2 then 'MEDIUM' else 'LOW' end as grade from scored)
            select case_id, entity_a_id, entity_b_id, n_documents, score, grade from graded where not (grade = 'LOW' and n_documents <= 1 and kinds = 'person|person')""",
    ),
    "degrees": (lambda s, d: graph.degree(load(s, d, "relationships")), f"with {ENDS} select case_id, entity_id, count(*) as degree from ends group by 1, 2"),
    "visible_nodes": (
        lambda s, d: graph.visible(*_load(s, d, "entities", "relationships")).select("id", "case_id", "name", "degree"),
        f"with {ENDS}, deg as (select entity_id, count(*) as degree from ends group by 1) select e.id, e.case_id, e.name, degree from {{entities}} e join deg on deg.entity_id = e.id where degree >= 2 and trim(name) <> '' and not regexp_matches(name, '^[0-9\\s.,-]+$')",
    ),
    "ego_networks": (
        lambda s, d: graph.ego(load(s, d, "relationships"), load(s, d, "entities").filter("type = 'agency'").selectExpr("id as entity_id")),
        "with c as (select id from {entities} where type = 'agency') select entity_a_id as center, entity_b_id as neighbour from {relationships} where entity_a_id in (select id from c) union select entity_b_id, entity_a_id from {relationships} where entity_b_id in (select id from c)",
    ),
    "financial_links": (
        lambda s, d: graph.financial_links(*_load(s, d, "signals", "entities", "relationships")),
        """with s as (select id, case_id, lower(trim(coalesce(controlled_by, entity_name))) as payer, lower(trim(received_by)) as receiver from {signals} where coalesce(controlled_by, entity_name) is not null and received_by is not null),
            wanted as (select distinct case_id, unnest([payer, receiver]) as party from s),
            exact as (select w.case_id, party, min(e.id) as entity_id from wanted w join {entities} e on e.case_id = w.case_id and lower(trim(e.name)) = w.party group by 1, 2),
            rest as (select * from wanted w where not exists (select 1 from exact x where x.case_id = w.case_id and x.party = w.party)),
            prefix as (select r.case_id, party, min(e.id) as entity_id from rest r join {entities} e on e.case_id = r.case_id where length(party) >= 4 and length(trim(e.name)) >= 4 and (starts_with(party, lower(trim(e.name))) or starts_with(lower(trim(e.name)), party)) group by 1, 2),
            match as (select * from exact union all select * from prefix),
            linked as (select s.case_id, s.id as signal_id, p.entity_id as source_id, r.entity_id as target_id from s join match p on p.case_id = s.case_id and p.party = s.payer join match r on r.case_id = s.case_id and r.party = s.receiver where p.entity_id <> r.entity_id),
            one as (select *, row_number() over (partition by least(source_id, target_id), greatest(source_id, target_id) order by signal_id) as rn from linked)
            select case_id, signal_id, source_id, target_id from one where rn = 1 and not exists (select 1 from {relationships} r where r.entity_a_id = least(source_id, target_id) and r.entity_b_id = greatest(source_id, target_id))""",
    ),
    "co_mentioned": (
        lambda s, d: graph.co_mentioned(*_load(s, d, "entities", "mentions")).select("case_id", "entity_id", "name", "n_pairs", "rank", "grade"),
        """with m as (select case_id, document_id, entity_name as name, lower(trim(entity_name)) as k from {mentions} where status = 'approved'),
            p as (select e.case_id, e.id as entity_id, o.name, count(*) as n_pairs from {entities} e join m own on own.case_id = e.case_id and own.k = lower(trim(e.name)) join m o on o.case_id = own.case_id and o.document_id = own.document_id and o.k <> own.k group by 1, 2, 3)
            select *, case when n_pairs >= 3 then 'HIGH' when n_pairs >= 2 then 'MEDIUM' else 'LOW' end as grade from (select *, cast(row_number() over (partition by entity_id order by n_pairs desc, name) as integer) as rank from p) where rank <= 8""",
    ),
    "clean_edges": (
        lambda s, d: graph.clean_edges(load(s, d, "relationships"), 10).select("case_id", "rank", "id", "relationship_type", "confidence"),
        rf"""select * from (select case_id, cast(row_number() over (partition by case_id order by confidence desc, id) as integer) as rank, id, relationship_type, confidence from {{relationships}}
            where trim(coalesce(relationship_type, '')) <> '' and not regexp_matches(lower(relationship_type), '\b{JUNK}\b') and coalesce(confidence, 1) >= 0.3) where rank <= 10""",
    ),
    "named_edges": (
        lambda s, d: graph.named_edges(*_load(s, d, "relationships", "entities", "evidence")),
        """select r.id, r.case_id, coalesce(a.name, 'Entity ' || r.entity_a_id) as name_a, coalesce(b.name, 'Entity ' || r.entity_b_id) as name_b, relationship_type, confidence, coalesce(n, 0) as n_evidence from {relationships} r
            left join {entities} a on a.id = r.entity_a_id left join {entities} b on b.id = r.entity_b_id left join (select relationship_id, count(*) as n from {evidence} group by 1) e on e.relationship_id = r.id""",
    ),
}
