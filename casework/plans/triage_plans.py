"""Queries over mentions and their decisions."""

from pyspark.sql import functions as F

from casework.operators import triage
from casework.sources.views import load

SUPPORT = "support as (select case_id, lower(trim(entity_name)) as name_key, count(distinct document_id) as n_documents from {mentions} where document_id is not null and entity_name is not null group by 1, 2)"
REAL = "role not in ('UNKNOWN', 'PERSON')"
FRONT = "zone in ('title', 'dek', 'lead')"
ONE_WORD = "not contains(entity_name, ' ') and entity_type <> 'person'"
DECIDED = f"""{SUPPORT}, decided as (
    select m.id, m.case_id, case when confidence < 0.5 then 'rejected' when zone in ('sidebar', 'footer', 'related') and confidence < 0.7 then 'rejected'
        when {ONE_WORD} and confidence < 0.62 then 'rejected' when {ONE_WORD} and topic = 'LOW' and role = 'UNKNOWN' then 'rejected'
        when regexp_matches(trim(entity_name), '^[A-Z]{{1,4}}$') and role = 'UNKNOWN' then 'rejected' when zone = 'tail' and topic = 'LOW' and role = 'UNKNOWN' then 'rejected'
        when (coalesce(n_documents, 1) > 1 or role in ('GOVERNMENT_AGENCY', 'COMMITTEE')) and {FRONT} and topic = 'HIGH' and {REAL} and confidence >= 0.72 then 'approved'
        when (coalesce(n_documents, 1) > 1 or role in ('GOVERNMENT_AGENCY', 'COMMITTEE')) and topic = 'HIGH' and {REAL} and confidence >= 0.85 then 'approved'
        when (coalesce(n_documents, 1) > 1 or role in ('GOVERNMENT_AGENCY', 'COMMITTEE')) and topic = 'MEDIUM' and {REAL} and confidence >= 0.78 and {FRONT} then 'approved'
        when role in ('GOVERNMENT_AGENCY', 'COMMITTEE', 'OFFICIAL') and topic in ('HIGH', 'MEDIUM') and confidence >= 0.7 then 'approved'
        when coalesce(n_documents, 1) <= 1 and topic = 'HIGH' and {REAL} and confidence >= 0.72 then 'held' when topic = 'MEDIUM' and confidence >= 0.58 then 'held'
        when topic = 'LOW' and {REAL} and confidence >= 0.68 then 'held' when topic = 'LOW' and not ({REAL}) then 'rejected' else 'held' end as status
    from {{mentions}} m left join support s on s.case_id = m.case_id and s.name_key = lower(trim(m.entity_name)) where m.status = 'pending')""".replace("{{1,4}}", "{1,4}")
NORM = "lower(trim(regexp_replace(n, '\\s+', ' ', 'g')))"


def _bulk(rule):
    return lambda s, d: triage.bulk(load(s, d, "mentions"), rule).select("id", "case_id", "status")


def _bulk_sql(holds, status):
    return f"select id, case_id, case when status = 'pending' and ({holds}) then '{status}' else status end as status from {{mentions}}"


def _new_entities(s, d):
    return triage.promote(load(s, d, "mentions"), load(s, d, "entities").filter("id % 3 = 0"))


PLANS = {
    "mention_support": (lambda s, d: triage.support(load(s, d, "mentions")), f"with {SUPPORT} select * from support"),
    "auto_triage": (lambda s, d: triage.auto_triage(load(s, d, "mentions")), f"with {DECIDED} select * from decided"),
    "analysis_triage": (
        lambda s, d: triage.analysis_triage(load(s, d, "mentions")),
        f"""with {SUPPORT}, p as (select m.*, coalesce(n_documents, 1) as n_documents, role in ('GOVERNMENT_AGENCY', 'COMMITTEE') or regexp_matches(entity_name, '{triage.INSTITUTION}') or entity_type = 'government_agency' as inst from {{mentions}} m left join support s on s.case_id = m.case_id and s.name_key = lower(trim(m.entity_name)) where m.status = 'pending')
            select id, case_id, case when confidence < 0.5 then 'rejected' when zone in ('sidebar', 'footer', 'related') and confidence < 0.7 then 'rejected' when zone = 'tail' and topic = 'LOW' and role = 'UNKNOWN' then 'rejected' when regexp_matches(trim(entity_name), '^[A-Z]+$') and length(trim(entity_name)) <= 4 and role = 'UNKNOWN' then 'rejected'
                when (n_documents >= 2 or inst) and {FRONT} and topic = 'HIGH' and {REAL} and confidence >= 0.7 then 'approved' when (n_documents >= 2 or inst) and topic = 'HIGH' and {REAL} and confidence >= 0.82 then 'approved'
                when inst and confidence >= 0.65 and zone not in ('tail', 'sidebar', 'footer') then 'approved' when inst and topic in ('HIGH', 'MEDIUM') and confidence >= 0.62 then 'approved' when (n_documents >= 2 or inst) and topic = 'MEDIUM' and {REAL} and confidence >= 0.75 and {FRONT} then 'approved'
                when n_documents >= 2 and confidence >= 0.62 and {REAL} then 'approved' when topic = 'MEDIUM' and confidence >= 0.58 then 'held' when topic = 'LOW' and {REAL} and confidence >= 0.65 then 'held' else 'rejected' end as status from p""",
    ),
    "auto_triage_counts": (
        lambda s, d: triage.triage_counts(triage.auto_triage(load(s, d, "mentions"))),
        f"with {DECIDED} select case_id, count(*) filter (status = 'approved') as n_approved, count(*) filter (status = 'rejected') as n_rejected, count(*) filter (status = 'held') as n_held, count(*) as n_total from decided group by 1",
    ),
    "bulk_low_confidence": (_bulk("low-confidence"), _bulk_sql("coalesce(confidence, 1) < 0.6", "rejected")),
    "bulk_single_word_person": (_bulk("single-word-person"), _bulk_sql("entity_type = 'person' and not contains(entity_name, ' ')", "rejected")),
    "bulk_all_pending": (_bulk("all-pending"), _bulk_sql("true", "rejected")),
    "bulk_off_topic": (_bulk("off-topic"), _bulk_sql("topic = 'OFF_TOPIC'", "rejected")),
    "bulk_junk": (_bulk("junk"), _bulk_sql("regexp_matches(trim(entity_name), '^[A-Z][A-Z]?[A-Z]?$') or regexp_matches(trim(entity_name), '^[0-9]+$') or regexp_matches(entity_name, 'https?://')", "rejected")),
    "bulk_low_role": (_bulk("low-role"), _bulk_sql("coalesce(role, 'UNKNOWN') = 'UNKNOWN'", "held")),
    "bulk_artifact": (_bulk("artifact"), _bulk_sql("zone in ('sidebar', 'footer', 'related', 'boilerplate') or regexp_matches(lower(entity_name), '^(next|more|watch|listen|read|share|top|latest|live|breaking|related)\\s') or (regexp_matches(trim(entity_name), '^[A-Z]+$') and length(trim(entity_name)) between 2 and 6)", "rejected")),
    "bulk_nav": (_bulk("nav-boilerplate"), _bulk_sql("regexp_matches(lower(entity_name), '^(share|email|menu|search|close|back|next|more|open|save|edit|view|load|clear|reset|submit|cancel|follow|donate)$') or (zone in ('tail', 'boilerplate') and coalesce(confidence, 1) < 0.6)", "rejected")),
    "bulk_role_bearing": (_bulk("role-bearing"), _bulk_sql("coalesce(role, 'UNKNOWN') <> 'UNKNOWN' and confidence >= 0.72", "approved")),
    "bulk_title_lead": (_bulk("title-lead-highconf"), _bulk_sql("zone in ('title', 'dek', 'lead') and coalesce(role, 'UNKNOWN') <> 'UNKNOWN' and topic in ('HIGH', 'MEDIUM') and confidence >= 0.68", "approved")),
    "promoted_entities": (
        _new_entities,
        """with m as (select *, lower(entity_name) as norm from {mentions} where status = 'approved'),
            best as (select case_id, norm, min(id) as first_id, arg_max(struct_pack(n := entity_name, t := entity_type), struct_pack(c := confidence, i := -id)) as b from m group by 1, 2),
            top as (select case_id, b.n as entity_name, b.t as entity_type, first_id, cast(row_number() over (partition by case_id order by first_id) as integer) as rank from best)
            select t.* from top t where rank <= 8 and not exists (select 1 from {entities} e where e.id % 3 = 0 and e.case_id = t.case_id and e.name = t.entity_name)""",
    ),
    "unanalysed_documents": (
        lambda s, d: triage.unanalysed(load(s, d, "files"), load(s, d, "mentions").filter("status <> 'pending'")).select("id", "case_id"),
        "select id, case_id from {files} where id not in (select document_id from {mentions} where status <> 'pending')",
    ),
    "rejected_names": (
        lambda s, d: triage.reject_name(load(s, d, "mentions"), load(s, d, "entities").filter("type = 'agency'")).select("id", "case_id", "status"),
        "select id, case_id, case when status = 'pending' and exists (select 1 from {entities} e where e.type = 'agency' and e.case_id = m.case_id and lower(trim(e.name)) = lower(trim(m.entity_name))) then 'rejected' else status end as status from {mentions} m",
    ),
    "edges_without_entities": (
        lambda s, d: triage.without_entities(load(s, d, "relationships"), load(s, d, "entities").filter("type = 'agency'")).select("id", "entity_a_id", "entity_b_id"),
        "with gone as (select id from {entities} where type = 'agency') select id, entity_a_id, entity_b_id from {relationships} where entity_a_id not in (select id from gone) and entity_b_id not in (select id from gone)",
    ),
    "purged_mentions": (
        lambda s, d: triage.purge(load(s, d, "files"), load(s, d, "mentions"), F.col("raw_text").contains("status=failed"))[1].select("id", "document_id"),
        "select id, document_id from {mentions} where document_id not in (select id from {files} where contains(raw_text, 'status=failed'))",
    ),
    "replaced_mentions": (
        lambda s, d: triage.replace_pending(load(s, d, "mentions"), load(s, d, "mentions").filter("zone in ('title', 'lead') and status = 'pending'").withColumn("id", F.col("id") + 10_000_000)).select("id", "document_id", "status"),
        """with fresh as (select *, row_number() over (partition by document_id, lower(trim(entity_name)) order by id desc) as rn from {mentions} where zone in ('title', 'lead') and status = 'pending')
            select id, document_id, status from {mentions} m where not (status = 'pending' and document_id in (select document_id from fresh)) union all select id + 10000000, document_id, status from fresh where rn = 1""",
    ),
    "triage_view": (
        lambda s, d: triage.triage_view(load(s, d, "mentions"), load(s, d, "cases"), load(s, d, "entities")),
        "select m.id, m.case_id, c.title as case_title, m.entity_name, m.confidence, exists (select 1 from {entities} e where e.case_id = m.case_id and lower(trim(e.name)) = lower(trim(m.entity_name))) as entity_exists from {mentions} m left join {cases} c on c.id = m.case_id where m.status = 'pending'",
    ),
    "zone_histogram": (
        lambda s, d: triage.histogram(load(s, d, "mentions").filter("status = 'rejected'"), "zone"),
        "select case_id, zone, n, rank from (select case_id, zone, count(*) as n, cast(row_number() over (partition by case_id order by count(*) desc, zone) as integer) as rank from {mentions} where status = 'rejected' group by 1, 2) where rank <= 5",
    ),
}
