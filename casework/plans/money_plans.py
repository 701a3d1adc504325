"""Queries over money signals."""

from casework.operators import compiling, money
from casework.operators.ranking import name_key
from casework.sources.views import load

from pyspark.sql import functions as F

NON_NUMERIC = "(coalesce(signal_type, '') like 'NON_NUMERIC%' or coalesce(amount_display, '') = 'NON-NUMERIC')"
NUMERIC = f"""
    numeric_signals as (
        select * exclude (rn) from (
            select *, row_number() over (partition by case_id, lower(coalesce(entity_name, '')), normalized_amount order by id) as rn
            from {{signals}} where not {NON_NUMERIC} and normalized_amount > 0) where rn = 1)"""

JUNK_NAME = "(length(n) > 60 or length(n) < 3 or regexp_matches(n, 'https?://') or regexp_matches(n, '^[0-9]+$') or length(regexp_replace(n, '[^A-Z]', '', 'g')) > 15 or len(regexp_split_to_array(n, '\\s+')) > 6)"
RANKED_SIGNALS = f"""
    known as (select distinct case_id, lower(trim(n)) as k from (select case_id, entity_name as n from {{mentions}}) where not {JUNK_NAME}),
    deduped as (select * exclude (rn) from (
        select *, row_number() over (partition by case_id, substring(lower(trim(coalesce(entity_name, ''))), 1, 30), substring(lower(coalesce(signal_type, '')), 1, 20),
                                     cast(round(coalesce(normalized_amount, 0) / 10000) as bigint) * 10000 order by id) as rn from {{signals}}) where rn = 1),
    scored as (
        select d.*, not {NON_NUMERIC} as numeric, round(
            least(coalesce(normalized_amount, 0) / 1000000, 100) + case when k.k is not null and coalesce(entity_name, '') <> '' then 20 else 0 end + coalesce(financial_confidence * 10, 0)
            + case when coalesce(inferred_signal, false) then 0 else 8 end
            + case when coalesce(controlled_by, '') <> '' and coalesce(received_by, '') <> '' then 6 when coalesce(controlled_by, '') <> '' or coalesce(received_by, '') <> '' then 3 else 0 end
            + case when length(event_summary) > 40 then 4 else 0 end + case when coalesce(program_name, '') <> '' then 2 else 0 end - case when {NON_NUMERIC} then 15 else 0 end, 6) as score
        from deduped d left join known k on k.case_id = d.case_id and k.k = lower(d.entity_name)),
    placed as (select *, cast(row_number() over (partition by case_id, numeric order by score desc, id) as integer) as rank, bool_or(numeric) over (partition by case_id) as has_numeric from scored),
    top_signals as (select * from placed where (numeric and rank <= 5) or (not numeric and not has_numeric and rank <= 3))"""


def _known(spark, d):
    m = load(spark, d, "mentions")
    return m.filter(~compiling.junk_name(F.col("entity_name"))).select("case_id", name_key("entity_name").alias("name_key")).distinct()


def _ranked(spark, d):
    return money.ranked_signals(load(spark, d, "signals"), _known(spark, d))


PLANS = {
    "ledger": (
        lambda s, d: money.ledger(load(s, d, "signals")),
        f"""with {NUMERIC} select case_id, sum(normalized_amount) as total, count(*) as n_signals, count(distinct entity_name) as n_entities, count(distinct document_id) as n_documents,
            count(*) filter (signal_type = 'ALLOCATION') as n_allocations, count(*) filter (signal_type = 'ALLOCATION') > 0 and 2 * count(*) filter (signal_type = 'ALLOCATION') >= count(*) as budget_case
            from numeric_signals group by case_id""",
    ),
    "ledger_rows": (
        lambda s, d: money.ledger_rows(load(s, d, "signals")),
        f"""with {NUMERIC} select case_id, rank, id, entity_name, program_name, normalized_amount, signal_type from (
            select *, cast(row_number() over (partition by case_id order by normalized_amount desc, id) as integer) as rank from numeric_signals) where rank <= 30""",
    ),
    "signal_list": (
        lambda s, d: money.signal_list(load(s, d, "signals")).select("case_id", "id", "normalized_amount", "inferred_signal"),
        f"""with {NUMERIC},
            early as (select *, row_number() over (partition by case_id order by id) as rn from {{signals}} where case_id not in (select case_id from numeric_signals) and signal_type like 'NON_NUMERIC%' and coalesce(event_summary, '') <> '')
            select case_id, id, normalized_amount, coalesce(inferred_signal, false) as inferred_signal from numeric_signals union all select case_id, id, cast(null as double), true from early where rn <= 3""",
    ),
    "ranked_signals": (
        lambda s, d: _ranked(s, d).select("case_id", "rank", "id", "numeric", "score"),
        f"with {RANKED_SIGNALS} select case_id, rank, id, numeric, score from top_signals",
    ),
    "fused_signals": (
        lambda s, d: money.fused(_ranked(s, d)),
        f"""with {RANKED_SIGNALS}, keyed as (select *, coalesce(program_name, entity_name, '') as fusion_key, count(*) over (partition by case_id, coalesce(program_name, entity_name, '')) as same from top_signals),
            marked as (select *, same >= 2 and fusion_key <> '' and inferred_signal is null as shared from keyed)
            select case_id, id, fusion_key, case when shared then true else inferred_signal end as inferred_signal, round(case when shared then greatest(0.1, financial_confidence - 0.1) else financial_confidence end, 4) as financial_confidence from marked""",
    ),
    "red_flags": (
        lambda s, d: money.red_flags(load(s, d, "signals")),
        f"""with facts as (
            select case_id, max(normalized_amount) as largest, bool_or(regexp_matches(lower(coalesce(event_summary, '')), 'no-bid|sole source|emergency contract|direct award')) as no_bid, count(*) filter ({NON_NUMERIC}) as n_opaque,
                count(*) filter (inferred_signal) as n_inferred, count(*) filter (signal_type = 'AUDIT') as n_audit, coalesce(sum(normalized_amount) filter (signal_type = 'AUDIT'), 0.0::double) as audit_total,
                count(*) filter (signal_type = 'COST_OVERRUN') as n_overrun, coalesce(sum(normalized_amount) filter (signal_type = 'COST_OVERRUN'), 0.0::double) as overrun_total from {{signals}} group by case_id),
            paid as (select case_id, coalesce(received_by, entity_name) as receiver, sum(normalized_amount) as paid, count(*) as n_payments from {{signals}} where coalesce(received_by, entity_name) is not null and normalized_amount > 0 group by 1, 2),
            inflow as (select case_id, sum(paid) as inflow, max(n_payments) as most_payments from paid group by 1),
            best as (select case_id, receiver as top_receiver, paid as top_paid from (select *, row_number() over (partition by case_id order by paid desc, receiver) as rn from paid) where rn = 1)
            select *, cast(round(100 * top_paid / inflow) as bigint) as top_share, coalesce(top_paid >= 500000 and round(100 * top_paid / inflow) >= 40, false) as concentrated, coalesce(most_payments, 0) >= 3 as fragmented
            from facts left join inflow using (case_id) left join best using (case_id)""",
    ),
    "control_chains": (
        lambda s, d: money.control_chains(load(s, d, "signals")),
        f"""with {NUMERIC} select case_id, rank, id, concat_ws(' -> ', coalesce(controlled_by, entity_name), program_name, received_by) as chain, controlled_by is not null as has_controller, received_by is not null as has_receiver from (
            select *, cast(row_number() over (partition by case_id order by normalized_amount desc, id) as integer) as rank from numeric_signals) where rank <= 5""",
    ),
    "flow_trace": (
        lambda s, d: money.flow_trace(load(s, d, "signals"), party="summit"),
        f"""with kept as (select * from {{signals}} where not {NON_NUMERIC} and contains(lower(concat_ws('|', entity_name, controlled_by, received_by)), 'summit')),
            one as (select *, row_number() over (partition by case_id, lower(coalesce(entity_name, '')), normalized_amount, signal_type order by id) as rn from kept)
            select case_id, cast(row_number() over (partition by case_id order by normalized_amount desc nulls last, id) as integer) as rank, id, entity_name, normalized_amount, signal_type from one where rn = 1""",
    ),
    "back_linked_signals": (
        lambda s, d: money.back_linked(load(s, d, "signals").withColumn("event_summary", F.concat_ws(" ", "event_summary", "received_by")), load(s, d, "mentions")),
        """with s as (select id, case_id, document_id, entity_name, lower(concat_ws(' ', program_name, concat_ws(' ', event_summary, received_by))) as text from {signals}),
            found as (select s.id, arg_min(m.entity_name, m.id) as linked_name from s join {mentions} m on s.document_id = m.document_id where s.entity_name is null and contains(s.text, lower(m.entity_name)) group by s.id)
            select s.id, case_id, document_id, coalesce(entity_name, linked_name) as entity_name from s left join found using (id)""",
    ),
}
