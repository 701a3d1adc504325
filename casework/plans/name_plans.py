"""Queries over names that stand for each other."""

from pyspark.sql import functions as F

from casework.operators import names, promotion
from casework.plans.document_plans import _view
from casework.plans.rule_plans import CASES, DECIDED, _decided, _features
from casework.sources.views import load

# Candidates whose names are longer, shorter or differ by a word from those of the case's entities.
CANDIDATES = """select distinct case_id, case id % 6 when 0 then concat('Greater ', entity_name) when 1 then split_part(entity_name, ' ', 1) when 2 then concat('North ', entity_name, ' Office') when 3 then concat(split_part(entity_name, ' ', 1), ' Relief Fund of the South')
    when 4 then concat('The ', entity_name) else concat(split_part(entity_name, ' ', 2), ' Fund') end as name from {mentions}"""
EXISTING = "select case_id, id, case when id % 3 = 0 then concat(name, ' Fund') when id % 3 = 1 then concat(split_part(name, ' ', 1), ' Relief Fund') else name end as name from {entities}"


def _words(c):
    return f"list_distinct(list_filter(string_split({c}, ' '), lambda w: length(w) > 2))"


def _match(a, b):
    shared = f"len(list_intersect({_words(a)}, {_words(b)}))::double / greatest(len({_words(a)}), len({_words(b)}), 1)"
    return f"({a} = {b} or (least(length({a}), length({b})) >= 4 and (contains({a}, {b}) or contains({b}, {a}))) or (least(length({a}), length({b})) >= 8 and {shared} >= 0.6::double))"


KEY = lambda c: f"regexp_replace(lower(trim({c})), '^the ', '')"

STAGED = """staged as (select *, case when is_promoted then 0 when is_extra then 1 when is_late then 2 end as stage, case when is_extra then round(trust + case when in_core then 0.20::double else 0.08::double end + case when in_front then 0.10::double else 0 end, 4)
        when is_late then round(trust + case when type in ('agency', 'organization') then 1.5::double else 0 end + case when in_quality then 2.0::double else 0 end, 4) end as by_score from lasts where is_promoted or is_extra or is_late),
    n as (select case_id, cluster, display_name, lower(trim(display_name)) as key, cast(row_number() over (partition by case_id order by stage, case when stage = 0 then pass end, by_score desc nulls last, first_id) as integer) as place from staged)"""


def _recovered(s, d):
    """As if only the first none, one or two names of each case had been promoted before."""
    first = _decided(s, d).filter("promotion_place <= case_id % 3").select("case_id", "cluster")
    return promotion.recovered(_features(s, d), first, _view(s, d, CASES, "orders").select("case_id", "target", "intent"))


PLANS = {
    "recovered_entities": (
        _recovered,
        f"""with {DECIDED}, {STAGED}, first as (select case_id, cluster from n where place <= case_id % 3), before as (select case_id, count(*) as n_before from first group by 1),
            d as (select t.*, coalesce(n_before, 0) as n_before, best_topic in ('HIGH', 'MEDIUM') and not contaminated_only and (in_front or title_hits >= 1) as good from trusted t left join before using (case_id) where not exists (select 1 from first f where f.case_id = t.case_id and f.cluster = t.cluster)),
            e as (select *, good and trust >= 0.81::double and n_documents >= 2 and role_weight >= 3 and in_quality as fit from d), f as (select *, fit and row_number() over (partition by case_id order by fit desc, first_id) <= 5 - n_before as several from e),
            g as (select *, n_before + sum(several::int) over (partition by case_id) as n_now from f), h as (select *, not several and good and trust >= 0.79::double and (role_weight >= 5 or type in ('agency', 'organization')) and n_now < 3 as alone from g),
            i as (select *, case when several then 1 when alone and row_number() over (partition by case_id order by alone desc, first_id) <= 5 - n_now then 2 end as recovery_pass from h)
            select case_id, cluster, display_name, trust, recovery_pass, cast(n_before + row_number() over (partition by case_id order by recovery_pass, first_id) as integer) as promotion_place from i where recovery_pass is not null""",
    ),
    "resolved_names": (
        lambda s, d: names.resolved(_view(s, d, CANDIDATES, "mentions"), _view(s, d, EXISTING, "entities")),
        f"""with c as (select case_id, name as candidate, {KEY('name')} as a from ({CANDIDATES})), e as (select case_id, id, name, {KEY('name')} as b from ({EXISTING})),
            m as (select c.case_id, candidate, arg_min(e.name, id) as canonical from c join e on c.case_id = e.case_id and {_match('a', 'b')} group by 1, 2) select case_id, candidate, canonical from c left join m using (case_id, candidate)""",
    ),
    "merged_names": (
        lambda s, d: promotion.merged(_decided(s, d)).select("case_id", F.col("promotion_place").alias("place"), "display_name", "final_name", "alias"),
        f"""with recursive {DECIDED}, {STAGED},
            r as (select case_id, 0 as place, '' as display_name, []::struct(key varchar, name varchar)[] as heads, '' as final_name from n where place = 1
                union all select case_id, place, display_name, case when head is null then list_append(heads, struct_pack(key := key, name := display_name)) else heads end, coalesce(head.name, display_name) from (
                    select n.case_id, n.place, n.key, n.display_name, r.heads, list_filter(r.heads, lambda h: {_match('h.key', 'n.key')})[1] as head from r join n on n.case_id = r.case_id and n.place = r.place + 1) x)
            select case_id, place, display_name, final_name, case when final_name <> display_name then display_name end as alias from r where place > 0""",
    ),
}
