"""What a case lacks, what it shows, where to look next: codes and query strings from one row of facts a case.

Prose is the reader's; each rule gives a code, in a fixed order, and lists are cut after they are
made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.operators.ranking import case_of

LEGAL = ("LEGAL_ACTION", "AUDIT", "INVESTIGATION_STARTED")


def case_facts(cases: DataFrame, ranked_documents: DataFrame, ranked_entities: DataFrame, ranked_events: DataFrame, ranked_signals: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a case (case_id, ...) of the counts and names that the rules below read."""
    e, per = ranked_entities, lambda df, **c: df.groupBy("case_id").agg(*[v.alias(k) for k, v in c.items()])
    kind, primary = F.col("type"), F.col("is_primary")
    names = lambda p, n: F.transform(F.slice(F.array_sort(F.collect_list(F.when(p, F.struct("rank", "entity_name")))), 1, n), lambda x: x["entity_name"])
    person, org = primary & (kind == "person"), primary & ~kind.isin("person", "location")
    parts = (
        per(ranked_documents, n_documents=F.count("*")),
        per(e, n_entities=F.count_if(primary), n_multi=F.count_if(primary & (F.col("n_documents") >= 2)), n_confirmed=F.count_if(primary & (F.col("n_documents") >= 3)), n_persons=F.count_if(person), n_orgs=F.count_if(org), n_agencies=F.count_if(primary & kind.isin("agency", "government_agency")), persons=names(person, 2), orgs=names(org, 2)),
        per(ranked_events, n_events=F.count("*"), n_legal=F.count_if(F.col("event_type").isin(*LEGAL))),
        per(ranked_signals, n_signals=F.count("*"), n_numeric=F.count_if(F.col("normalized_amount") > 0)),
        per(edges, n_edges=F.count("*")),
    )
    out = cases
    for p in parts:
        out = out.join(p, "case_id", "left")
    numbers = [c for c, t in out.dtypes if c.startswith("n_")]
    return out.fillna(0, numbers).withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("persons", "orgs")})


def _codes(*rules: tuple) -> Column:
    """The codes of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(p, code) for p, code in rules]))


def gaps() -> Column:
    c = F.col
    money = c("mode").isin("funding_target", "scandal_target")
    single = (c("n_entities") > 0) & (c("n_multi") == 0)
    return _codes(
        (c("n_documents") == 0, "NO_DOCUMENTS"),
        ((c("n_documents") > 0) & (c("n_documents") < 3), "THIN_DOCUMENTS"),
        (c("n_entities") == 0, "NO_ENTITIES"),
        (single, "SINGLE_SOURCE_ENTITIES"),
        (single, "NO_CONFIRMED_ENTITY"),
        (c("n_events") == 0, "NO_EVENTS"),
        ((c("n_events") > 0) & (c("n_events") < 3), "SPARSE_TIMELINE"),
        ((c("n_signals") == 0) & money, "NO_SIGNALS_CRITICAL"),
        ((c("n_signals") == 0) & ~money, "NO_SIGNALS"),
        (c("n_signals") == 1, "ONE_SIGNAL"),
        ((c("mode") == "person_target") & (c("n_persons") == 0), "TARGET_PERSON_UNSEEN"),
        ((c("mode") == "organization_target") & (c("n_orgs") == 0), "TARGET_ORGANIZATION_UNSEEN"),
    )


def findings() -> Column:
    c = F.col
    tie = case_of(F.lit(None).cast("string"), ((c("n_persons") > 0) & (c("n_orgs") > 0), "PERSON_ORG_TIE"), (c("n_persons") >= 2, "PERSON_PAIR"), (c("n_orgs") > 0, "MAIN_ORG"))
    dense = case_of(F.lit(None).cast("string"), (c("n_edges") >= 3, "DENSE_NETWORK"), (c("n_entities") >= 3, "NO_LINKS"))
    rest = F.array_compact(F.array(tie, F.when(c("n_numeric") > 0, "TOP_AMOUNT"), F.when(c("n_legal") > 0, "LEGAL_EVENT"), dense, F.when(c("n_confirmed") > 0, "CONFIRMED_ENTITIES")))
    return F.slice(rest, 1, 6)


def angles() -> Column:
    """The first five angles, by mode, then by intent, then by what there is."""
    c = F.col
    money, person, org = c("n_signals") > 0, c("n_persons") > 0, c("n_orgs") > 0
    mode = lambda *m: c("mode").isin(*m)
    other = ~mode("person_target", "organization_target", "government_agency_target", "funding_target", "scandal_target", "program_target", "place_target")
    known = ("crime_corruption", "finance_funding", "housing_homelessness")
    rules = [
        (mode("person_target"), "ACCOUNTABILITY"), (mode("person_target") & money, "FOLLOW_MONEY"), (mode("person_target") & org, "AFFILIATIONS"),
        (mode("organization_target", "government_agency_target"), "OVERSIGHT"), (mode("organization_target", "government_agency_target") & money, "SPENDING"), (mode("organization_target", "government_agency_target") & person, "LEADERSHIP"),
        (mode("funding_target"), "GRANT_TRAIL"), (mode("funding_target"), "DELIVERY"), (mode("funding_target") & person, "BENEFICIARIES"),
        (mode("scandal_target"), "LEGAL_EXPOSURE"), (mode("scandal_target"), "COVER_UP"), (mode("scandal_target") & money, "MOTIVE"),
        (mode("program_target"), "EFFECTIVENESS"), (mode("program_target"), "CONTRACTING"), (mode("place_target"), "LOCAL_CORRUPTION"), (mode("place_target") & money, "PUBLIC_FUNDS"),
        (other & (c("intent") == known[0]), "CORRUPTION_PATTERN"), (other & (c("intent") == known[1]), "IRREGULARITIES"), (other & (c("intent") == known[2]), "CONTRACT_ACCOUNTABILITY"), (other & ~c("intent").isin(*known), "AGGREGATION"),
        ((c("n_events") > 0) & money, "MONEY_TIMELINE"), (c("n_entities") >= 4, "NETWORK"),
    ]
    return F.slice(F.array_distinct(_codes(*rules)), 1, 5)


def actions(quality: Column) -> Column:
    """The first six actions; an empty case has two of its own."""
    c = F.col
    some = _codes(
        ((c("n_documents") > 0) & (c("n_documents") < 3), "EXPAND_DOCUMENTS"),
        ((c("n_entities") >= 2) & (c("n_events") == 0), "MAP_RELATIONSHIP"),
        (c("n_legal") == 0, "SEARCH_OVERSIGHT_RECORDS"),
        (c("n_signals") > 0, "PULL_DISCLOSURES"),
        (c("n_signals") == 0, "REQUEST_SPENDING_RECORDS"),
        (c("n_agencies") > 0, "FILE_RECORDS_REQUEST"),
        (F.lit(True), "UPGRADE_SOURCES"),
        (c("n_events") < 3, "RECONSTRUCT_TIMELINE"),
    )
    return F.when(quality == "EMPTY", F.array(F.lit("RUN_INGEST"), F.lit("START_OFFICIAL"))).otherwise(F.slice(some, 1, 6))


# Ends of query strings by mode, for each of two persons and two organizations.
PERSON_ENDS = {
    "person_target": ["investigation OR indictment OR lawsuit OR audit", "contract OR funding OR grant OR payment"],
    "funding_target": ['"conflict of interest" OR award OR contract'],
    "government_agency_target": ['"conflict of interest" OR award OR contract'],
    "scandal_target": ["charges OR indicted OR convicted OR plea OR court filing", "whistleblower OR complaint OR affidavit"],
    "": ["investigation OR lawsuit OR indictment"],
}
ORG_ENDS = {
    "funding_target": ["contract award OR procurement OR grant OR spending", "inspector general OR audit report OR oversight"],
    "government_agency_target": ["contract award OR procurement OR grant OR spending", "inspector general OR audit report OR oversight"],
    "scandal_target": ["misconduct OR investigation OR subpoena OR settlement"],
    "organization_target": ["contract OR grant OR lobbying OR disclosure", "audit OR lawsuit OR regulatory action"],
    "": ["contract OR grant OR award OR audit"],
}
ORG_FIRST = ("funding_target", "government_agency_target", "organization_target")
# Ends of the first queries of a target, by mode.
SEED_ENDS = {
    "person_target": " investigation, lawsuit, contract, funding, records, donations, payments, PAC, nonprofit, board, indictment, settlement, subpoena",
    "organization_target": " contract, budget, audit, lawsuit, oversight, procurement, funding, grants, scandal, federal investigation, whistleblower, report",
    "government_agency_target": " contract, budget, audit, lawsuit, oversight, procurement, funding, grants, scandal, federal investigation, whistleblower, report",
    "funding_target": " funding, spending, contract, grant, budget, appropriation, audit, procurement, misuse, oversight, fraud, payments",
    "scandal_target": " investigation, records, deposition, affidavit, indictment, complaint, audit, report, court filing, whistleblower, internal review, oversight",
    "program_target": " budget, contracts, audit, oversight, funding, procurement, accountability, report, grant, investigation",
    "place_target": " contracts, budget, corruption, audit, investigation, funding, officials, procurement, misconduct",
    "event_target": " investigation, report, records, accountability, documents, officials, oversight, timeline",
}
# Ends for the other modes, first those of all, then by intent.
GENERAL_ENDS = " investigation, contracts, funding"
INTENT_ENDS = {
    "housing_homelessness": " shelter contracts, housing funding, program audit, accountability",
    "finance_funding": " contracts, grant award, budget allocation, procurement",
    "education_university": " contracts, funding, audit investigation, grant",
    "crime_corruption": " investigation, indictment, fraud audit, corruption charges",
    "legal_lawsuit": " lawsuit, court filing, settlement, legal action",
    "entertainment_film": " tax credit, film incentive funding, production subsidy",
    "policy_government": " contracts, oversight audit, program funding, accountability",
    "": " investigation, contracts, funding, program",
}
#: Modes whose target is a query of its own; queries of the other modes.
WITH_TARGET, MOST_GENERAL = ("program_target", "place_target", "event_target"), 10
QUOTED = ("person_target", "organization_target", "government_agency_target")


def _ends(names: Column, ends: list[str]) -> Column:
    return F.flatten(F.transform(names, lambda n: F.array(*[F.concat(F.lit('"'), n, F.lit(f'" {e}')) for e in ends])))


def next_queries(title: Column) -> Column:
    """The first six distinct query strings, from the top names by mode, then from words of the title."""
    c = F.col
    of = lambda names, ends: case_of(_ends(names, ends[""]), *[(c("mode") == m, _ends(names, ends[m]) if m in ends else F.array().cast("array<string>")) for m in (*PERSON_ENDS, *ORG_ENDS) if m])
    persons, orgs = of(c("persons"), PERSON_ENDS), of(c("orgs"), ORG_ENDS)
    partner = F.transform(c("orgs"), lambda o: F.concat(F.lit('"'), o, F.lit('" "'), F.coalesce(F.try_element_at(c("persons"), F.lit(1)), title), F.lit('" records OR contract')))
    board = F.transform(c("persons"), lambda p: F.concat(F.lit('"'), p, F.lit('" "'), F.coalesce(F.try_element_at(c("orgs"), F.lit(1)), F.lit("")), F.lit('" board OR salary OR conflict')))
    named = case_of(F.concat(persons, orgs), (c("mode") == "person_target", F.concat(persons, partner)), (c("mode") == "organization_target", F.concat(orgs, board)), (c("mode").isin(*ORG_FIRST), F.concat(orgs, persons)))
    words = F.filter(F.split(F.lower(title), r"\s+"), lambda w: (F.length(w) > 4) & ~w.isin("about", "these", "their", "there", "which", "where"))
    first = lambda n: F.array_join(F.slice(words, 1, n), " ")
    none = F.array().cast("array<string>")
    extra = F.when((F.size(words) >= 2) & (F.size(named) < 5), F.array(F.concat(first(3), F.lit(' audit OR "inspector general" OR oversight')))).otherwise(none)
    so_far = F.size(named) + F.size(extra)
    tail = case_of(none, ((c("intent") == "crime_corruption") & (so_far < 5), F.array(F.concat(first(2), F.lit(" bribery OR kickback OR embezzlement OR fraud")))), ((c("intent") == "finance_funding") & (so_far < 5), F.array(F.concat(first(2), F.lit(' "no-bid contract" OR "sole source" OR procurement fraud')))))
    return F.slice(F.array_distinct(F.concat(named, extra, tail)), 1, 6)


def seed_queries(target: Column, mode: Column, intent: Column | None = None) -> Column:
    """The distinct query strings that a target starts with, by mode; other modes by the intent of the case."""
    base = F.trim(target)
    quoted = F.when(mode.isin(*QUOTED), F.concat(F.lit('"'), base, F.lit('"'))).otherwise(base)
    ends = lambda said: F.array(*[F.concat(quoted, F.lit(" " + e.strip())) for e in said.split(",")])
    rules = [(mode == m, F.concat(F.array(quoted), ends(x)) if m in (*QUOTED, *WITH_TARGET) else ends(x)) for m, x in SEED_ENDS.items()]
    by_intent = case_of(ends(INTENT_ENDS[""]), *[(intent == k, ends(x)) for k, x in INTENT_ENDS.items() if k]) if intent is not None else ends(INTENT_ENDS[""])
    general = F.slice(F.array_distinct(F.concat(F.array(base), ends(GENERAL_ENDS), by_intent)), 1, MOST_GENERAL)
    return F.array_distinct(case_of(general, *rules))
