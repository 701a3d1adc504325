"""All queries of the library by name, and the DuckDB SQL that each must equal."""

from __future__ import annotations

from casework.plans import case_plans, document_plans, graph_plans, money_plans, name_plans, rule_plans, search_plans, text_plans, triage_plans
from casework.sources.views import with_views

_ALL = {**money_plans.PLANS, **triage_plans.PLANS, **graph_plans.PLANS, **case_plans.PLANS, **text_plans.PLANS, **document_plans.PLANS, **rule_plans.PLANS, **name_plans.PLANS, **search_plans.PLANS}

QUERIES = {name: plan for name, (plan, _) in _ALL.items()}
ORACLE_SQL = {name: with_views(sql) for name, (_, sql) in _ALL.items() if sql}
