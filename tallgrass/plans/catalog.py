"""All queries of the evidence operators, with the SQL that checks them."""

from __future__ import annotations

from . import contract_plans, split_plans, usage_plans, audit_plans, metric_plans, interval_plans, route_plans, context_plans, report_plans, graph_plans, compat_plans, source_plans, more_plans  # noqa: F401, I001  (in the order of their bindings)
from .bindings import ORACLES, QUERIES  # noqa: F401
