"""All registered queries and their DuckDB twins, gathered from the plan modules."""

from __future__ import annotations

from folioflow.plans import evaluation, extraction, governance, logs, preparation, retrieval, streams

FLAGSHIP = "g3_retrieve"

QUERIES: dict = {}
ORACLES: dict = {}

for module in (governance, extraction, preparation, retrieval, logs, evaluation, streams):
    for name, (query, sql) in module.PLANS.items():
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
