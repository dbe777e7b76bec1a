"""Registry of the queries and of their DuckDB twins."""

from __future__ import annotations

from verdigris.plans import etl, notes, project, records, retrieval, state, streams, upgrade

_PLANS = (upgrade, project, state, records, retrieval, etl, notes, streams)
QUERIES: dict = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLES: dict = {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
