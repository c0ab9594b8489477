"""All queries of the engine proper, by name, with their SQL."""

from __future__ import annotations

from lakeward.plans import audit_queries, correlation_queries, discovery_queries, evidence_queries, listing_queries, log_queries, serving_queries, source_queries

_MODULES = (discovery_queries, audit_queries, correlation_queries, serving_queries, listing_queries, log_queries, source_queries, evidence_queries)

QUERIES: dict = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
