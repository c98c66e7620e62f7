"""Queries over the driver's tables, for each group of catalog operators, with DuckDB twins."""

from __future__ import annotations

from .plans import query_catalog, query_fields, query_jobs, query_profile, query_search, query_sketch, query_text

_MODULES = (query_catalog, query_search, query_profile, query_text, query_jobs, query_sketch, query_fields)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
