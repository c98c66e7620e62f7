"""Operators for training-data corpora, with their queries and oracle SQL."""

from __future__ import annotations

from . import exact_dedup, minhash, mixing, neighbors, periodic_runs, pieces, quality_classifier, quality_rules, secrets, sharding, spelling, suffixes, url_filter

_MODULES = (quality_rules, secrets, url_filter, mixing, quality_classifier, minhash, neighbors, pieces, sharding, suffixes, exact_dedup, periodic_runs, spelling)


def queries() -> dict:
    """The opN_<name> functions of the operator modules, by name, and the queries beside them."""
    dealt = {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and name[2:3].isdigit()}
    return dealt | {name: f for m in _MODULES for name, f in getattr(m, "QUERIES", {}).items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
