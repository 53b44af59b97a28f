"""All registered queries with their SQL statements."""

from __future__ import annotations

from rolesift.plans import artifact_queries, collect_queries, scoring_queries, text_queries

MODULES = [scoring_queries, text_queries, collect_queries, artifact_queries]


def queries() -> dict:
    return {name: function for m in MODULES for name, (function, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
