"""Registered queries, each with the SQL that computes the same rows."""

from __future__ import annotations

from normgraph.plans.queries import QUERIES


def queries() -> dict:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
