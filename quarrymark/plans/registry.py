"""All queries of the core, and their SQL."""

from __future__ import annotations

from quarrymark.plans import column_queries, core_problems, gate_queries, inventory_queries, relation_queries, schema_queries

MODULES = [core_problems, column_queries, relation_queries, gate_queries, schema_queries, inventory_queries]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
