"""All registered queries of the engine, by name."""

from __future__ import annotations

from lexiloom.plans import model_queries, relation_queries, stat_queries, structure_queries

_MODULES = (stat_queries, relation_queries, structure_queries, model_queries)


def queries() -> dict:
    return {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
