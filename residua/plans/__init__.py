"""Queries over the driver tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from residua.plans import decision_queries, evaluation_queries, feature_queries, model_queries, pipeline, relation_queries

MODULES = (feature_queries, evaluation_queries, relation_queries, pipeline, decision_queries, model_queries)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
