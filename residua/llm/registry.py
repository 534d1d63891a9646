"""Queries of this subpackage, with their SQL, by name."""

from residua.llm import (
    p01_near_duplicates,
    p02_exact_spans,
    p03_groups,
    p04_clusters,
    p05_splits,
    p06_overlap,
    p07_layout,
    p08_packing,
    p09_leaks,
    p10_lookalikes,
)

MODULES = (p01_near_duplicates, p02_exact_spans, p03_groups, p04_clusters, p05_splits, p06_overlap, p07_layout, p08_packing, p09_leaks, p10_lookalikes)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql if isinstance(sql, str) else sql() for module in MODULES for name, sql in module.ORACLE.items()}
