"""SQL for DuckDB of fronts and crowding."""

from __future__ import annotations

#: Chains longer than this are taken to run in a cycle.
DEEPEST = 1000


def fronts_sql(source: str, objectives: list[str], margin: float, deepest: int = DEEPEST) -> tuple[str, str]:
    """CTEs ending in fr(vector..., front), and the condition that joins them to a table ``{t}``.

    The front of a vector is its longest chain of dominance. Values are compared
    in thousandths; a vector in or behind a cycle is missing.
    """
    m = round(margin * 1000)
    columns = ", ".join(f"CAST(round({o} * 1000) AS INT) AS v{i}" for i, o in enumerate(objectives))
    diff = [f"a.v{i} - b.v{i}" for i in range(len(objectives))]
    beats = " AND ".join(f"{d} >= -{m}" for d in diff) + " AND (" + " OR ".join(f"{d} > {m}" for d in diff) + ")"
    v = ", ".join(f"v{i}" for i in range(len(objectives)))
    join = " AND ".join(f"fr.v{i} = CAST(round({{t}}.{o} * 1000) AS INT)" for i, o in enumerate(objectives))
    text = f"""pt AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {v}) AS p, {v} FROM (SELECT DISTINCT {columns} FROM {source} WHERE {objectives[0]} IS NOT NULL)),
bt AS MATERIALIZED (SELECT a.p AS x, b.p AS y FROM pt a JOIN pt b ON {beats}),
ch(k, p) AS (SELECT 0, p FROM pt UNION SELECT ch.k + 1, bt.y FROM ch JOIN bt ON bt.x = ch.p WHERE ch.k < {deepest}),
fr AS (SELECT {v}, front FROM (SELECT p, max(k)::INT AS front FROM ch GROUP BY p) JOIN pt USING (p) WHERE front < {deepest})"""
    return text, join


def crowding_sql(source: str, objectives: list[str], key: str = "id") -> str:
    """SELECT of all columns of a table with front, and its crowding (null at the ends)."""
    span = lambda o: f"(max({o}) OVER f - min({o}) OVER f)"
    term = " + ".join(f"CASE WHEN {span(o)} > 0 THEN (lead({o}) OVER w{i} - lag({o}) OVER w{i}) / {span(o)} ELSE 0e0 END" for i, o in enumerate(objectives))
    windows = ", ".join(f"w{i} AS (PARTITION BY front ORDER BY {o}, {key})" for i, o in enumerate(objectives))
    return f"SELECT *, CASE WHEN front IS NOT NULL AND count(*) OVER f > 2 THEN {term} END AS crowded FROM {source} WINDOW f AS (PARTITION BY front), {windows}"
