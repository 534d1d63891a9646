"""Problem 3: one group identifier for all records that pairwise matches link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm.forests import components


def canonical_id(column: str) -> Column:
    """Id in upper case without spaces and tabs around it."""
    return F.upper(F.regexp_replace(column, r"^[ \t]+|[ \t]+$", ""))


def grouped(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(seq_id, group_id) of every id that a row pairs with another id.

    ``group_id`` is the smallest id, by code point, among all ids linked
    directly or through others. Rows with a null id and rows that name one id
    twice link nothing; an id named only in such rows is left out. Repeated and
    reversed pairs change nothing; other columns are not read; an empty table
    gives an empty result.
    """
    pair = pairs.select(canonical_id(left).alias("a"), canonical_id(right).alias("b")).where("a <> b")
    pair = pair.select("a", "b", F.xxhash64("a").alias("x"), F.xxhash64("b").alias("y"))
    label = components(pair.select("x", "y"))
    names = pair.select(F.col("a").alias("seq_id"), F.col("x").alias("node")).union(pair.select("b", "y")).distinct()
    named = names.join(label, "node")
    first = named.groupBy("root").agg(F.min("seq_id").alias("group_id"))
    return named.join(first, "root").select("seq_id", "group_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.read.parquet(f"{sf_dir}/dataset_inventory.parquet")
    return grouped(pairs, "removed_id", "retained_duplicate_id")


def p3_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group with its size and the number of inventory rows that fall into it."""
    pairs = spark.read.parquet(f"{sf_dir}/dataset_inventory.parquet")
    groups = grouped(pairs, "removed_id", "retained_duplicate_id")
    rows = pairs.select(canonical_id("removed_id").alias("seq_id"), canonical_id("retained_duplicate_id").alias("other")).where("seq_id <> other")
    links = rows.join(groups, "seq_id").groupBy("group_id").agg(F.count("*").alias("pair_rows"))
    return groups.groupBy("group_id").agg(F.count("*").alias("members")).join(links, "group_id")


QUERIES = {"p3_found": p3_found, "p3_group_sizes": p3_group_sizes}

_LINKS = r"""
WITH RECURSIVE pair AS (
  SELECT DISTINCT upper(trim(removed_id, E' \t')) AS a, upper(trim(retained_duplicate_id, E' \t')) AS b
  FROM dataset_inventory),
link AS (SELECT a, b FROM pair WHERE a <> b UNION SELECT b, a FROM pair WHERE a <> b),
reach(seq_id, other) AS (
  SELECT a, a FROM link UNION SELECT r.seq_id, l.b FROM reach r JOIN link l ON l.a = r.other),
found AS (SELECT seq_id, min(other) AS group_id FROM reach GROUP BY seq_id)
"""
ORACLE = {
    "p3_found": _LINKS + "SELECT seq_id, group_id FROM found",
    "p3_group_sizes": _LINKS
    + r"""SELECT f.group_id, count(*) AS members, any_value(n.pair_rows) AS pair_rows
FROM found f JOIN (
  SELECT g.group_id, count(*) AS pair_rows FROM dataset_inventory d
  JOIN found g ON g.seq_id = upper(trim(d.removed_id, E' \t'))
  WHERE upper(trim(d.removed_id, E' \t')) <> upper(trim(d.retained_duplicate_id, E' \t')) GROUP BY g.group_id) n
ON n.group_id = f.group_id GROUP BY f.group_id""",
}
