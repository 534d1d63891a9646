"""Made-up inputs that a screening should refuse, and tests of whether a score only follows a shortcut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters made of a digest, and the strings of each category, in the SQL of either engine.
BASE = "translate(md5(concat(CAST(n AS STRING), ':a')) || md5(concat(CAST(n AS STRING), ':b')), '0123456789abcdef', 'ACDEFGHIKLMNPQRS')"
CATEGORIES = {
    "plain": "base",
    "homopolymer": "repeat(substr(base, 1, 1), 30)",
    "low_complexity": "repeat(substr(base, 1, 2), 20)",
    "non_canonical": "substr(base, 1, 20) || 'X' || substr(base, 21, 10)",
    "too_short": "substr(base, 1, 4)",
    "modified": "'Ac-' || substr(base, 1, 20) || '-NH2'",
}


def ood_suite(spark: SparkSession, each: int = 50) -> DataFrame:
    """(id, category, sequence): ``each`` strings of every category, the same on every run."""
    out = None
    for i, (name, text) in enumerate(CATEGORIES.items()):
        rows = spark.range(i * each, (i + 1) * each).select(F.col("id").alias("n")).withColumn("base", F.expr(BASE))
        one = rows.select(F.col("n").alias("id"), F.lit(name).alias("category"), F.expr(text).alias("sequence"))
        out = one if out is None else out.union(one)
    return out


def permuted(df: DataFrame, times: int = 30, blocks: int = 256) -> DataFrame:
    """(k, id, y, p): labels exchanged at random between the rows of a block, ``times`` over.

    Blocks are cut by digest, so that no permutation passes through one task; give
    more of them for more rows. The rows of a block are sent once and sorted twice
    where they meet, so that nothing is joined.
    """
    rows = df.select("id", "y", "p").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(times))))
    word: Column = F.md5(F.concat_ws(":", F.col("k"), F.col("id")))
    rows = rows.withColumn("block", F.conv(F.substring(word, 1, 4), 16, 10).cast("int") % blocks)
    met = rows.groupBy("k", "block").agg(F.collect_list(F.struct("id", "y", "p")).alias("rows"))
    here = F.expr("array_sort(transform(rows, r -> struct(md5(concat_ws(':', k, r.id)) AS w, r.id AS id, r.p AS p)))")
    there = F.expr("array_sort(transform(rows, r -> struct(md5(md5(concat_ws(':', k, r.id))) AS w, r.id AS id, r.y AS y)))")
    pairs = met.select("k", F.explode(F.arrays_zip(here.alias("here"), there.alias("there"))).alias("m"))
    return pairs.select("k", "m.here.id", "m.there.y", "m.here.p")
