"""Prediction sets with finite-sample quantiles per class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.operators.metrics import _r, running, valid


def quantiles(calibration: DataFrame, alpha: float = 0.05, conditioned: bool = True) -> DataFrame:
    """(y, n, k, q): the k-th smallest nonconformity of each class, k = ceil((n + 1)(1 - alpha)).

    Where k exceeds n the quantile is 1. Unconditioned, all rows are one class
    (y is null) and k is clipped to n. Only scores around the k-th place are
    looked at: scores are combined by value before they are ranked.
    """
    score = F.when(F.col("y") == 1, 1 - F.col("p")).otherwise(F.col("p"))
    rows = valid(calibration).select((F.col("y") if conditioned else F.lit(-1)).cast("int").alias("y"), score.alias("s"))
    ties = rows.groupBy("y", "s").agg(F.count("*").alias("m"))
    sizes = ties.groupBy("y").agg(F.sum("m").alias("n")).withColumn("k", F.ceil(F.round((F.col("n") + 1) * (1 - alpha), 9)))
    if not conditioned:
        sizes = sizes.withColumn("k", F.least("k", "n"))
    # at most two rows: what comes before each class in the order of (class, score)
    sizes = sizes.withColumn("before", F.sum("n").over(Window.orderBy("y")) - F.col("n"))
    steps = running(ties, [F.col("y"), F.col("s")], {"upto": "m"}).join(F.broadcast(sizes), "y")
    found = steps.groupBy("y", "n", "k").agg(F.min(F.when(F.col("upto") - F.col("before") >= F.col("k"), F.col("s"))).alias("q"))
    return found.select(F.when(F.col("y") >= 0, F.col("y")).alias("y"), "n", "k", F.coalesce("q", F.lit(1.0)).alias("q"))


def sets(df: DataFrame, q0: Column, q1: Column) -> DataFrame:
    """Adds in_0, in_1, set_size and status to rows with p."""
    in_0, in_1 = F.col("p") <= q0, (1 - F.col("p")) <= q1
    size = in_0.cast("int") + in_1.cast("int")
    return df.select("*", in_0.alias("in_0"), in_1.alias("in_1"), size.alias("set_size"), F.when(size == 1, "classified").when(size == 2, "uncertain").otherwise("abstain").alias("status"))


def coverage(df: DataFrame, by: list[str]) -> DataFrame:
    """Coverage and set sizes for all rows, and for every single one of the columns ``by``.

    One pass over grouping sets; a null in a column means all of its values, and
    ``over`` names the column that a row divides by.
    """
    covered = F.when(F.col("y") == 1, F.col("in_1")).otherwise(F.col("in_0"))
    rows = df.where("y is not null and p is not null").withColumn("covered", covered.cast("int"))
    measures = [F.count("*").alias("n"), _r(F.avg("covered")).alias("coverage"), _r(F.avg("set_size")).alias("mean_set_size"), _r(F.avg((F.col("set_size") == 2).cast("int"))).alias("uncertain"), _r(F.avg((F.col("set_size") == 0).cast("int"))).alias("empty")]
    out = rows.groupingSets([[], *[[F.col(c)] for c in by]], *[F.col(c) for c in by]).agg(F.grouping_id().alias("g"), *measures)
    over = F.when(F.col("g") == 2 ** len(by) - 1, "all")
    value = F.lit(None).cast("string")
    for i, c in enumerate(by):
        mask = (2 ** len(by) - 1) ^ (1 << (len(by) - 1 - i))
        over = over.when(F.col("g") == mask, c)
        value = F.when(F.col("g") == mask, F.col(c).cast("string")).otherwise(value)
    return out.select(over.alias("over"), value.alias("value"), "n", "coverage", "mean_set_size", "uncertain", "empty")
