"""Shifts between a baseline and a production batch."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.operators.metrics import _r, running


def psi(base: DataFrame, now: DataFrame, column: str, buckets: int = 10, eps: float = 1e-4) -> DataFrame:
    """(psi): population stability over the baseline's quantile buckets, outer ones open.

    The bounds are the only thing both sides share; each side is one aggregation
    into at most ``buckets`` rows. Equal bounds make empty buckets, as they do in
    a histogram. An empty side gives 0.
    """
    cuts = ", ".join(f"{i / buckets}D" for i in range(1, buckets))
    bounds = base.agg(F.expr(f"percentile(CAST({column} AS DOUBLE), array({cuts}))").alias("b"))

    def mix(df: DataFrame, name: str) -> DataFrame:
        placed = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")).crossJoin(F.broadcast(bounds))  # one row
        counted = placed.groupBy(F.size(F.filter("b", lambda x: x <= F.col("v"))).alias("bucket")).agg(F.count("*").alias("n"))
        return counted.select("bucket", F.col("n").alias(name))

    every = base.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(mix(base, "e"), "bucket", "left").join(mix(now, "a"), "bucket", "left").na.fill(0)
    totals = both.agg(F.sum("e").alias("te"), F.sum("a").alias("ta"))
    rows = both.crossJoin(F.broadcast(totals))  # one row
    e, a = F.col("e") / F.greatest("te", F.lit(1)) + eps, F.col("a") / F.greatest("ta", F.lit(1)) + eps
    total = F.sum((a - e) * F.ln(a / e))
    return rows.agg(_r(F.when((F.max("te") > 0) & (F.max("ta") > 0), F.greatest(F.lit(0.0), total)).otherwise(0.0)).alias("psi"))


def ks(base: DataFrame, now: DataFrame, column: str) -> DataFrame:
    """(statistic, n_base, n_now, p_value): largest gap of the two distribution functions.

    The p-value is the asymptotic series. Equal values are combined first. Where
    one side is empty, statistic and p-value are null.
    """
    both = base.select(F.col(column).alias("v"), F.lit(1).alias("e"), F.lit(0).alias("a")).unionAll(now.select(column, F.lit(0), F.lit(1))).where("v is not null")
    ties = both.groupBy("v").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    steps = running(ties, F.col("v"), {"ce": "e", "ca": "a"})
    totals = ties.agg(F.sum("e").alias("te"), F.sum("a").alias("ta"))
    gap = F.abs(F.col("ce") / F.greatest("te", F.lit(1)) - F.col("ca") / F.greatest("ta", F.lit(1)))
    d = steps.crossJoin(F.broadcast(totals)).agg(F.max(gap).alias("d"), F.max("te").alias("n_base"), F.max("ta").alias("n_now"))  # one row
    both = (F.col("n_base") > 0) & (F.col("n_now") > 0)
    d = d.where(both).union(d.where(~F.coalesce(both, F.lit(False))).select(F.lit(None).cast("double"), "n_base", "n_now"))
    root = F.sqrt(F.greatest(F.col("n_base") * F.col("n_now"), F.lit(1)) / F.greatest(F.col("n_base") + F.col("n_now"), F.lit(1)))
    lam = (root + 0.12 + 0.11 / root) * F.col("d")
    series = sum((F.exp(-2.0 * k * k * lam * lam) * (2.0 * (-1) ** (k - 1)) for k in range(1, 21)), F.lit(0.0))
    p = F.when(F.col("d").isNull(), F.lit(None)).when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))
    return d.select(_r(F.col("d")).alias("statistic"), "n_base", "n_now", _r(p, 6).alias("p_value"))


def mean_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """(id, name): mean rank of each value; ties are combined before they are ranked."""
    ties = df.groupBy(column).agg(F.count("*").alias("m"))
    steps = running(ties, F.col(column), {"upto": "m"})
    return df.select("id", column).join(steps.select(column, (F.col("upto") - (F.col("m") - 1) / 2).alias(name)), column).select("id", name)


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """(pearson, spearman) of two columns of a table with id; null where one does not vary."""
    rows = df.where(f"{x} is not null and {y} is not null").select("id", F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    ranks = mean_ranks(rows, x, "rx").join(mean_ranks(rows, y, "ry"), "id")
    both = rows.agg(F.corr(x, y).alias("p")).crossJoin(ranks.agg(F.corr("rx", "ry").alias("s")))  # one row each
    return both.select(_r(F.col("p")).alias("pearson"), _r(F.col("s")).alias("spearman"))


def student_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation by the t distribution with n - 2 degrees of freedom."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if abs(r) >= 1 and n >= 3 else 1.0
    df = n - 2
    x = df / (df + r * r * df / (1 - r * r))
    return _beta_regularized(df / 2, 0.5, x)


def _beta_regularized(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_regularized(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # series of the hypergeometric function, which converges for x below the mean
    term = total = 1.0
    k = 0
    while abs(term) > 1e-16 * abs(total) and k < 100_000:
        term *= x * (a + b + k) / (a + 1 + k)
        total += term
        k += 1
    return front * total


def shadow(production: DataFrame, candidate: DataFrame, k: int = 5, tripwire: float = 0.1) -> DataFrame:
    """Agreement of two scored batches (id, score, status): top-k overlap, differences, rank correlation."""
    top = lambda d: d.orderBy(F.desc("score"), "id").limit(k).select("id")
    common = top(production).join(top(candidate), "id").agg(F.count("*").alias("common"))
    pair = production.select("id", F.col("score").alias("s"), F.col("status").alias("t")).join(candidate.select("id", F.col("score").alias("c"), F.col("status").alias("u")), "id")
    delta = F.abs(F.col("s") - F.col("c"))
    sums = pair.agg(F.count("*").alias("batch_size"), _r(F.avg(delta)).alias("mean_delta"), _r(F.max(delta)).alias("max_delta"), F.count_if(~F.col("t").eqNullSafe(F.col("u"))).alias("disagreements"))
    rate = F.col("disagreements") / F.greatest("batch_size", F.lit(1))
    out = sums.crossJoin(common).crossJoin(correlations(pair, "s", "c").select("spearman"))  # one row each
    return out.select(
        "batch_size", _r(F.col("common") / (2 * k - F.col("common"))).alias("top_overlap"), F.coalesce("spearman", F.lit(1.0)).alias("spearman"), "mean_delta", "max_delta",
        "disagreements", _r(rate).alias("disagreement_rate"), F.when(rate > tripwire, "ROLLED_BACK").otherwise("HEALTHY").alias("canary_status"),
    )


def mix(df: DataFrame, bin_: Column) -> DataFrame:
    """(bin, n, fraction) of a binning."""
    counted = df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(df.agg(F.count("*").alias("t")))).select("bin", "n", _r(F.col("n") / F.col("t")).alias("fraction"))  # one row

