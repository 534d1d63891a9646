"""Thresholds by cost and by rule, votes, and what follows from scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.operators.metrics import _r, constrained_threshold, ratio, threshold_table


def bayes_threshold(cost_fn: float, cost_fp: float) -> float:
    """Probability from which calling positive costs less in expectation; costs must be positive."""
    if cost_fn <= 0 or cost_fp <= 0:
        raise ValueError(f"costs must be positive: {cost_fn}, {cost_fp}")
    return round(cost_fp / (cost_fp + cost_fn), 4)


def cost_grid(steps: int = 200, low: float = 0.01, high: float = 0.99) -> list[float]:
    """Evenly spaced thresholds."""
    return [round(low + i * (high - low) / (steps - 1), 9) for i in range(steps)]


def cost_optimal(df: DataFrame, cost_fn: float, cost_fp: float, prevalence: float, grid: list[float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by..., threshold, cost, sensitivity, fpr, samples, positives): the grid threshold of least expected cost.

    Costs are those of one candidate at the given prevalence; equal costs go to
    the lower threshold. A rate without any case is 0.
    """
    counts = threshold_table(df, grid, by)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    rows = counts.select(*by, "threshold", ratio(tp, tp + fn).alias("s"), ratio(fp, fp + tn).alias("f"), (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("samples"), (F.col("tp") + F.col("fn")).alias("positives"))
    cost = _r((1 - F.col("s")) * (prevalence * cost_fn) + F.col("f") * ((1 - prevalence) * cost_fp), 9)
    best = rows.withColumn("cost", cost).groupBy(*by).agg(F.min_by(F.struct("threshold", "cost", "s", "f", "samples", "positives"), F.struct("cost", "threshold")).alias("m"))
    return best.select(*by, "m.threshold", _r(F.col("m.cost"), 2).alias("cost"), _r(F.col("m.s")).alias("sensitivity"), _r(F.col("m.f")).alias("fpr"), "m.samples", "m.positives")


def cost_optimal_by(df: DataFrame, by: str, names: list[str], cost_fn: float, cost_fp: float, prevalence: float, grid: list[float], least: int = 5) -> DataFrame:
    """(by, threshold, cost, basis) for every one of ``names``; groups with too few rows or no positive take the threshold of all rows."""
    spark = df.sparkSession
    whole = cost_optimal(df, cost_fn, cost_fp, prevalence, grid).select(F.col("threshold").alias("t"), F.col("cost").alias("c"))
    own = cost_optimal(df, cost_fn, cost_fp, prevalence, grid, [by]).where((F.col("samples") >= least) & (F.col("positives") > 0))
    every = spark.createDataFrame([(n,) for n in names], f"{by} string")
    joined = every.join(own, by, "left").crossJoin(F.broadcast(whole))  # one row
    return joined.select(by, F.coalesce("threshold", "t").alias("threshold"), F.coalesce("cost", "c").alias("cost"), F.when(F.col("threshold").isNull(), "all").otherwise("own").alias("basis"))


def decided(df: DataFrame, rules: dict[tuple[str, str], dict[str, float]], grid: list[float]) -> DataFrame:
    """(profile, task, threshold, basis, recall, fpr) by the rule of each profile and task.

    ``df`` has task, y and p. A rule with both costs takes the threshold of
    least loss, whatever else it says; another one searches the grid under its
    least recall and most false positives.
    """
    out = []
    for (profile, task), rule in rules.items():
        names = [F.lit(profile).alias("profile"), F.lit(task).alias("task")]
        if "cost_fn" in rule and "cost_fp" in rule:
            none = F.lit(None).cast("double")
            cut = F.lit(bayes_threshold(rule["cost_fn"], rule["cost_fp"]))
            out.append(df.sparkSession.range(1).select(*names, cut.alias("threshold"), F.lit("bayes_optimal").alias("basis"), none.alias("recall"), none.alias("fpr")))
        else:
            found = constrained_threshold(df.where(F.col("task") == task), grid, rule.get("recall"), rule.get("fpr"))
            out.append(found.select(*names, "threshold", "basis", "recall", "fpr"))
    return reduce(DataFrame.union, out)


def soft_vote(scores: list[str], weights: list[float] | None = None) -> Column:
    """Weighted mean of the scores that are there; null where none is."""
    weights = weights or [1.0] * len(scores)
    top = sum((F.coalesce(F.col(s) * w, F.lit(0.0)) for s, w in zip(scores, weights)), F.lit(0.0))
    bottom = sum((F.when(F.col(s).isNotNull(), F.lit(float(w))).otherwise(0.0) for s, w in zip(scores, weights)), F.lit(0.0))
    return F.when(bottom > 0, top / bottom)


def majority_vote(scores: list[str], threshold: float = 0.5) -> Column:
    """1 where more than half of the scores that are there reach the threshold; null where none is."""
    yes = sum((F.coalesce((F.col(s) >= threshold).cast("int"), F.lit(0)) for s in scores), F.lit(0))
    there = sum((F.col(s).isNotNull().cast("int") for s in scores), F.lit(0))
    return F.when(there > 0, (yes * 2 > there).cast("int"))


def routed(kind: str, thresholds: dict[str, float], score: str) -> tuple[Column, Column]:
    """(decision, reason): 1 or 0 by the threshold of the row's kind; null with the reason where there is none."""
    cut = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])
    at = F.try_element_at(cut, F.col(kind))
    reason = F.when(F.col(kind).isNull(), "unsupported_organism").when(at.isNull(), "no_model").when(F.col(score).isNull(), "no_score")
    return F.when(reason.isNull(), (F.col(score) >= at).cast("int")), reason


def flags_table(rates: DataFrame, prevalences: list[float], flags: int = 100) -> DataFrame:
    """(…, prevalence, true_flags, false_flags, screened_per_true): what of 100 flags is true at each prevalence.

    ``rates`` has sensitivity and specificity. Where nothing true is flagged the last column is null.
    """
    rows = rates.select("*", F.explode(F.array(*[F.lit(p) for p in prevalences])).alias("prevalence"))
    hit, false = F.col("sensitivity") * F.col("prevalence"), (1 - F.col("specificity")) * (1 - F.col("prevalence"))
    ppv = F.when(hit + false > 0, hit / (hit + false)).otherwise(0.0)
    return rows.withColumn("_ppv", ppv).select(*rows.columns, _r(F.col("_ppv") * flags, 1).alias("true_flags"), _r((1 - F.col("_ppv")) * flags, 1).alias("false_flags"), F.when(F.col("_ppv") > 0, _r(1 / F.col("_ppv"), 1)).alias("screened_per_true")).drop("_ppv")


def first_wins(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in the order; rows with a null key are left out.

    One partial minimum per task and key, so that a frequent key is no burden.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(row, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_r"))
    return first.select("_r.*")


def compared_ranks(df: DataFrame, one: str, two: str, key: str = "id") -> DataFrame:
    """(id, rank_one, rank_two, moved) of two orders by descending score, ties by key."""
    from residua.operators.metrics import ranked

    rows = ranked(ranked(df.select(key, one, two), [F.desc(one), F.col(key)], name="rank_one"), [F.desc(two), F.col(key)], name="rank_two")
    return rows.select(key, "rank_one", "rank_two", (F.col("rank_one") - F.col("rank_two")).alias("moved"))


def hit_rate(df: DataFrame, score: str = "p") -> DataFrame:
    """(good, hits, hit_rate): how many of the positives stand among as many highest scores."""
    from residua.operators.metrics import ranked, valid

    rows = ranked(valid(df), [F.desc(score), F.col("id")])
    good = rows.agg(F.sum(F.col("y").cast("long")).alias("good"))
    hits = rows.crossJoin(F.broadcast(good)).where("rank <= good").agg(F.coalesce(F.sum(F.col("y").cast("long")), F.lit(0)).alias("hits"), F.max("good").alias("good"))  # one row
    return hits.select(F.coalesce("good", F.lit(0)).alias("good"), "hits", _r(F.col("hits") / F.greatest(F.coalesce("good", F.lit(0)), F.lit(1))).alias("hit_rate"))


def subspaces(dims: int, count: int = 25, share: float = 0.5) -> list[list[int]]:
    """Places of each random subspace, by digests; each has half of the places."""
    import hashlib

    return [sorted(sorted(range(dims), key=lambda d: hashlib.md5(f"{s}:{d}".encode()).hexdigest())[: int(dims * share)]) for s in range(count)]  # noqa: B023


def in_order(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """Adds ``place``, the row's number within a group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
