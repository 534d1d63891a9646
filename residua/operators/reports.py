"""Reports that bring several measures together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions.features import LENGTH_BINS
from residua.operators import drift, metrics
from residua.operators.metrics import _r, ratio


def classifier_report(df: DataFrame, threshold: float = 0.5, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Counts, rates, losses, ranking and calibration error, one row for each group."""
    parts = [metrics.confusion(df, by, threshold), metrics.losses(df, by), metrics.ranking(df, by), metrics.ece(df, by)]
    out = parts[0]
    for part in parts[1:]:
        part = part.drop("samples")
        out = out.join(part, by) if by else out.crossJoin(part)  # one row each
    return out


def by_length(df: DataFrame, threshold: float = 0.5, system: str = "metrics") -> DataFrame:
    """Measures for each length bin of (y, p, len); a bin without rows has counts of 0 and nulls, one with a single class no AUROC."""
    names = list(dict.fromkeys(n for n, _ in LENGTH_BINS[system]))
    from residua.functions.features import length_bin_sql

    rows = metrics.valid(df).withColumn("bin", F.expr(length_bin_sql(system, "len")))
    every = df.sparkSession.createDataFrame([(n,) for n in names], "bin string")
    counts = metrics.confusion(rows, ["bin"], threshold)
    found = counts.join(metrics.ranking(rows, ["bin"]).select("bin", "auroc"), "bin").join(metrics.losses(rows, ["bin"]).select("bin", "brier"), "bin")
    pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    joined = every.join(found, "bin", "left")
    return joined.select(
        "bin", F.coalesce(pos + neg, F.lit(0)).alias("samples"), F.coalesce(pos, F.lit(0)).alias("positives"), F.when((pos > 0) & (neg > 0), F.col("auroc")).alias("auroc"),
        "balanced_accuracy", "sensitivity", "specificity", "ppv", "npv", "brier",
    )


#: Values from which a drift is worth a look, and from which it is critical.
ALERTS = {"psi": (0.10, 0.25), "abstention": (0.10, 0.15), "adversarial": (0.70, 0.80)}


def drift_report(base: DataFrame, now: DataFrame, adversarial: DataFrame | None = None, short: int = 15) -> DataFrame:
    """One row of shifts between two batches of (id, len, score, guard), with the alert level and what raised it.

    ``adversarial`` has one row with auroc, of telling the batches apart (see
    ``models.shifted``); without it that measure is null and raises nothing.
    Abstained are rows with a guard and those under ``short`` residues.
    """
    length = drift.psi(base, now, "len").select(F.col("psi").alias("length_psi"))
    score = drift.psi(base, now, "score").select(F.col("psi").alias("score_psi"))
    length_ks = drift.ks(base, now, "len").select(F.col("statistic").alias("length_ks"), F.col("p_value").alias("length_p"))
    score_ks = drift.ks(base, now, "score").select(F.col("statistic").alias("score_ks"), F.col("p_value").alias("score_p"))
    abstained = F.count_if((F.col("len") < short) | F.col("guard").isNotNull())
    batch = now.agg(F.count("*").alias("samples"), _r(ratio(abstained, F.count("*"))).alias("abstention"))
    size = base.agg(F.count("*").alias("baseline"))
    auroc = adversarial.select(F.col("auroc").alias("adversarial")) if adversarial is not None else now.sparkSession.range(1).select(F.lit(None).cast("double").alias("adversarial"))
    row = length
    for part in (score, length_ks, score_ks, batch, size, auroc):
        row = row.crossJoin(part)  # one row each
    kinds = {"length_psi": "psi", "score_psi": "psi", "adversarial": "adversarial", "abstention": "abstention"}
    reaches = lambda level: [F.coalesce(F.col(c) >= ALERTS[k][level], F.lit(False)) for c, k in kinds.items()]
    any_of = lambda tests: F.array_contains(F.array(*tests), True)
    level = F.when((F.col("samples") == 0) | (F.col("baseline") == 0), "GREEN").when(any_of(reaches(1)), "RED").when(any_of(reaches(0)), "YELLOW").otherwise("GREEN")
    raised = F.array_join(F.array_compact(F.array(*[F.when(t, c) for c, t in zip(kinds, reaches(0))])), ",")
    return row.select("*", level.alias("level"), raised.alias("raised"))


def backtest(df: DataFrame, needed: float = 0.85, least: int = 5) -> DataFrame:
    """(samples, auroc, auprc, status) of new entries (y, p): whether the ranking still holds."""
    row = metrics.ranking(df)
    return row.select("samples", "auroc", "auprc", F.when(F.coalesce("samples", F.lit(0)) < least, "INSUFFICIENT_ENTRIES").when(F.col("auroc") >= needed, "PASS").otherwise("RETRAIN_TRIGGERED").alias("status"))


def inventory(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """(stage, records, positives, negatives, prevalence, shortest, longest, residues) before and after a removal; of (id, label, len)."""

    def one(df: DataFrame, stage: str) -> DataFrame:
        positive = F.count_if(F.col("label") == 1)
        return df.agg(F.count("*").alias("records"), positive.alias("positives"), (F.count("*") - positive).alias("negatives"), _r(ratio(positive, F.count("*"))).alias("prevalence"), F.min("len").alias("shortest"), F.max("len").alias("longest"), F.sum("len").alias("residues")).select(F.lit(stage).alias("stage"), "*")

    return one(raw, "raw").union(one(clean, "clean"))
