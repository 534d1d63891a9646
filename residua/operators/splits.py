"""Folds that keep groups together, and audits of splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_fold(group: str, folds: int = 5) -> Column:
    """Fold of a group by the digest of its name: the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.col(group)), 1, 8), 16, 10).cast("long") % folds


def stratified_group_folds(groups: DataFrame, folds: int = 5, shard: int = 20_000) -> DataFrame:
    """(grp, fold) for groups (grp, rows, positives): no group is divided, folds are even in rows and positives.

    Groups are dealt out largest first, each to the fold that then deviates
    least; this is done in shards of about ``shard`` groups by their digest, each
    of which fills all folds evenly. Groups larger than a fold's share of a shard
    make a shard of their own, so that they balance each other. Null counts as 0.
    """
    import pandas as pd

    rows = groups.na.fill(0, ["rows", "positives"])
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("r")).first()
    shards = max(1, -(-total.n // shard))
    share = max(1.0, total.r / shards / folds)
    number = F.when(F.col("rows") > share, -1).otherwise(F.pmod(F.xxhash64("grp", F.lit(11)), F.lit(shards))).cast("int")

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rows", "positives", "grp"], ascending=[False, False, True])
        size, hits = [0.0] * folds, [0.0] * folds
        every, positive = max(1, frame.rows.sum()), max(1, frame.positives.sum())
        chosen = []
        for r, p in zip(frame.rows, frame.positives):
            fold = min(range(folds), key=lambda f: (((size[f] + r) / every) ** 2 - (size[f] / every) ** 2 + ((hits[f] + p) / positive) ** 2 - (hits[f] / positive) ** 2, f))
            size[fold] += r
            hits[fold] += p
            chosen.append(fold)
        return pd.DataFrame({"grp": frame.grp, "fold": chosen})

    return rows.withColumn("shard", number).groupBy("shard").applyInPandas(deal, "grp string, fold int")


def nested(df: DataFrame, group: str, folds: int = 5, share: float = 0.25) -> DataFrame:
    """(fold, partition, id, group): per outer fold the test, inner training and inner calibration rows.

    A quarter of the groups outside the test fold, by another digest, calibrate.
    """
    outer = df.select("id", F.col(group).alias("grp"), group_fold(group, folds).alias("own"))
    each = outer.select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    inner = F.conv(F.substring(F.md5(F.concat_ws(":", "fold", "grp")), 1, 4), 16, 10).cast("long") < int(share * 65536)
    part = F.when(F.col("own") == F.col("fold"), "outer_test").when(inner, "inner_calibration").otherwise("inner_train")
    return each.select("fold", part.alias("partition"), "id", "grp")


def temporal_sides(df: DataFrame, year: str, cutoff: int, least: int = 20) -> DataFrame:
    """Adds ``side`` (before, from, unknown) by a year; the median year is taken where a side would have under ``least`` rows."""
    sizes = df.agg(F.count_if(F.col(year) < cutoff).alias("b"), F.count_if(F.col(year) >= cutoff).alias("f"), F.expr(f"floor(percentile({year}, 0.5))").alias("m"))
    cut = sizes.select(F.when((F.col("b") < least) | (F.col("f") < least), F.col("m")).otherwise(F.lit(cutoff)).alias("_cut"))
    side = F.when(F.col(year).isNull(), "unknown").when(F.col(year) < F.col("_cut"), "before").otherwise("from")
    return df.crossJoin(F.broadcast(cut)).withColumn("side", side).drop("_cut")  # one row


def shared_values(df: DataFrame, split: str, value: str) -> DataFrame:
    """(left, right, shared): number of values that two splits have in common, pairs without any included not."""
    pairs = df.where(f"{split} is not null and {value} is not null").select(split, value).distinct()
    names = pairs.groupBy(value).agg(F.array_sort(F.collect_set(split)).alias("s")).where("size(s) > 1")  # as many as there are splits
    both = names.select(F.explode(F.expr("flatten(transform(s, (x, i) -> transform(slice(s, i + 2, size(s)), y -> struct(x AS l, y AS r))))")).alias("p"))
    return both.groupBy(F.col("p.l").alias("left_split"), F.col("p.r").alias("right_split")).agg(F.count("*").alias("shared"))
