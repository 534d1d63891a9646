"""Regions of high mean residue propensity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.functions import scales as S


def runs_sql(window: int = 7, threshold: int = 7000) -> str:
    """SQL for the array of runs (b, e, total) of windows at or above the threshold; for sequences of a window or more."""
    table = ", ".join(str(S.ANTIGENIC.get(chr(65 + i), 1000)) for i in range(26))
    # transform over a one-element array binds a value to a name, so that it is computed once
    values = f"transform(array(array({table})), kt -> transform(split(sequence, ''), c -> kt[ascii(c) - 65]))[0]"
    sums = f"transform(array({values}), v -> transform(sequence(0, size(v) - {window}), i -> {' + '.join(f'v[i + {k}]' for k in range(window))}))[0]"
    begin = f"filter(sequence(1, size(t)), i -> t[i - 1] >= {threshold} AND (i = 1 OR t[greatest(i - 2, 0)] < {threshold}))"
    end = f"filter(sequence(1, size(t)), i -> t[i - 1] >= {threshold} AND (i = size(t) OR t[least(i, size(t) - 1)] < {threshold}))"
    # a run starts where the window before is below, and ends where the next one is
    total = "aggregate(slice(t, b, e - b + 1), 0L, (x, y) -> x + y)"
    return f"transform(array({sums}), t -> zip_with({begin}, {end}, (b, e) -> named_struct('b', b, 'e', e, 'total', {total})))[0]"


def count_column(window: int = 7, threshold: int = 7000) -> Column:
    """Number of regions of a sequence."""
    return F.expr(f"CASE WHEN length(sequence) >= {window} THEN size({runs_sql(window, threshold)}) ELSE 0 END").alias("epitopes")


def regions(df: DataFrame, window: int = 7, threshold: int = 7000) -> DataFrame:
    """(id, start, end, length, region, mean_score) of runs of windows at or above the threshold.

    ``threshold`` is the window's integer sum (mean 1.0 is 1000 per residue).
    Places count from 1. Runs are found inside the row's own array of window
    sums, so that nothing is shuffled. Sequences shorter than a window have none.
    """
    found = runs_sql(window, threshold)
    runs = df.where(f"length(sequence) >= {window}").select("id", "sequence", F.explode(F.expr(found)).alias("r"))
    size = f"(r.e - r.b + {window})"
    mean = S.rounded(f"CAST(r.total AS DOUBLE) / ({window * 1000} * (r.e - r.b + 1))", 3)
    return runs.select(
        "id",
        F.col("r.b").alias("start"),
        F.expr(f"r.e + {window - 1}").alias("end"),
        F.expr(size).alias("length"),
        F.expr(f"substr(sequence, r.b, {size})").alias("region"),
        F.expr(mean).alias("mean_score"),
    )
