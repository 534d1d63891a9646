"""Sequence features as native expressions on a column ``sequence``.

Every function adds columns to a table with ``id`` and ``sequence`` and leaves
the work to generated code. Rows with a null sequence keep null features; an
empty sequence gives null where a feature would divide by its length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.functions import scales as S


def aac(df: DataFrame) -> DataFrame:
    """Composition in percent of the 20 residues, as columns aac_A to aac_Y."""
    return df.select("id", *[F.expr(S.rounded(f"CAST({S.count_sql(r)} AS DOUBLE) * 100e0 / nullif(length(sequence), 0)", 3)).alias(f"aac_{r}") for r in S.RESIDUES])


def aac_vector(sequence: str = "sequence") -> Column:
    """Unrounded composition fractions, in the order of the residues."""
    return F.array(*[F.expr(f"CAST({S.count_sql(r, sequence)} AS DOUBLE) / nullif(length({sequence}), 0)") for r in S.RESIDUES])


def pcp(df: DataFrame) -> DataFrame:
    """25 group fractions and the means of five z-scales."""
    groups = [F.expr(S.fraction_sql(letters)).alias(name) for name, letters in S.GROUPS.items()]
    z = [F.expr(S.mean_sql({r: v[i] for r, v in S.Z_COMPOSITION.items()}, 100, 3)).alias(f"PCP_Z{i + 1}") for i in range(5)]
    return df.select("id", *groups, *z)


def kmers(sequence: str, k: int) -> Column:
    """All windows of k residues with repetition; a shorter sequence has none."""
    # the text is cut into letters once: substr counts its way from the start each time
    windows = f"transform(array(split({sequence}, '')), c -> transform(sequence(1, length({sequence}) - {k - 1}), i -> array_join(slice(c, i, {k}), '')))[0]"
    return F.expr(f"CASE WHEN length({sequence}) >= {k} THEN {windows} ELSE array() END")


def kmer_set(sequence: str, k: int) -> Column:
    """Distinct windows; a sequence shorter than k is its own only window."""
    return F.expr(f"CASE WHEN length({sequence}) < {k} THEN array({sequence}) ELSE array_distinct(transform(sequence(1, length({sequence}) - {k - 1}), i -> substr({sequence}, i, {k}))) END")


def kmer_frequency(df: DataFrame, k: int) -> DataFrame:
    """(id, kmer, n, frequency) of windows made of standard residues, over all windows of the sequence."""
    exploded = df.select("id", F.length("sequence").alias("len"), F.explode(kmers("sequence", k)).alias("kmer"))
    exploded = exploded.where(F.col("kmer").rlike(f"^[{S.RESIDUES}]{{{k}}}$"))
    return exploded.groupBy("id", "kmer").agg(F.count("*").alias("n"), F.first("len").alias("len")).select("id", "kmer", "n", F.expr(S.rounded(f"n / CAST(len - {k - 1} AS DOUBLE)", 6)).alias("frequency"))


def autocorrelation(df: DataFrame, max_lag: int = 3) -> DataFrame:
    """Moreau-Broto autocorrelation of hydropathy; 0 where the sequence is not longer than the lag."""
    values = "transform(sequence(1, length(sequence)), i -> CAST(element_at(kd, ascii(substr(sequence, i, 1)) - 64) AS BIGINT))"
    table = ", ".join(str(S.HYDROPATHY.get(chr(65 + i), 0)) for i in range(26))
    with_values = df.withColumn("kd", F.expr(f"array({table})")).withColumn("v", F.expr(f"CASE WHEN length(sequence) > 0 THEN {values} END"))
    lags = []
    for lag in range(1, max_lag + 1):
        total = f"aggregate(zip_with(slice(v, 1, size(v) - {lag}), slice(v, {lag + 1}, size(v) - {lag}), (a, b) -> a * b), 0L, (x, y) -> x + y)"
        lags.append(F.expr(f"CASE WHEN size(v) > {lag} THEN {S.rounded(f'CAST({total} AS DOUBLE) / (100 * (size(v) - {lag}))', 3)} ELSE 0.0D END").alias(f"ACR_lag_{lag}"))
    return with_values.select("id", *lags)


def physical_columns() -> list[Column]:
    """Mass, hydropathy, aromaticity, secondary-structure fractions and aggregation score."""
    mass = S.rounded(f"({S.sum_sql(S.MASS)} - {S.WATER} * (length(sequence) - 1)) / 10000e0", 2)
    return [
        F.expr(mass).alias("mol_weight"),
        F.expr(S.mean_sql(S.HYDROPATHY, 10, 3)).alias("gravy"),
        F.expr(S.fraction_sql("FWY")).alias("aromaticity"),
        F.expr(S.fraction_sql(S.HELIX)).alias("helix"),
        F.expr(S.fraction_sql(S.TURN)).alias("turn"),
        F.expr(S.fraction_sql(S.SHEET)).alias("sheet"),
        F.expr(S.mean_sql(S.AGGREGATION, 10, 3)).alias("aggregation"),
    ]


def physical(df: DataFrame) -> DataFrame:
    return df.select("id", *physical_columns())


def charge_sql(ph: str, sequence: str = "sequence") -> str:
    """Net charge at a pH by the Bjellqvist pK values, terminal groups by their residue."""
    first, last = f"substr({sequence}, 1, 1)", f"substr({sequence}, length({sequence}), 1)"
    nterm = "CASE " + first + " " + " ".join(f"WHEN '{r}' THEN {pk}" for r, pk in S.PK_NTERM.items()) + f" ELSE {S.PK_POSITIVE['Nterm']} END"
    cterm = "CASE " + last + " " + " ".join(f"WHEN '{r}' THEN {pk}" for r, pk in S.PK_CTERM.items()) + f" ELSE {S.PK_NEGATIVE['Cterm']} END"
    up = [f"1.0 / (1.0 + power(10.0, CAST({ph} AS DOUBLE) - CAST({nterm} AS DOUBLE)))"]
    up += [f"{S.count_sql(r, sequence)} / (1.0 + power(10.0, CAST({ph} AS DOUBLE) - CAST({pk} AS DOUBLE)))" for r, pk in S.PK_POSITIVE.items() if len(r) == 1]
    down = [f"1.0 / (1.0 + power(10.0, CAST({cterm} AS DOUBLE) - CAST({ph} AS DOUBLE)))"]
    down += [f"{S.count_sql(r, sequence)} / (1.0 + power(10.0, CAST({pk} AS DOUBLE) - CAST({ph} AS DOUBLE)))" for r, pk in S.PK_NEGATIVE.items() if len(r) == 1]
    return "(" + " + ".join(up) + " - (" + " + ".join(down) + "))"


#: Interval in which the isoelectric point is sought, the first guess, and steps until it is narrower than 1e-4.
PI_RANGE, PI_FIRST, PI_STEPS = (4.05, 12.0), 7.775, 17


def isoelectric_column() -> Column:
    """Isoelectric point by bisection of the net charge, for whole Arrow batches at once; null for an empty sequence.

    The counts of charged residues are native expressions; only they and the two
    terminal pK values go to the vectorised solver.
    """
    positive = [r for r in S.PK_POSITIVE if len(r) == 1]
    negative = [r for r in S.PK_NEGATIVE if len(r) == 1]
    ends = [F.create_map(*[F.lit(x) for p in t.items() for x in p]) for t in (S.PK_NTERM, S.PK_CTERM)]
    first = F.coalesce(F.try_element_at(ends[0], F.expr("substr(sequence, 1, 1)")), F.lit(S.PK_POSITIVE["Nterm"]))
    last = F.coalesce(F.try_element_at(ends[1], F.expr("right(sequence, 1)")), F.lit(S.PK_NEGATIVE["Cterm"]))
    up = np.array([S.PK_POSITIVE[r] for r in positive])
    down = np.array([S.PK_NEGATIVE[r] for r in negative])
    low, high = PI_RANGE

    @F.pandas_udf("double")
    def solve(counts: pd.Series, n_end: pd.Series, c_end: pd.Series) -> pd.Series:
        c = np.stack(counts.to_numpy()).astype(float) if len(counts) else np.zeros((0, len(up) + len(down)))
        n_end, c_end = n_end.to_numpy(), c_end.to_numpy()
        lo, hi, ph = np.full(len(c), low), np.full(len(c), high), np.full(len(c), PI_FIRST)
        for _ in range(PI_STEPS):
            charge = 1 / (1 + 10 ** (ph - n_end)) + (c[:, : len(up)] / (1 + 10 ** (ph[:, None] - up))).sum(1)
            charge -= 1 / (1 + 10 ** (c_end - ph)) + (c[:, len(up) :] / (1 + 10 ** (down - ph[:, None]))).sum(1)
            lo, hi = np.where(charge > 0, ph, lo), np.where(charge > 0, hi, ph)
            ph = (lo + hi) / 2
        return pd.Series(ph)

    counts = F.array(*[F.coalesce(S.counted(r), F.lit(0)) for r in (*positive, *negative)])
    point = F.floor(solve(counts, first, last) * 100 + 0.5) / 100
    return F.when(F.length("sequence") > 0, point).alias("isoelectric_point")


def isoelectric(df: DataFrame) -> DataFrame:
    """(id, isoelectric_point) of the sequences that are not empty."""
    return df.where("length(sequence) > 0").select("id", isoelectric_column())


def complexity(df: DataFrame) -> DataFrame:
    """(id, entropy, max_fraction): Shannon entropy in bits and the largest share of one residue."""
    letters = [chr(65 + i) for i in range(26)]
    counts = "array(" + ", ".join(S.count_sql(c) for c in letters) + ")"
    entropy = "aggregate(filter(c, x -> x > 0), 0.0D, (s, x) -> s - (x / length(sequence)) * log2(x / length(sequence)))"
    shares = df.withColumn("c", F.expr(counts))
    return shares.select("id", F.expr(S.rounded(entropy, 6)).alias("entropy"), F.expr(S.rounded("array_max(c) / CAST(nullif(length(sequence), 0) AS DOUBLE)", 6)).alias("max_fraction"))


def acc_names(properties: int = 5, lags: int = 5) -> list[str]:
    """Names of the terms of ``acc``, in their order."""
    pairs = [(j, k) for j in range(1, properties + 1) for k in range(1, properties + 1) if j != k]
    return [f"AC_{j}_{lag}" for j in range(1, properties + 1) for lag in range(1, lags + 1)] + [f"CC_{j}_{k}_{lag}" for j, k in pairs for lag in range(1, lags + 1)]


def acc(df: DataFrame, lags: int = 5, table: dict[str, tuple[int, ...]] | None = None) -> DataFrame:
    """(id, terms): auto and cross covariances of the centred z-scales, 125 for five scales and lags.

    First the auto terms, scale by scale and lag by lag, then the cross terms of
    all ordered pairs. A term is 0 where the sequence is not longer than the lag;
    empty sequences give zeros. Whole Arrow batches go to vectorised code; sums
    are integer sums, and each term is one division.
    """
    table = table or S.Z_COMPOSITION
    properties = len(next(iter(table.values())))
    lookup = np.zeros((256, properties), np.int64)
    for residue, values in table.items():
        lookup[ord(residue)] = values
    order = [(j, j) for j in range(properties)] + [(j, k) for j in range(properties) for k in range(properties) if j != k]
    left, right = (np.array(x) for x in zip(*order))

    @F.pandas_udf("array<double>")
    def terms(sequences: pd.Series) -> pd.Series:
        out = []
        for s in sequences:
            z = lookup[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]
            n = len(z)
            total = z.sum(0)
            value = np.zeros((len(order), lags))
            for lag in range(1, min(lags, n - 1) + 1):
                first, last = z[:-lag], z[lag:]
                # n ** 2 times the sum of products of centred values
                sums = n * n * (first.T @ last) - n * (np.outer(first.sum(0), total) + np.outer(total, last.sum(0))) + (n - lag) * np.outer(total, total)
                value[:, lag - 1] = sums[left, right] / (n * n * (n - lag) * 10_000)
            out.append(value.ravel())
        return pd.Series(out)

    return df.where("sequence is not null").select("id", terms("sequence").alias("terms"))


def joined_pools(df: DataFrame, by: list[str], dims: int, vector: str = "vec", special: Column | None = None) -> DataFrame:
    """(by..., dim, value): the means of a group's vectors followed by their maxima, one vector of twice the places."""
    both = pooled(df, by, vector, special=special)
    return both.select(*by, F.col("dim").cast("int").alias("dim"), F.col("mean").alias("value")).union(both.select(*by, (F.col("dim") + dims).cast("int"), F.col("max").cast("double")))


def pooled(df: DataFrame, by: list[str], vector: str = "vec", modes: tuple[str, ...] = ("mean", "max"), special: Column | None = None) -> DataFrame:
    """Mean and maximum of the vectors of each group, place by place.

    Rows with a null vector count nowhere, nor do those of marks that stand for
    no residue (``special``).
    """
    df = df.where(~F.coalesce(special, F.lit(False))) if special is not None else df
    flat = df.where(F.col(vector).isNotNull()).select(*by, F.posexplode(vector).alias("dim", "x"))
    kinds = {"mean": F.avg("x"), "max": F.max("x")}
    return flat.groupBy(*by, "dim").agg(*[kinds[m].alias(m) for m in modes])


def cosine(a: str, b: str) -> Column:
    """Cosine of two array columns; null where one has norm 0."""
    dot = lambda x, y: F.expr(f"aggregate(zip_with({x}, {y}, (p, q) -> CAST(p AS DOUBLE) * q), 0D, (s, v) -> s + v)")
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def quantised(vector: str) -> Column:
    """Values of an array on a grid of 127 steps to its largest magnitude."""
    step = f"(aggregate({vector}, 0D, (s, v) -> greatest(s, abs(CAST(v AS DOUBLE)))) / 127)"
    return F.expr(f"transform({vector}, v -> CASE WHEN {step} > 0 THEN floor(v / {step} + 0.5D) * {step} ELSE 0D END)")


# Names and upper bounds of the four systems of length bins.
LENGTH_BINS = {
    "screening": (("< 15 aa", 14), ("15-50 aa", 50), ("50-200 aa", 200), ("200-500 aa", 500), ("> 500 aa", None)),
    "metrics": (("50+", 4), ("5-9", 9), ("10-14", 14), ("15-24", 24), ("25-49", 49), ("50+", None)),
    "conformal": (("length_under_15", 14), ("length_15_to_24", 24), ("length_25_to_49", 49), ("length_50_plus", None)),
    "evaluation": (("<15", 14), ("15-24", 24), ("25-49", 49), ("50+", None)),
}


def length_bin_sql(system: str, length: str = "length(sequence)") -> str:
    bins = LENGTH_BINS[system]
    cases = " ".join(f"WHEN {length} <= {top} THEN '{name}'" for name, top in bins[:-1])
    return f"CASE {cases} ELSE '{bins[-1][0]}' END"
