"""Rule guards of the applicability domain, stability reasons, distances to known data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.functions import features, scales as S

# Signs of chemical modification in a description or sequence.
MODIFICATIONS = (
    r"\bD-", r"\[D-[A-Z]\]", r"\(D-[A-Z]\)", r"\bac-", r"-nh2\b", r"\bamidation\b", r"\bcyclic\b", r"\bcyclo\b", r"\bphospho\b", r"\bmethyl\b",
    r"\bptm\b", r"\bhydroxylation\b", r"\bacetyl\b", r"\bsulfation\b", r"\bcitrulline\b", r"[\[\(\{][^\]\)\}]+[\]\)\}]",
)


def modified(column: str) -> Column:
    return F.col(column).rlike("(?i)" + "|".join(MODIFICATIONS))


def guard_column(column: str = "sequence", shortest: int = 5, longest: int = 1000, entropy: float = 1.5, share: float = 0.5) -> Column:
    """The first rule that a raw sequence breaks, or null.

    The order is modification, length, non-standard residues, entropy, skew.
    """
    counts = "array(" + ", ".join(S.count_sql(c, "u") for c in S.RESIDUES) + ")"
    # names are bound by transforms over one element, so that letters are counted once
    h = "aggregate(c, 0.0D, (s, x) -> s - CASE WHEN x > 0 THEN (x / n) * log2(x / n) ELSE 0D END)"
    values = f"transform(array(upper({column})), u -> transform(array(CAST(length(u) AS DOUBLE)), n -> transform(array({counts}), c -> named_struct('h', {h}, 'top', array_max(c) / n))[0])[0])"
    spread = (
        f"transform({values}, x -> CASE WHEN x.h < {entropy!r}D THEN format_string('extreme_low_complexity_entropy_%.2f_bits', x.h)"
        f" WHEN x.top > {share!r}D THEN format_string('extreme_skewed_composition_max_aa_%.2f', x.top) END)[0]"
    )
    return (
        F.when(modified(column), "annotated_chemical_modification_in_sequence")
        .when(F.length(column) < shortest, f"length_under_minimum_{shortest}")
        .when(F.length(column) > longest, f"length_over_maximum_{longest}")
        .when(F.upper(column).rlike("[^ACDEFGHIKLMNPQRSTVWY]"), "non_canonical_residue_detected")
        .otherwise(F.expr(spread))
        .alias("guard")
    )


def guards(df: DataFrame, **limits) -> DataFrame:
    """(id, guard) by ``guard_column``."""
    return df.select("id", guard_column(**limits))


def instability_weights() -> dict[str, float]:
    """Weights of dipeptides by their groups; see ``instability_index``."""
    # Rows of the published dipeptide table that differ from 1.0, by first residue: {weight: second residues}.
    table = {
        "A": {44.94: "C", -7.49: "DH", 20.26: "P"},
        "C": {20.26: "DLP", 33.6: "HMT", -6.54: "QV", 24.68: "W"},
        "D": {-6.54: "FR", -7.49: "K", 20.26: "S", -14.03: "T"},
        "E": {44.94: "C", 20.26: "DIPQS", 33.6: "E", -6.54: "H", -14.03: "W"},
        "F": {13.34: "D", -14.03: "K", 20.26: "P", 33.6: "Y"},
        "G": {-7.49: "AIKNTY", -6.54: "E", 13.34: "GW"},
        "H": {-9.37: "FG", 44.94: "IY", 24.68: "KN", -1.88: "PW", -6.54: "T"},
        "I": {44.94: "E", 13.34: "H", -7.49: "KV", 20.26: "L", -1.88: "P"},
        "K": {-7.49: "GILV", 33.6: "MR", -6.54: "P", 24.64: "Q"},
        "L": {-7.49: "K", 20.26: "PR", 33.6: "Q", 24.68: "W"},
        "M": {13.34: "A", 58.28: "H", 44.94: "PS", -6.54: "QR", -1.88: "MT", 24.68: "Y"},
        "N": {-1.88: "CP", -14.03: "FG", 44.94: "I", 24.68: "K", -6.54: "Q", -7.49: "T", -9.37: "W"},
        "P": {20.26: "AFPQSV", -6.54: "CDMR", 18.38: "E", -1.88: "W"},
        "Q": {-6.54: "CFVY", 20.26: "DEPQ", 44.94: "S"},
        "R": {-7.49: "G", 20.26: "HPQ", 13.34: "N", 58.28: "RW", 44.94: "S", -6.54: "Y"},
        "S": {33.6: "C", 20.26: "EQRS", 44.94: "P"},
        "T": {20.26: "E", 13.34: "F", -7.49: "G", -14.03: "NW", -6.54: "Q"},
        "V": {-14.03: "D", -7.49: "GT", -1.88: "K", 20.26: "P", -6.54: "Y"},
        "W": {-14.03: "AT", -9.37: "G", 24.68: "HM", 13.34: "LN", -7.49: "V"},
        "Y": {24.68: "AD", -6.54: "E", -7.49: "GT", 44.94: "M", 13.34: "HPY", -15.91: "R", -9.37: "W"},
    }
    return {a + b: round(w, 2) for a, row in table.items() for w, seconds in row.items() for b in seconds}


def instability_column() -> Column:
    """Ten times the mean weight of the dipeptides; weights not in the table are 1; null under two residues."""
    letters = 27  # A to Z and anything else
    table = [100] * letters * letters
    for pair, w in instability_weights().items():
        table[(ord(pair[0]) - 65) * letters + ord(pair[1]) - 65] = round(w * 100)
    codes = "transform(split(sequence, ''), c -> CASE WHEN c >= 'A' AND c <= 'Z' THEN ascii(c) - 65 ELSE 26 END)"
    weights = f"zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v) - 1), (a, b) -> w[a * {letters} + b])"
    total = f"transform(array(array({', '.join(map(str, table))})), w -> transform(array({codes}), v -> aggregate({weights}, 0L, (s, x) -> s + x))[0])[0]"
    return F.expr(f"CASE WHEN length(sequence) > 1 THEN {S.rounded(f'CAST({total} AS DOUBLE) / (10 * length(sequence))', 2)} END").alias("instability")


def instability_index(df: DataFrame) -> DataFrame:
    """(id, instability) by ``instability_column``."""
    return df.select("id", instability_column())


def stability_reasons(length: str = "len") -> Column:
    """What speaks against a row with instability, aggregation, sheet, gravy and charge_7_4, in a fixed order."""
    short = F.col(length) < 20
    reasons = F.array_compact(
        F.array(
            F.when(short, "advisory_short_peptide"),
            F.when(F.col("instability") >= 40, F.when(short, "unstable_advisory").otherwise("unstable")),
            F.when((F.col("aggregation") > 0.2) | ((F.col("sheet") >= 0.35) & (F.col("gravy") > 0)), "aggregation_prone"),
            F.when(F.abs("charge_7_4") > 6, "extreme_net_charge"),
        )
    )
    return F.array_join(reasons, ",").alias("reasons")


def stability(df: DataFrame) -> DataFrame:
    """Stability values with the reasons that speak against a sequence."""
    charge = F.expr(S.rounded(features.charge_sql("7.4"), 2)).alias("charge_7_4")
    values = df.select("id", F.length("sequence").alias("len"), *features.physical_columns(), instability_column(), charge)
    return values.select("*", stability_reasons())


def nearest(queries: DataFrame, train: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """(id, neighbour, cosine, rank) of the k most similar training vectors of every query.

    Both tables have id (long) and vec (array of floats). Training vectors are
    cut into blocks, each query meets each block in one matrix product, and only
    its best k of a block travel on, so that work is spread over the blocks and
    what is shuffled is k rows per query and block. It is an exact search: every
    query meets every vector, and is sent to every block. Ties go to the smaller id; a
    vector of norm 0 or with a null matches nothing.
    """
    spark = train.sparkSession
    blocks = max(1, -(-train.count() // block))
    packed = train.where("id is not null and vec is not null").select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "vec", F.lit(False).alias("asks"))
    asked = queries.where("id is not null and vec is not null").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "vec", F.lit(True).alias("asks"))

    def search(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy(bool)
        empty = pd.DataFrame({"id": [], "neighbour": [], "cosine": [], "part": []}).astype({"id": "int64", "neighbour": "int64", "cosine": "float64", "part": "int32"})
        if asks.all() or not asks.any():
            return empty

        def units(rows):
            m = np.stack([np.asarray(v, float) for v in rows.vec])
            norm = np.linalg.norm(m, axis=1)
            good = norm > 0
            return rows.id.to_numpy()[good], m[good] / norm[good, None]

        ids, base = units(frame[~asks].sort_values("id"))
        out = []
        asking = frame[asks]
        for start in range(0, len(asking), 2048):
            query_ids, q = units(asking.iloc[start : start + 2048])
            # equal rounding for equal pairs, wherever they are computed
            cosine = np.round(q @ base.T, 9)
            best = np.argsort(-cosine, axis=1, kind="stable")[:, : k + 1]
            rows = np.repeat(query_ids, best.shape[1]), ids[best].ravel(), np.take_along_axis(cosine, best, 1).ravel()
            keep = rows[0] != rows[1]
            out.append(pd.DataFrame({"id": rows[0][keep], "neighbour": rows[1][keep], "cosine": rows[2][keep], "part": key[0] % parts}))
        return pd.concat(out) if out else empty

    # two levels, so that no task holds k rows of every block for one query
    parts = max(1, int(blocks**0.5))
    best_of = lambda x: F.slice(F.array_sort(F.collect_list(x)), 1, k)
    found = packed.unionByName(asked).groupBy("block").applyInPandas(search, "id long, neighbour long, cosine double, part int")
    some = found.groupBy("id", "part").agg(best_of(F.struct((-F.col("cosine")).alias("c"), "neighbour")).alias("b"))
    best = some.select("id", F.explode("b").alias("x")).groupBy("id").agg(best_of("x").alias("b"))
    return best.select("id", F.posexplode("b").alias("p", "x")).select("id", F.col("x.neighbour").alias("neighbour"), (-F.col("x.c")).alias("cosine"), (F.col("p") + 1).alias("rank"))


def subspace_votes(queries: DataFrame, train: DataFrame, spaces: list[list[int]], block: int = 4096) -> DataFrame:
    """(id, votes, mean): labels of the nearest training vector in each subspace, their sum and mean.

    Both tables have id (long), vec and, for training, a label. Vectors are
    compared by their squared distance, to nine digits; ties go to the smaller
    id; a vector is no neighbour of itself. Blocks of training vectors meet all
    queries as matrices, and a minimum for each query and subspace travels on.
    """
    blocks = max(1, -(-train.count() // block))
    held = train.where("id is not null and vec is not null and label is not null").select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "vec", F.col("label").cast("long").alias("label"), F.lit(False).alias("asks"))
    asked = queries.where("id is not null and vec is not null").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "vec", F.lit(None).cast("long").alias("label"), F.lit(True).alias("asks"))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy(bool)
        out = []
        if asks.any() and not asks.all():
            base, asking = frame[~asks].sort_values("id"), frame[asks]
            x, q = (np.stack([np.asarray(v, float) for v in part.vec]) for part in (base, asking))
            ids, query_ids, labels = base.id.to_numpy(), asking.id.to_numpy(), base.label.to_numpy()
            own = query_ids[:, None] == ids[None]
            for s, places in enumerate(spaces):
                a, b = q[:, places], x[:, places]
                distance = np.round((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 9)
                distance[own] = np.inf
                best = distance.argmin(1)
                value = np.take_along_axis(distance, best[:, None], 1)[:, 0]
                keep = np.isfinite(value)
                out.append(pd.DataFrame({"id": query_ids[keep], "space": s, "distance": value[keep], "neighbour": ids[best][keep], "label": labels[best][keep]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "space": [], "distance": [], "neighbour": [], "label": []}).astype({"id": "int64", "space": "int32", "distance": "float64", "neighbour": "int64", "label": "int64"})

    found = held.unionByName(asked).groupBy("block").applyInPandas(search, "id long, space int, distance double, neighbour long, label long")
    nearest_ = found.groupBy("id", "space").agg(F.min_by("label", F.struct("distance", "neighbour")).alias("label"))
    return nearest_.groupBy("id").agg(F.sum("label").alias("votes"), F.avg("label").alias("mean"))


def class_centroids(df: DataFrame, vec: str = "vec", label: str = "label") -> DataFrame:
    """(label, dim, mean, n) of the vectors of each class."""
    return df.select(label, F.posexplode(vec).alias("dim", "x")).groupBy(label, "dim").agg(F.round(F.avg("x"), 6).alias("mean"), F.count("*").alias("n"))


def shrunk_covariance(df: DataFrame, vec: str = "vec", label: str = "label") -> tuple[dict, np.ndarray]:
    """Class means and the shrunk covariance that all classes share (Ledoit and Wolf).

    Every task keeps one array of moments for each class; the arrays of a class
    are added up place by place in the cluster, so that the driver gets one
    number for each class and pair of dimensions, whatever the number of rows.
    """
    rows = df.select(F.col(label).cast("long").alias(label), vec).na.drop()

    def moments(batches):
        held: dict[int, list] = {}
        for frame in batches:
            for name, part in frame.groupby(label):
                x = np.stack([np.asarray(v, float) for v in part[vec]])
                t = held.setdefault(int(name), [0, 0.0, 0.0])
                t[0] += len(x)
                t[1] = t[1] + x.sum(0)
                t[2] = t[2] + x.T @ x
        for name, (n, s, ss) in held.items():
            yield pd.DataFrame({"label": [name], "m": [np.r_[n, s, ss.ravel()]]})

    summed = rows.mapInPandas(moments, "label long, m array<double>").select("label", F.posexplode("m").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"))
    packed = summed.groupBy("label").agg(F.expr("transform(array_sort(collect_list(struct(i, x))), p -> p.x)").alias("m")).orderBy("label").collect()
    total = {r.label: np.array(r.m) for r in packed}
    if not total:
        raise ValueError("no labelled vectors")
    d = int((-1 + (1 + 4 * (len(next(iter(total.values()))) - 1)) ** 0.5) / 2 + 0.5)
    means = {k: m[1 : d + 1] / m[0] for k, m in total.items()}
    n = sum(m[0] for m in total.values())
    scatter = sum(m[d + 1 :].reshape(d, d) - m[0] * np.outer(means[k], means[k]) for k, m in total.items())
    cov = scatter / n
    mu = np.trace(cov) / d
    delta = ((cov - mu * np.eye(d)) ** 2).sum() / d

    def spread(batches):
        value = 0.0
        for frame in batches:
            for name, part in frame.groupby(label):
                x = np.stack([np.asarray(v, float) for v in part[vec]]) - means[name]
                value += (np.einsum("ij,ij->i", x, x) ** 2).sum()
        yield pd.DataFrame({"v": [value]})

    fourth = rows.mapInPandas(spread, "v double").agg(F.sum("v")).first()[0] or 0.0
    beta = min((fourth / n - (cov**2).sum()) / (n * d), delta)
    shrink = 0.0 if delta == 0 else beta / delta
    return means, (1 - shrink) * cov + shrink * mu * np.eye(d)


def detected(df: DataFrame, calibration: DataFrame, means: dict, cov: np.ndarray, share: float = 0.99, vec: str = "vec") -> DataFrame:
    """Adds distance, euclid (to the nearest class mean) and outside: either lies beyond that share of the calibration rows."""
    both = [mahalanobis(euclidean(part, means, vec), means, cov, vec) for part in (df, calibration)]
    cuts = both[1].agg(F.expr(f"percentile(distance, {share}D)").alias("_d"), F.expr(f"percentile(euclid, {share}D)").alias("_e"))
    return both[0].crossJoin(F.broadcast(cuts)).withColumn("outside", (F.col("distance") > F.col("_d")) | (F.col("euclid") > F.col("_e"))).drop("_d", "_e")  # one row


def euclidean(df: DataFrame, means: dict, vec: str = "vec") -> DataFrame:
    """Adds ``euclid``: the distance to the nearest class mean."""
    each = [F.sqrt(F.aggregate(F.zip_with(vec, F.array(*[F.lit(float(x)) for x in centre]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)) for centre in means.values()]
    return df.withColumn("euclid", F.least(*each) if len(each) > 1 else each[0])


def mahalanobis(df: DataFrame, means: dict, cov: np.ndarray, vec: str = "vec") -> DataFrame:
    """Adds ``distance``: the smallest Mahalanobis distance to a class mean."""
    precision = np.linalg.pinv(cov)
    centres = np.stack(list(means.values()))

    @F.pandas_udf("double")
    def distance(v: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(r, float) for r in v])
        best = np.full(len(x), np.inf)
        for c in centres:
            e = x - c
            best = np.minimum(best, np.einsum("ij,jk,ik->i", e, precision, e))
        return pd.Series(np.sqrt(np.maximum(best, 0)))

    return df.withColumn("distance", distance(vec))
