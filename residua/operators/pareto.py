"""Multi-objective ranking: dominance, fronts, crowding.

Objectives are columns to be maximised. Equal vectors are one point until the
very end, so that work follows the number of different vectors.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.session import written

#: Different vectors that one task sorts into fronts; more go through joins. With
#: three objectives and no margin, where sorting is nearly linear, CHAINED.
ONE_TASK, CHAINED = 30_000, 1_000_000


def dominates(a: str, b: str, objectives: list[str], margin: float = 0.0) -> Column:
    """a is nowhere worse by more than the margin and somewhere better by more than it, to nine digits."""
    diff = [F.round(F.col(f"{a}.{o}") - F.col(f"{b}.{o}"), 9) for o in objectives]
    return reduce(lambda x, y: x & y, [d >= -margin for d in diff]) & reduce(lambda x, y: x | y, [d > margin for d in diff])


def points(df: DataFrame, objectives: list[str]) -> DataFrame:
    return df.select(*objectives).na.drop().distinct()


def front_zero(df: DataFrame, objectives: list[str]) -> DataFrame:
    """Rows that no other row dominates (margin 0).

    Every task first keeps its own undominated vectors, which is all that is
    compared with each other.
    """
    n = len(objectives)

    def local(batches):
        kept = np.zeros((0, n))
        for frame in batches:
            rows = np.unique(np.r_[kept, frame[objectives].to_numpy(float)], axis=0)
            rows = rows[np.lexsort(rows.T[::-1])[::-1]]
            keep = []
            for i, x in enumerate(rows):
                better = np.array(keep, int)
                if not len(better) or not ((rows[better] >= x).all(1) & (rows[better] > x).any(1)).any():
                    keep.append(i)
            kept = rows[keep]
        yield pd.DataFrame(kept, columns=objectives)

    schema = ", ".join(f"{o} double" for o in objectives)
    some = points(df, objectives).mapInPandas(local, schema)
    first = some.repartition(1).mapInPandas(local, schema)
    return df.join(first, objectives, "left_semi")


def dominance_counts(df: DataFrame, objectives: list[str], margin: float = 0.0, block: int = 4096) -> DataFrame:
    """Adds ``dominated_by``: the number of rows that dominate a row, equal vectors counted together.

    Vectors are cut into blocks, and a task compares two blocks as matrices. Rows
    with a null objective are dominated by none and dominate none.
    """
    weighted = written(df.na.drop(subset=objectives).groupBy(*objectives).agg(F.count("*").alias("m")), "points")
    blocks = max(1, -(-weighted.count() // block))
    placed = weighted.withColumn("own", F.pmod(F.xxhash64(*objectives), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    below = placed.select("*", F.col("own").alias("i"), every.alias("j"), F.lit(True).alias("asks"))
    above = placed.select("*", every.alias("i"), F.col("own").alias("j"), F.lit(False).alias("asks"))
    k = len(objectives)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy(bool)
        values, weight = frame[objectives].to_numpy(float), frame["m"].to_numpy()
        b, a, w = values[asks], values[~asks], weight[~asks]
        total = np.zeros(len(b), np.int64)
        for start in range(0, len(b), 1024):
            part = b[start : start + 1024]
            worse, better = np.ones((len(part), len(a)), bool), np.zeros((len(part), len(a)), bool)
            for o in range(k):
                diff = a[None, :, o] - part[:, None, o]
                worse &= diff >= -margin
                better |= diff > margin
            total[start : start + 1024] = (worse & better) @ w
        return pd.DataFrame(b, columns=objectives).assign(n=total)[lambda f: f.n > 0]

    schema = ", ".join(f"{o} double" for o in objectives) + ", n long"
    counted = below.union(above).groupBy("i", "j").applyInPandas(compare, schema).groupBy(*objectives).agg(F.sum("n").alias("dominated_by"))
    return df.join(counted, objectives, "left").withColumn("dominated_by", F.coalesce("dominated_by", F.lit(0)))


def _chained(matrix: np.ndarray) -> np.ndarray:
    """Front of each of many different vectors of three objectives, without a margin.

    A vector's front is one more than the highest front that dominates it. In
    descending order every dominating vector comes before, and a tree of trees
    over the ranks of the other two objectives knows the highest front so far.
    """
    second = np.unique(-matrix[:, 1], return_inverse=True)[1] + 1
    third = np.unique(-matrix[:, 2], return_inverse=True)[1] + 1
    rows = int(second.max(initial=0)) + 1
    trees: list[dict[int, int]] = [{} for _ in range(rows)]
    columns = int(third.max(initial=0)) + 1
    front = np.zeros(len(matrix), np.int64)
    for at in np.lexsort((-matrix[:, 2], -matrix[:, 1], -matrix[:, 0])):
        i, j = int(second[at]), int(third[at])
        best, x = 0, i
        while x:
            tree, y = trees[x], j
            while y:
                value = tree.get(y, 0)
                if value > best:
                    best = value
                y &= y - 1
            x &= x - 1
        front[at] = best
        best += 1
        x = i
        while x < rows:
            tree, y = trees[x], j
            while y < columns:
                if tree.get(y, 0) < best:
                    tree[y] = best
                y += y & -y
            x += x & -x
    return front


def _codes(matrix: np.ndarray, margin: float) -> tuple[np.ndarray, float]:
    """Values as thousandths where all are, so that differences are exact and small; else as they are."""
    whole = np.round(matrix * 1000)
    if np.abs(whole - matrix * 1000).max(initial=0) < 1e-6 and np.abs(whole).max(initial=0) < 16_000:
        return whole.astype(np.int16), round(margin * 1000, 6)
    return matrix, margin


def _peeled(matrix: np.ndarray, margin: float) -> np.ndarray:
    """Front of each vector, -1 for those in or behind a cycle.

    Vectors stand in descending order of the first objective, so that one only
    needs to be compared with those from its own value, plus the margin, on. Who
    beats whom is kept as bits for the peeling.
    """
    values, margin = _codes(matrix, margin)
    exact = values.dtype == np.int16
    order = np.argsort(-values[:, 0].astype(float), kind="stable")
    values = np.ascontiguousarray(values[order].T)
    n = values.shape[1]
    above = np.zeros(n, np.int64)
    step = 32
    beaten: list[tuple[int, np.ndarray]] = []
    falling = -values[0].astype(float)
    for i in range(0, n, step):
        first = int(np.searchsorted(falling, falling[i] - margin - 1e-9))
        worse, better = None, None
        for one in values:
            diff = one[i : i + step, None] - one[None, first:]
            diff = diff if exact else np.round(diff, 9)
            low, high = diff >= -margin, diff > margin
            worse, better = (low, high) if worse is None else (worse & low, better | high)
        beats = worse & better
        above[first:] += beats.sum(0)
        beaten.append((first, np.packbits(beats, axis=1)))
    front = np.full(n, -1)
    live = np.flatnonzero(above == 0)
    level = 0
    while len(live):
        front[live] = level
        for block in np.unique(live // step):
            first, bits = beaten[block]
            rows = live[live // step == block] - block * step
            above[first:] -= np.unpackbits(bits[rows], axis=1, count=n - first).sum(0, dtype=np.int64)
        live = np.flatnonzero((above == 0) & (front < 0))
        level += 1
    out = np.empty(n, np.int64)
    out[order] = front
    return out


def fronts(df: DataFrame, objectives: list[str], margin: float = 0.0, one_task: int = ONE_TASK) -> DataFrame:
    """Adds ``front``; null for rows in or behind a cycle of dominance, which a margin makes possible.

    Up to ``one_task`` different vectors are sorted in one task; more of them
    front by front with joins. No row is lost.
    """
    distinct = written(points(df, objectives), "points")
    n = distinct.count()
    quick = not margin and len(objectives) == 3 and one_task > 1
    if n <= (max(one_task, CHAINED) if quick else one_task):

        def sort(batches):
            frames = list(batches)
            if frames:
                frame = pd.concat(frames, ignore_index=True)
                matrix = frame[objectives].to_numpy(float)
                yield frame.assign(front=_chained(matrix) if quick else _peeled(matrix, margin))

        found = distinct.coalesce(1).mapInPandas(sort, ", ".join(f"{o} double" for o in objectives) + ", front int").where("front >= 0")
        # sorted once, however often what follows runs (range partitions are sampled first)
        return df.join(written(found, "sorted"), objectives, "left")
    live, found, level = distinct, None, 0
    while True:
        beaten = live.alias("b").join(live.alias("a"), dominates("a", "b", objectives, margin), "left_semi").select("b.*")
        beaten = written(beaten, "beaten")
        first = live.join(beaten, objectives, "left_anti").withColumn("front", F.lit(level))
        first = written(first, "front")
        if not first.take(1):
            break
        found = first if found is None else found.union(first)
        live, level = beaten, level + 1
    return df.join(found, objectives, "left")


def crowding(df: DataFrame, objectives: list[str], key: str = "id") -> DataFrame:
    """Adds ``crowding`` within each front: infinite at a front's ends and in fronts of up to two rows."""
    out = df
    size = F.count("*").over(Window.partitionBy("front"))
    terms, ends = [], []
    for i, o in enumerate(objectives):
        w = Window.partitionBy("front").orderBy(o, key)
        whole = Window.partitionBy("front")
        span = F.max(o).over(whole) - F.min(o).over(whole)
        out = out.withColumn(f"_t{i}", F.when(span > 0, (F.lead(o).over(w) - F.lag(o).over(w)) / span).otherwise(0.0)).withColumn(f"_e{i}", F.lead(o).over(w).isNull() | F.lag(o).over(w).isNull())
        terms.append(F.coalesce(F.col(f"_t{i}"), F.lit(0.0)))
        ends.append(F.col(f"_e{i}"))
    total = reduce(lambda a, b: a + b, terms)
    infinite = (size <= 2) | reduce(lambda a, b: a | b, ends)
    out = out.withColumn("crowding", F.when(F.col("front").isNotNull(), F.when(infinite, F.lit(float("inf"))).otherwise(total)))
    return out.drop(*[f"_t{i}" for i in range(len(objectives))], *[f"_e{i}" for i in range(len(objectives))])
