"""Consolidating pairwise matches into groups.

Union-find runs inside every partition of the edge table and keeps only a
spanning forest, at most one edge per node. The forests are merged level by
level through partitions of bounded size until one partition has seen a whole
component. A forest that is larger than one task may hold goes through rounds of
star contraction, in which each round brings all edges of a node together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.session import written

FOREST = "node long, root long"
#: Most forest edges that one task merges (16 bytes each).
ONE_TASK = 4_000_000
#: Edges taken into a task's union-find at a time.
CHUNK = 1 << 20


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the edges: every node that is not the smallest of its component, with that smallest node."""
    names, places = np.unique(np.r_[a, b], return_inverse=True)
    u, v = places[: len(a)], places[len(a) :]
    parent = np.arange(len(names))
    while len(u):
        pu, pv = parent[u], parent[v]
        low, high = np.minimum(pu, pv), np.maximum(pu, pv)
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        open_ = parent[u] != parent[v]
        u, v = u[open_], v[open_]
    below = parent != np.arange(len(names))
    return names[below], names[parent[below]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b, held = [], [], 0
    node, root = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held >= CHUNK:
            node, root = spanning(np.concatenate([node, *a]), np.concatenate([root, *b]))
            a, b, held = [], [], 0
    if held:
        node, root = spanning(np.concatenate([node, *a]), np.concatenate([root, *b]))
    for i in range(0, len(node), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(node[i : i + 100_000]), pa.array(root[i : i + 100_000])], ["node", "root"])


def components(edges: DataFrame, fan_in: int = 8, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for every node of an edge, root being the component's smallest node.

    ``edges`` has two long columns. Rows with a null end or with one node twice
    link nothing and are left out, repeated edges change nothing. An empty table
    gives an empty result. The result holds the smallest node itself too.
    """
    a, b = edges.columns[:2]
    clean = edges.select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("root")).na.drop()
    clean = clean.where("node <> root")
    forest = written(clean.mapInArrow(_forest, FOREST), "forest")
    held = forest.count()
    width = max(1, forest.rdd.getNumPartitions())
    # level by level: forests of several partitions become one, and edges that say the same go
    while held > one_task and width > 1 and 2 * held <= width * one_task:
        width = -(-width // max(2, min(fan_in, int(width * one_task // held))))
        forest = written(forest.coalesce(width).mapInArrow(_forest, FOREST), "forest")
        held = forest.count()
    if held > one_task:
        changed = True
        while changed:
            forest, changed = _starred(forest)
    else:
        if width > fan_in and held > CHUNK:
            forest = written(forest.coalesce(-(-width // fan_in)).mapInArrow(_forest, FOREST), "forest")
        forest = forest.coalesce(1).mapInArrow(_forest, FOREST)
    forest = written(forest, "components")
    roots = forest.select(F.col("root").alias("node"), "root").distinct()
    return forest.union(roots)


def _starred(forest: DataFrame) -> tuple[DataFrame, bool]:
    """A large-star and a small-star round after local contraction."""
    both = forest.union(forest.select(F.col("root").alias("node"), F.col("node").alias("root")))
    least = both.groupBy("node").agg(F.min("root").alias("m")).select("node", F.least("node", "m").alias("m"))
    large = both.join(least, "node").where("root > node").select(F.col("root").alias("node"), F.col("m").alias("root")).where("node <> root")
    down = large.select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root")).distinct()
    least = down.groupBy("node").agg(F.min("root").alias("m"))
    small = down.join(least, "node").select(F.when(F.col("root") == F.col("m"), F.col("node")).otherwise(F.col("root")).alias("node"), F.col("m").alias("root"))
    small = small.where("node <> root").distinct()
    after = written(small, "stars")
    changed = bool(after.exceptAll(forest.distinct()).take(1)) or bool(forest.distinct().exceptAll(after).take(1))
    return after, changed
