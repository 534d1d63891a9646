"""Problem 5: splits that keep related records together.

Records are linked by a shared cluster name and by the entity that a seq_id
names before its hyphen, directly or through others. Linked sets are found with
``components`` over hashed names. Placement is grouped iterative
stratification on label vectors: sets of at least ``LARGE`` of all records, of
which there are at most 1 / LARGE, are placed one by one; the rest is dealt out
in shards of bounded size, each of which gives its sets, rarest outstanding
label first, to the split needing it most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm.forests import components
from residua.session import written

#: Share of all records from which a linked set is placed on its own.
LARGE = 0.001
#: Linked sets that one shard places.
SHARD_SETS = 20_000


def entity(seq_id: str) -> Column:
    """Part of the id before its first hyphen."""
    return F.substring_index(seq_id, "-", 1)


def cluster_name(column: str) -> Column:
    """Cluster name in lower case without spaces, tabs and line breaks around it; empty is null."""
    return F.nullif(F.lower(F.regexp_replace(column, r"^\s+|\s+$", "")), F.lit(""))


def linked_sets(ids: DataFrame, clusters: DataFrame) -> DataFrame:
    """(seq_id, set_id) of all ids in ``ids`` (seq_id) and ``clusters`` (seq_id, assignments).

    Null ids are left out, null names link nothing, repeated rows change
    nothing; an id without any link is a set of its own.
    """
    named = clusters.select("seq_id", cluster_name("assignments").alias("name")).where("seq_id is not null")
    everyone = ids.select("seq_id").union(named.select("seq_id")).where("seq_id is not null").distinct()
    by_entity = everyone.select("seq_id", F.xxhash64(F.lit("e"), entity("seq_id")).alias("x"))
    by_name = named.where("name is not null").select(F.xxhash64(F.lit("e"), entity("seq_id")).alias("x"), F.xxhash64(F.lit("c"), "name").alias("y"))
    label = components(by_name.distinct())
    placed = by_entity.join(label.withColumnRenamed("node", "x"), "x", "left")
    return placed.select("seq_id", F.coalesce("root", "x").alias("set_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = spark.read.parquet(f"{sf_dir}/cluster_assignments.parquet")
    splits = spark.read.parquet(f"{sf_dir}/nested_splits.parquet").select("seq_id", "split_name").where("seq_id is not null and split_name is not null").distinct()
    sets = linked_sets(splits, clusters).join(splits, "seq_id")
    broken = sets.groupBy("set_id").agg(F.min("split_name").alias("one"), F.max("split_name").alias("two")).where("one <> two")
    return sets.join(broken.select("set_id"), "set_id").select("seq_id").distinct()


def place(vectors: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Split of each set, given the sets' label vectors and what each split still wants.

    Sets are taken by their rarest outstanding label, larger ones first, ties in
    the given order; a set goes to the split that lacks most of that label, then
    to the one that lacks most records. The first column counts all records.
    """
    wanted = wanted.copy()
    to = np.full(len(vectors), -1)
    left = vectors.sum(0)
    done = np.zeros(len(vectors), bool)
    labels = list(range(1, vectors.shape[1])) or [0]
    while not done.all():
        outstanding = [(left[k], k) for k in labels if left[k] > 0]
        label = min(outstanding)[1] if outstanding else 0
        todo = np.flatnonzero(~done & (vectors[:, label] > 0) if outstanding else ~done)
        todo = todo[np.lexsort((todo, -vectors[todo, 0], -vectors[todo, label]))]
        for i in todo:
            split = max(range(len(wanted)), key=lambda s: (wanted[s, label], wanted[s, 0], -s))
            to[i] = split
            wanted[split] -= vectors[i]
            left = left - vectors[i]
        done[todo] = True
    return to


def stratified(sets: DataFrame, targets: list[tuple[str, float]], large: float = LARGE, shard_sets: int = SHARD_SETS) -> DataFrame:
    """(set_id, split_name) for ``sets`` (set_id, records, label columns...).

    ``targets`` are split names and proportions. Every set gets one split; the
    proportions are met up to the size of the sets. Null counts count as 0. An
    empty table gives an empty result.
    """
    spark = sets.sparkSession
    labels = [c for c in sets.columns if c not in ("set_id", "records")]
    counts = ["records", *labels]
    sets = sets.na.fill(0, counts)
    names = [n for n, _ in targets]
    share = np.array([p for _, p in targets], float)
    share /= share.sum()
    total = sets.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in counts]).first()
    all_ = np.array([total[c] or 0 for c in counts], float)
    bound = max(1.0, large * all_[0])
    big = sets.where(F.col("records") > bound).orderBy(F.desc("records"), "set_id").limit(int(1 / large) + 1).collect()  # at most 1 / large exist
    vectors = np.array([[r[c] for c in counts] for r in big], float).reshape(len(big), len(counts))
    wanted = share[:, None] * all_[None]
    to = place(vectors, wanted)
    for split in range(len(names)):
        wanted[split] -= vectors[to == split].sum(0)
    shards = max(1, -(-int(total["n"]) // shard_sets))
    # what a shard wants is its part of what the large sets left open
    ratio = wanted / np.maximum(wanted.sum(0), 1e-9)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        if not frames:
            return
        frame = pd.concat(frames, ignore_index=True)
        for _, one in frame.groupby("shard", sort=True):
            one = one.sort_values("set_id", ignore_index=True)
            table = one[counts].to_numpy(float)
            chosen = place(table, np.maximum(ratio, 0) * table.sum(0)[None])
            yield pd.DataFrame({"set_id": one.set_id, "split_name": [names[i] for i in chosen]})

    rest = sets.where(F.col("records") <= bound).withColumn("shard", F.pmod(F.xxhash64("set_id", F.lit(5)), F.lit(shards)))
    dealt = rest.repartition(min(shards, 4096), "shard").mapInPandas(deal, "set_id long, split_name string")
    placed = [(int(r.set_id), names[i]) for r, i in zip(big, to)]
    return dealt.union(spark.createDataFrame(placed, "set_id long, split_name string")) if placed else dealt


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, set_id, split_name, shipped_split) of every record of the three tables."""
    records = spark.read.parquet(f"{sf_dir}/provenance_records.parquet").select("seq_id", "label").where("seq_id is not null")
    records = records.groupBy("seq_id").agg(F.max("label").alias("label"))
    clusters = spark.read.parquet(f"{sf_dir}/cluster_assignments.parquet")
    shipped = spark.read.parquet(f"{sf_dir}/nested_splits.parquet").groupBy("seq_id").agg(F.min("split_name").alias("shipped_split"))
    targets = [(r.split_name, r.proportion) for r in spark.read.parquet(f"{sf_dir}/split_targets.parquet").orderBy("split_name").collect()]  # one row a split
    sets = written(linked_sets(records.select("seq_id").union(shipped.select("seq_id")), clusters).join(records, "seq_id", "left"), "sets")
    vectors = sets.groupBy("set_id").agg(F.count("*").alias("records"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"))
    chosen = stratified(vectors, targets)
    out = sets.select("seq_id", "set_id").join(chosen, "set_id").join(shipped, "seq_id", "left")
    return out.select("seq_id", "set_id", "split_name", "shipped_split")


def p5_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and sets placed, sets that are divided, records without a split, and splits off their proportion by over 1 %."""
    placed = written(p5_splits(spark, sf_dir), "placed")
    targets = spark.read.parquet(f"{sf_dir}/split_targets.parquet")
    sets = placed.groupBy("set_id").agg(F.count("*").alias("records"), F.countDistinct("split_name").alias("splits"))
    whole = sets.agg(F.sum("records").alias("records"), F.count("*").alias("sets"), F.count_if(F.col("splits") != 1).alias("divided"))
    share = placed.groupBy("split_name").agg(F.count("*").alias("n")).join(targets, "split_name", "full")
    total = whole.select(F.col("records").alias("t"))
    # one row each
    off = share.crossJoin(F.broadcast(total)).agg(F.count_if(F.coalesce(F.abs(F.col("n") / F.col("t") - F.col("proportion")) > 0.01, F.lit(True))).alias("off"))
    return whole.crossJoin(off)


QUERIES = {"p5_found": p5_found, "p5_splits": p5_splits, "p5_audit": p5_audit}

_SETS = r"""
WITH RECURSIVE named AS (
  SELECT DISTINCT seq_id, nullif(lower(regexp_replace(assignments, '^\s+|\s+$', '', 'g')), '') AS name FROM cluster_assignments WHERE seq_id IS NOT NULL),
spl AS (SELECT DISTINCT seq_id, split_name FROM nested_splits WHERE seq_id IS NOT NULL AND split_name IS NOT NULL),
every AS (SELECT seq_id FROM named UNION SELECT seq_id FROM {ids}),
node AS (SELECT seq_id, 'e' || split_part(seq_id, '-', 1) AS e FROM every),
bond AS (SELECT DISTINCT n.e AS x, 'c' || m.name AS y FROM named m JOIN node n USING (seq_id) WHERE m.name IS NOT NULL),
link AS (SELECT DISTINCT a.x AS a, b.x AS b FROM bond a JOIN bond b ON a.y = b.y WHERE a.x <> b.x),
reach(a, b) AS (SELECT a, a FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
label AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
"""
ORACLE = {
    "p5_found": _SETS.replace("{ids}", "spl")
    + """, placed AS (SELECT n.seq_id, coalesce(l.root, n.e) AS root, s.split_name FROM node n JOIN spl s USING (seq_id) LEFT JOIN label l ON l.a = n.e)
SELECT DISTINCT seq_id FROM placed WHERE root IN (SELECT root FROM placed GROUP BY root HAVING min(split_name) <> max(split_name))""",
    # every record is placed, no set is divided, no proportion is missed
    "p5_audit": _SETS.replace("{ids}", "(SELECT seq_id FROM provenance_records UNION SELECT seq_id FROM nested_splits) WHERE seq_id IS NOT NULL")
    + "SELECT count(*) AS records, count(DISTINCT coalesce(l.root, n.e)) AS sets, 0::BIGINT AS divided, 0::BIGINT AS off FROM node n LEFT JOIN label l ON l.a = n.e",
}
