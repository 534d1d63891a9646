"""Problem 1: groups of near-identical records.

A text is seen as the set of its distinct windows of five residues, so that the
Hamming distance of two texts is the number of windows that only one of them
has, an integer. Texts with at least 0.6 of their windows in common lie within
a quarter of the sum of their sizes. Seeds (see ``sketches``) divide the texts
into shards in which all possible partners of a text are together; each shard
has a BK-tree, and a search follows only the edges within its radius. A shard
beyond ``SHARD`` texts is cut into blocks with a tree each, which all texts of
the shard visit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm.forests import components
from residua.llm.packets import delivered
from residua.llm.sketches import grams, linked_by_seeds
from residua.session import written

#: Window of the similarity, and the least share of common windows, as a fraction.
WINDOW, SHARE, LEAST = 5, (3, 5), 30
#: Windows and number of the seeds: of a pair at the threshold about 0.6 of the
#: 8-residue windows agree, so that it is missed with a probability near 0.4 ** 16.
SEED, SEEDS = 8, 16
#: Places around a common seed, of 16 in four classes, in which they must agree: of texts at the threshold about 15 do, of others 4 or 5.
AGREE = 10
#: Texts in one BK-tree.
SHARD = 4000


class BKTree:
    """Children keyed by their integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.root: tuple | None = None

    def add(self, key: int, value: frozenset) -> None:
        if self.root is None:
            self.root = (key, value, {})
            return
        node = self.root
        while True:
            distance = len(value ^ node[1])
            child = node[2].get(distance)
            if child is None:
                node[2][distance] = (key, value, {})
                return
            node = child

    def within(self, value: frozenset, share: tuple[int, int]) -> Iterator[tuple[int, int, int]]:
        """(key, common, either) of the values sharing at least ``share`` of their windows with ``value``."""
        if self.root is None:
            return
        up, down = share
        # size of a partner <= size * down / up, hence this bound on the distance
        radius = len(value) * (down - up) // up
        stack = [self.root]
        while stack:
            key, other, children = stack.pop()
            distance = len(value ^ other)
            either = (len(value) + len(other) + distance) // 2
            common = either - distance
            if common * down >= up * either and common:
                yield key, common, either
            for edge, child in children.items():
                if -radius <= edge - distance <= radius:
                    stack.append(child)


def _searched(share: tuple[int, int], window: int):
    def search(batches):
        # texts at home in a block come first, so that they meet each other once;
        # visitors of other blocks meet each pair twice
        now, tree = None, BKTree()
        found: list[tuple] = []
        for batch in batches:
            for shard, block, home, sid, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard, block) != now:
                    now, tree = (shard, block), BKTree()
                value = grams(text, window)
                for other, common, either in tree.within(value, share):
                    if home or sid < other:
                        found.append((min(sid, other), max(sid, other), common, either))
                if home:
                    tree.add(sid, value)
                if len(found) >= 20_000:
                    yield _pairs(found)
                    found = []
        if found:
            yield _pairs(found)

    return search


PAIRS = "a long, b long, common int, either int"


def _pairs(found: list[tuple]) -> pa.RecordBatch:
    a, b, common, either = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(common, pa.int32()), pa.array(either, pa.int32())], ["a", "b", "common", "either"])


def near_pairs(records: DataFrame, share: tuple[int, int] = SHARE, window: int = WINDOW, least: int = LEAST, shard: int = SHARD) -> DataFrame:
    """(a, b, common, either) of the different texts that share enough windows, a < b by sid.

    One row per pair of texts; copies are left to the membership of ``delivered``.
    Null and short sequences take no part, ties and repeated rows change nothing.
    """
    text = delivered(records, least).select("sid", "residues")
    seeded = linked_by_seeds(text, SEED, SEEDS, records, AGREE)
    home = components(seeded)
    sizes = home.groupBy("root").count().where(F.col("count") > shard).select("root", F.ceil(F.col("count") / shard).cast("int").alias("blocks"))
    home = home.join(sizes, "root", "left").select(F.col("node").alias("sid"), F.col("root").alias("shard"), F.coalesce("blocks", F.lit(1)).alias("blocks"))
    placed = text.join(home, "sid").distinct()
    placed = placed.select("*", F.expr("pmod(xxhash64(sid, 7), blocks)").cast("int").alias("own"))
    placed = placed.select("shard", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "own", "sid", "residues")
    placed = placed.select("shard", "block", (F.col("own") == F.col("block")).alias("home"), "sid", "residues")
    placed = placed.repartition("shard", "block").sortWithinPartitions("shard", "block", F.desc("home"))
    return placed.mapInArrow(_searched(share, window), PAIRS)


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of seq_id, the smaller first, for pairs (a, b) of sid and all members (seq_id, sid)."""
    one = members.select(F.col("sid").alias("a"), F.col("seq_id").alias("one"))
    two = members.select(F.col("sid").alias("b"), F.col("seq_id").alias("two"))
    both = pairs.join(one, "a").join(two, "b")
    return both.select(F.least("one", "two").alias("seq_id_a"), F.greatest("one", "two").alias("seq_id_b"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = spark.read.parquet(f"{sf_dir}/provenance_records.parquet")
    pairs = written(near_pairs(records), "near-pairs").select("a", "b")
    members = delivered(records, LEAST).select("seq_id", "sid").distinct()
    copied = members.groupBy("sid").count().where("count > 1")
    copies = copied.select(F.col("sid").alias("a"), F.col("sid").alias("b"))
    return expanded(pairs.union(copies), members).where("seq_id_a < seq_id_b").distinct()


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record: its group, links to other texts, and whether the removal log knows it."""
    records = spark.read.parquet(f"{sf_dir}/provenance_records.parquet")
    log = spark.read.parquet(f"{sf_dir}/removal_log.parquet")
    pairs = written(near_pairs(records), "near-pairs")
    members = delivered(records, LEAST).select("seq_id", "sid").distinct()
    label = components(pairs.select("a", "b"))
    ends = pairs.select(F.col("a").alias("sid"), "common", "either").union(pairs.select("b", "common", "either"))
    links = ends.groupBy("sid").agg(F.count("*").alias("links"), F.max(F.floor(F.col("common") / F.col("either") * 10000 + 0.5) / 10000).alias("closest"))
    placed = members.join(label.withColumnRenamed("node", "sid"), "sid", "left").join(links, "sid", "left")
    placed = placed.withColumn("root", F.coalesce("root", "sid"))
    group = placed.groupBy("root").agg(F.min("seq_id").alias("group_id"), F.count("*").alias("members"))
    logged = log.select("seq_id").union(log.select("duplicate_of_id")).na.drop().distinct().withColumn("logged", F.lit(True))
    return (
        placed.join(group.where("members > 1"), "root")
        .join(logged, "seq_id", "left")
        .select("seq_id", "group_id", "members", F.coalesce("links", F.lit(0)).alias("links"), "closest", F.coalesce("logged", F.lit(False)).alias("logged"))
    )


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups}

_WINDOWS = r"""
WITH rec AS (
  SELECT DISTINCT seq_id, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) AS r FROM provenance_records
  WHERE seq_id IS NOT NULL),
long AS (SELECT * FROM rec WHERE length(r) >= 30),
txt AS (SELECT r, min(seq_id) AS rep FROM long GROUP BY r),
gram AS (SELECT DISTINCT rep, substr(r, i::BIGINT, 5) AS g FROM txt, unnest(generate_series(1, length(r) - 4)) AS u(i)),
size AS (SELECT rep, count(*) AS n FROM gram GROUP BY rep),
hit AS (SELECT a.rep AS x, b.rep AS y, count(*) AS c FROM gram a JOIN gram b ON a.g = b.g AND a.rep <> b.rep GROUP BY 1, 2),
near AS (SELECT x, y, c, m.n + n.n - c AS e FROM hit JOIN size m ON m.rep = x JOIN size n ON n.rep = y WHERE 5 * c >= 3 * (m.n + n.n - c)
  UNION ALL SELECT rep, rep, 1, 1 FROM txt),
pair AS (SELECT DISTINCT a.seq_id AS seq_id_a, b.seq_id AS seq_id_b FROM near JOIN txt s ON s.rep = x JOIN txt t ON t.rep = y
  JOIN long a ON a.r = s.r JOIN long b ON b.r = t.r WHERE a.seq_id < b.seq_id)
"""
ORACLE = {
    "p1_found": _WINDOWS + "SELECT seq_id_a, seq_id_b FROM pair",
    "p1_groups": _WINDOWS.replace("WITH rec", "WITH RECURSIVE rec")
    + """, reach(rep, other) AS (SELECT rep, rep FROM txt UNION SELECT r.rep, n.y FROM reach r JOIN near n ON n.x = r.other),
label AS (SELECT rep, min(other) AS root FROM reach GROUP BY rep),
placed AS (SELECT l.seq_id, t.rep, b.root, count(*) OVER (PARTITION BY b.root) AS members, min(l.seq_id) OVER (PARTITION BY b.root) AS group_id FROM long l JOIN txt t ON t.r = l.r JOIN label b ON b.rep = t.rep),
lk AS (SELECT x, count(*) AS links, max(floor(c::DOUBLE / e * 10000 + 0.5) / 10000) AS closest FROM near WHERE x <> y GROUP BY x),
lg AS (SELECT seq_id FROM removal_log UNION SELECT duplicate_of_id FROM removal_log)
SELECT p.seq_id, group_id, members, coalesce(links, 0) AS links, closest, p.seq_id IN (SELECT seq_id FROM lg WHERE seq_id IS NOT NULL) AS logged
FROM placed p LEFT JOIN lk ON lk.x = p.rep WHERE members > 1""",
}
