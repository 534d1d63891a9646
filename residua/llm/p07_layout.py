"""Problem 7: duplicates hidden by how they are written.

Rows are brought to canonical bytes. The bytes' own leading values divide them
into buckets: the histogram of the first bytes is refined, for buckets that are
too large, by further bytes until each fits. Every
bucket is then counted in a trie whose terminals hold the number of copies and
the smallest key. Equal rows are combined before each shuffle, so that a value
that very many rows have travels once per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm.packets import residues
from residua.session import written

#: Distinct values in one bucket, and the bytes of a bucket's name, twice as many
#: each time that it is split further.
BUCKET, STEP = 200_000, 2


def canonical_fields(column: str) -> Column:
    """Fields between ``|`` and ``;``, letters and digits only, lower case, sorted, empty ones left out.

    Null where no field is left.
    """
    fields = F.transform(F.split(column, "[|;]"), lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]+", "")))
    fields = F.array_sort(F.filter(fields, lambda x: x != ""))
    return F.when(F.size(fields) > 0, F.array_join(fields, "|"))


class Trie:
    """Radix trie over bytes; a node is [label, children, count, smallest key]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, 0, None]

    def add(self, value: bytes, count: int, key: str) -> None:
        node, at = self.root, 0
        while True:
            if at == len(value):
                node[2] += count
                node[3] = key if node[3] is None else min(node[3], key)
                return
            child = node[1].get(value[at])
            if child is None:
                node[1][value[at]] = [value[at:], {}, count, key]
                return
            label = child[0]
            end = at + len(label)
            if value[at:end] == label:
                node, at = child, end
                continue
            n, most = 1, min(len(label), len(value) - at)
            while n < most and label[n] == value[at + n]:
                n += 1
            # cut the edge where value leaves it
            node[1][value[at]] = fork = [label[:n], {label[n]: child}, 0, None]
            child[0] = label[n:]
            node, at = fork, at + n

    def terminals(self) -> Iterator[tuple[bytes, int, str]]:
        stack = [(self.root, b"")]
        while stack:
            node, before = stack.pop()
            value = before + node[0]
            if node[2]:
                yield value, node[2], node[3]
            stack.extend((child, value) for child in node[1].values())


VALUES = "value binary, n long, first_key string"


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies within a task's window of rows become one row."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by("value", use_threads=False).aggregate([("n", "sum"), ("first_key", "min")])
        table = table.rename_columns(["value", "n", "first_key"]).combine_chunks()
        yield from table.to_batches()


def bucket_names(values: DataFrame, most: int = BUCKET) -> list[bytes]:
    """Names (leading bytes) of buckets that are too large and were split further.

    Values come combined, so that copies weigh little here. Splitting ends where
    no value of a bucket goes on beyond its name. Only names of oversized buckets
    come to the driver: at most rows / ``most`` for each number of bytes.
    """
    split: list[bytes] = []
    open_, width = values.select("value"), STEP
    while True:
        head = F.substring("value", 1, width)
        large = open_.groupBy(head.alias("head")).agg(F.count("*").alias("n"), F.max(F.octet_length("value")).alias("longest"))
        names = [bytes(r.head) for r in large.where((F.col("n") > most) & (F.col("longest") > width)).select("head").toLocalIterator()]
        if not names:
            return split
        split += names
        open_ = open_.where(F.substring("value", 1, width).isin([F.lit(n) for n in names]))
        width *= 2


def _bucketed(split: list[bytes]) -> Column:
    """A value's bucket name: its first bytes, more of them below split names."""
    name = F.substring("value", 1, STEP)
    width = STEP
    while width <= max(map(len, split), default=0):
        known = [F.lit(n) for n in split if len(n) == width]
        if known:
            name = F.when(F.substring("value", 1, width).isin(known), F.substring("value", 1, 2 * width)).otherwise(name)
        width *= 2
    return name


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket to the terminals of the buckets' tries that have copies."""
    now, trie = None, Trie()
    for batch in batches:
        out: list[tuple] = []
        for bucket, value, n, key in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now:
                out += [t for t in trie.terminals() if t[1] > 1]
                now, trie = bucket, Trie()
            trie.add(value, n, key)
        if out:
            yield _rows(out)
    out = [t for t in trie.terminals() if t[1] > 1]
    for i in range(0, len(out), 50_000):
        yield _rows(out[i : i + 50_000])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    value, n, key = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(value, pa.binary()), pa.array(n, pa.int64()), pa.array(key, pa.string())], ["value", "n", "first_key"])


def copies(rows: DataFrame, most: int = BUCKET) -> DataFrame:
    """(value, n, first_key) of every canonical value that several of ``rows`` (row_key, value) have.

    ``row_key`` must be unique. Null or empty values and null keys count
    nowhere; ties go to the smallest key by code point; an empty table gives an
    empty result.
    """
    plain = rows.where("value is not null and value <> '' and row_key is not null")
    plain = plain.select(F.encode("value", "UTF-8").alias("value"), F.lit(1).cast("long").alias("n"), F.col("row_key").alias("first_key"))
    fewer = plain.mapInArrow(_combined, VALUES)
    split = bucket_names(fewer, most)
    named = fewer.select(_bucketed(split).alias("bucket"), "value", "n", "first_key")
    placed = named.repartition("bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(_counted, VALUES)


def _found(rows: DataFrame) -> DataFrame:
    """(row_key, first_key) of the members of every set of copies."""
    sets = copies(rows).select(F.xxhash64("value", F.lit(3)).alias("h"), F.xxhash64("value", F.lit(4)).alias("g"), "first_key")
    value = F.encode("value", "UTF-8")
    members = rows.where("value is not null and value <> ''").select("row_key", F.xxhash64(value, F.lit(3)).alias("h"), F.xxhash64(value, F.lit(4)).alias("g"))
    return members.join(sets, ["h", "g"]).select("row_key", "first_key")


def record_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record: repeated deliveries of a seq_id are no copies."""
    records = spark.read.parquet(f"{sf_dir}/provenance_records.parquet").where("seq_id is not null")
    rows = records.select(F.col("seq_id").alias("row_key"), residues("sequence").alias("value")).where("value <> ''")
    return rows.distinct()


def submission_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/sanitization_results.parquet")
    return table.select(F.col("result_id").alias("row_key"), canonical_fields("original_sequence").alias("value"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(record_rows(spark, sf_dir)).union(_found(submission_rows(spark, sf_dir)))


def p7_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin, first_key, copies): one row per entry that several rows have."""
    one = copies(record_rows(spark, sf_dir)).select(F.lit("record").alias("origin"), "first_key", F.col("n").alias("copies"))
    two = copies(submission_rows(spark, sf_dir)).select(F.lit("submission").alias("origin"), "first_key", F.col("n").alias("copies"))
    return one.union(two)


QUERIES = {"p7_found": p7_found, "p7_entries": p7_entries}

_COPIES = r"""
WITH rec AS (
  SELECT DISTINCT seq_id AS k, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) AS v FROM provenance_records WHERE seq_id IS NOT NULL),
sub AS (
  SELECT result_id AS k, array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(original_sequence, '[|;]'),
    lambda x: lower(regexp_replace(x, '[^\p{L}\p{N}]+', '', 'g'))), lambda x: x <> '')), '|') AS v FROM sanitization_results),
rows AS (SELECT 'record' AS origin, k, v FROM rec WHERE v <> '' UNION ALL SELECT 'submission', k, v FROM sub WHERE v <> ''),
sets AS (SELECT origin, v, min(k) AS first_key, count(*) AS n FROM rows GROUP BY origin, v HAVING count(*) > 1)
"""
ORACLE = {
    "p7_found": _COPIES + "SELECT r.k AS row_key, s.first_key FROM rows r JOIN sets s ON s.origin = r.origin AND s.v = r.v",
    "p7_entries": _COPIES + "SELECT origin, first_key, n AS copies FROM sets",
}
