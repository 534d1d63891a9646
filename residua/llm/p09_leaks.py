"""Problem 9: evaluation passages inside documents.

Texts are compared as words. Every stretch of twelve consecutive words of an
item is a pattern; all patterns are searched at once by the Wu-Manber method.
Block values of two words lead to a shift table, which tells how far the search
window can move without missing a pattern, and, where the shift is zero, to the
patterns that end with the block, which are compared directly. The held-out
set is bounded by its role as an evaluation set and is checked against
``MOST_WORDS`` before it goes to the executors; a larger set is searched in
parts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that must agree, words of a block, and words of all items in one search.
LEAST, BLOCK, MOST_WORDS = 12, 2, 2_000_000
WORD = regex.compile(r"[\p{L}\p{N}]+")


def words(text: str) -> list[str]:
    """Longest runs of letters or digits, in lower case."""
    return [w.lower() for w in WORD.findall(text)]


class WuManber:
    """Search for many patterns of ``length`` words each."""

    def __init__(self, items: list[tuple[int, list[str]]], length: int = LEAST):
        self.length = length
        self.shift: dict[tuple[str, str], int] = {}
        self.ending: dict[tuple[str, str], dict[tuple, set[int]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            for at in range(len(text) - length + 1):
                pattern = tuple(text[at : at + length])
                for end in range(BLOCK, length + 1):
                    block = pattern[end - 2], pattern[end - 1]
                    self.shift[block] = min(self.shift.get(block, length), length - end)
                self.ending[pattern[-2], pattern[-1]][pattern].add(item)
        self.most = length - BLOCK + 1
        self.ending = {block: dict(patterns) for block, patterns in self.ending.items()}

    def items_in(self, text: list[str]) -> set[int]:
        found: set[int] = set()
        at, end, shift, most = self.length - 1, len(text), self.shift, self.most
        while at < end:
            block = text[at - 1], text[at]
            move = shift.get(block, most)
            if move:
                at += move
                continue
            items = self.ending[block].get(tuple(text[at - self.length + 1 : at + 1]))
            if items:
                found |= items
            at += 1
        return found


def leaks(documents: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id) where a document holds ``least`` consecutive words of an item.

    Null ids and null or empty texts, and items with fewer words, match nothing;
    repeated rows give one row; other columns are not read. Whole texts are
    searched, without any limit of length.
    """
    spark = documents.sparkSession
    found: list[DataFrame] = []
    part: list[tuple[int, list[str]]] = []
    held = 0

    def search(part):
        table = spark.sparkContext.broadcast({"items": part})

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a worker keeps the value for its later tasks, and the machine with it
            held = table.value
            if "machine" not in held:
                held["machine"] = WuManber(held.pop("items"), least)
            machine = held["machine"]
            for batch in batches:
                out = [(doc, item) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for item in sorted(machine.items_in(words(text)))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "item_id"])

        rows = documents.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
        return rows.mapInArrow(work, "doc_id long, item_id long")

    for row in items.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator():
        text = words(row.text)
        part.append((row.item_id, text))
        held += len(text)
        if held >= MOST_WORDS:
            found.append(search(part))
            part, held = [], 0
    found.append(search(part))
    all_ = found[0]
    for one in found[1:]:
        all_ = all_.union(one)
    return all_.distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/heldout_items.parquet"))


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every held-out item with the number of documents that hold passages of it."""
    items = spark.read.parquet(f"{sf_dir}/heldout_items.parquet").select("item_id", "item_set")
    counts = p9_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.join(counts, "item_id", "left").select("item_id", "item_set", F.coalesce("documents", F.lit(0)).alias("documents"))


QUERIES = {"p9_found": p9_found, "p9_items": p9_items}

_LEAKS = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, item_set, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM heldout_items),
dg AS (SELECT doc_id, lower(array_to_string(w[i:i+11], ' ')) AS g FROM dw, unnest(generate_series(1, len(w) - 11)) AS u(i)),
ig AS (SELECT DISTINCT item_id, lower(array_to_string(w[i:i+11], ' ')) AS g FROM iw, unnest(generate_series(1, len(w) - 11)) AS u(i)),
found AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))
"""
ORACLE = {
    "p9_found": _LEAKS + "SELECT doc_id, item_id FROM found",
    "p9_items": _LEAKS + "SELECT i.item_id, i.item_set, count(f.doc_id) AS documents FROM heldout_items i LEFT JOIN found f ON f.item_id = i.item_id GROUP BY 1, 2",
}
