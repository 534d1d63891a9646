"""Problem 8: texts packed into containers of fixed capacity.

Lengths are counted in a histogram of at most ``BINS`` units per capacity. All
combinations of up to ``DEPTH`` units that fill a container are enumerated, the
number of times each is used is solved against the histogram by non-negative
least squares and rounded down; what is left over is packed greedily, longest
first, into the open container with the least sufficient room. The plan says
for each unit which container its first, second, ... text goes to; texts are
numbered within their unit by slot and, inside a slot, by id, so that a task that
runs again gives the same numbers. Only texts that exceed the capacity are cut,
into full containers and one remainder that is packed like any other text.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.session import written

#: Units of a capacity, texts per solved combination, rounds of the solver.
BINS, DEPTH, ROUNDS = 1024, 3, 300
#: Texts in a slot, in which one task numbers them, and most slots.
SLOT, SLOTS = 50_000, 4096


def byte_tokens(column: str) -> Column:
    """Size under the byte tokenizer: UTF-8 bytes and one end mark; null for null."""
    return F.octet_length(column) + 1


def combinations(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Non-increasing combinations of up to ``depth`` units with sum ``bins``."""
    found = [(bins,)]
    if depth >= 2:
        found += [(a, bins - a) for a in range((bins + 1) // 2, bins)]
    if depth >= 3:
        found += [(a, b, bins - a - b) for a in range((bins + 2) // 3, bins - 1) for b in range((bins - a + 1) // 2, min(a, bins - a - 1) + 1)]
    return found


def solved(histogram: np.ndarray, plans: list[tuple[int, ...]], rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 with small |A x - histogram|, by accelerated projected gradient steps.

    Steps end when ten of them lower the distance by less than a thousandth.
    Column j of A counts the units in combination j; short lengths, which fill
    gaps anyway, weigh less than long ones.
    """
    depth = max(map(len, plans))
    index = np.array([p + (0,) * (depth - len(p)) for p in plans])
    weight = np.sqrt(np.arange(len(histogram)) / len(histogram))
    weight[0] = 0
    target = histogram * weight

    def forward(x):
        total = np.zeros(len(histogram))
        for d in range(depth):
            total += np.bincount(index[:, d], x, len(histogram))
        total[0] = 0
        return total * weight

    def backward(r):
        r = r * weight
        r[0] = 0
        return r[index].sum(1)

    v = np.ones(len(plans))
    for _ in range(20):  # largest eigenvalue of A'A
        v = backward(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / norm
    x = y = np.zeros(len(plans))
    t, before = 1.0, np.inf
    for turn in range(rounds):
        if turn % 10 == 0:
            distance = float(np.linalg.norm(forward(x) - target))
            if distance > 0.999 * before:
                break
            before = min(before, distance)
        new = np.maximum(y - step * backward(forward(y) - target), 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


class Plan:
    """For every unit, ranges of text numbers with the container of the first and the step between containers."""

    def __init__(self, histogram: np.ndarray, bins: int = BINS, depth: int = DEPTH):
        left = histogram.astype(np.int64).copy()
        ranges: dict[int, list[tuple[int, int]]] = {u: [] for u in range(1, bins + 1)}
        taken = np.zeros(bins + 1, np.int64)
        container = 0
        plans = combinations(bins, depth)
        repeat = np.floor(solved(histogram.astype(float), plans)).astype(np.int64) if left.sum() else np.zeros(len(plans), np.int64)
        for j in sorted(np.flatnonzero(repeat), key=lambda j: -repeat[j]):
            plan = plans[j]
            units, each = np.unique(plan, return_counts=True)
            times = int(min(repeat[j], *(left[units] // each)))
            if times <= 0:
                continue
            for unit in plan:
                ranges[unit].append((int(taken[unit]), container))
                taken[unit] += times
                left[unit] -= times
            container += times
        # residuals, longest first: best fit by room, whole batches of equal texts at a time
        room: list[int] = []  # rooms with open containers, sorted
        open_: dict[int, list[tuple[int, int]]] = {}  # room -> batches (first container, number)
        for unit in range(bins, 0, -1):
            while left[unit] > 0:
                at = bisect_left(room, unit)
                if at < len(room):
                    space = room[at]
                    first, number = open_[space].pop()
                    if not open_[space]:
                        room.pop(at)
                        del open_[space]
                    fill = 1
                else:
                    space, first, fill = bins, container, max(1, bins // unit)
                    number = -(-int(left[unit]) // fill)
                    container += number
                used = min(number, int(left[unit]))
                if used < number:
                    self._open(room, open_, space, first + used, number - used)
                times = 0
                while times < fill and left[unit] > 0:
                    some = min(used, int(left[unit]))
                    ranges[unit].append((int(taken[unit]), first))
                    taken[unit] += some
                    left[unit] -= some
                    if some < used:
                        self._open(room, open_, space - times * unit, first + some, used - some)
                        used = some
                    times += 1
                self._open(room, open_, space - times * unit, first, used)
        self.containers = container
        self.starts = {u: np.array([s for s, _ in r], np.int64) for u, r in ranges.items()}
        self.first = {u: np.array([c for _, c in r], np.int64) for u, r in ranges.items()}

    @staticmethod
    def _open(room: list[int], open_: dict, space: int, first: int, number: int) -> None:
        if space <= 0 or number <= 0:
            return
        if space not in open_:
            insort(room, space)
            open_[space] = []
        open_[space].append((first, number))

    def table(self) -> tuple[int, dict[int, tuple[np.ndarray, np.ndarray]]]:
        """Number of containers, and the ranges of every unit, as plain values."""
        return self.containers, {u: (self.starts[u], self.first[u]) for u in self.starts}


def container_of(ranges: tuple[np.ndarray, np.ndarray], number: np.ndarray) -> np.ndarray:
    """Container of the text with this number within its unit."""
    starts, first = ranges
    at = np.searchsorted(starts, number, "right") - 1
    return first[at] + number - starts[at]


PLACED = "doc_id long, part_no int, token_start long, tokens long, container long"


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, size, slot) of every text, written once for all capacities; null ids or texts are left out."""
    slots = max(1, min(SLOTS, -(-documents.count() // SLOT)))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), byte_tokens("text").cast("long").alias("size")).where("doc_id is not null and size is not null")
    return written(rows.withColumn("slot", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(slots)).cast("int")), "sizes")


def packed(documents: DataFrame, capacity: int, bins: int = BINS) -> DataFrame:
    """(doc_id, part_no, token_start, tokens, container) of every text.

    Empty texts take one token. Null ids or texts are left out, repeated rows
    are packed each. A text within the capacity has part 0 only; a longer one has
    full parts in containers of their own and a remainder.
    """
    return packed_sizes(sized(documents), capacity, bins)


def packed_sizes(rows: DataFrame, capacity: int, bins: int = BINS) -> DataFrame:
    """As ``packed``, for rows of ``sized``."""
    spark = rows.sparkSession
    bins = min(bins, capacity)
    unit = capacity / bins

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            size, slot = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            rest = size % capacity
            units = np.ceil(np.where((size <= capacity), size, rest) / unit).astype(np.int64)
            for s in np.unique(slot):
                one = counts.setdefault(int(s), np.zeros(bins + 2, np.int64))
                here = slot == s
                one[: bins + 1] += np.bincount(units[here], minlength=bins + 1)
                one[bins + 1] += np.where(size[here] > capacity, size[here] // capacity, 0).sum()
        for s, one in counts.items():
            some = np.flatnonzero(one)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), s), pa.int32()), pa.array(some, pa.int32()), pa.array(one[some])], ["slot", "unit", "n"])

    # at most SLOTS * (BINS + 2) rows
    counted = rows.repartition("slot").mapInArrow(tally, "slot int, unit int, n long").groupBy("slot", "unit").agg(F.sum("n").alias("n")).orderBy("slot", "unit").toLocalIterator()
    histogram = np.zeros(bins + 2, np.int64)
    before: dict[int, np.ndarray] = {}
    for r in counted:
        if r.slot not in before:
            before[r.slot] = histogram.copy()
        histogram[r.unit] += r.n
    plan = Plan(np.r_[0, histogram[1 : bins + 1]], bins)
    held = spark.sparkContext.broadcast((*plan.table(), before))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        containers, ranges, before = held.value
        number: dict[int, np.ndarray] = {}
        for batch in batches:
            doc, size, slot = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            rest = np.where(size <= capacity, size, size % capacity)
            units = np.ceil(rest / unit).astype(np.int64)
            container = np.zeros(len(doc), np.int64)
            full_first = np.zeros(len(doc), np.int64)
            fulls = np.where(size > capacity, size // capacity, 0)
            for s in np.unique(slot):
                next_ = number.setdefault(int(s), before[int(s)].copy())
                here = np.flatnonzero(slot == s)
                for u in np.unique(units[here]):
                    some = here[units[here] == u]
                    if u:
                        container[some] = container_of(ranges[int(u)], next_[u] + np.arange(len(some)))
                    next_[u] += len(some)
                run = np.cumsum(fulls[here])
                full_first[here] = containers + next_[bins + 1] + run - fulls[here]
                next_[bins + 1] += run[-1]
            keep = rest > 0
            out = [(doc[keep], fulls[keep], fulls[keep] * capacity, rest[keep], container[keep])]
            if fulls.any():
                owner = np.repeat(np.arange(len(doc)), fulls)
                part = np.arange(len(owner)) - np.repeat(np.cumsum(fulls) - fulls, fulls)
                out.append((doc[owner], part, part * capacity, np.full(len(owner), capacity), full_first[owner] + part))
            columns = [np.concatenate(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in columns[2:])], ["doc_id", "part_no", "token_start", "tokens", "container"])

    return rows.repartition("slot").sortWithinPartitions("slot", "doc_id", "size").mapInArrow(assign, PLACED)


def _windows(spark: SparkSession, sf_dir: str) -> list:
    """One row for each capacity asked for."""
    return spark.read.parquet(f"{sf_dir}/context_windows.parquet").where("capacity_tokens > 0").orderBy("window_name").collect()


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = None
    for w in _windows(spark, sf_dir):
        one = packed_sizes(rows, w.capacity_tokens).select(F.lit(w.window_name).alias("window_name"), "*")
        out = one if out is None else out.union(one)
    return out if out is not None else spark.createDataFrame([], "window_name string, " + PLACED)


def p8_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per window: containers, tokens, the share of the room that is used and the cut texts."""
    windows = spark.read.parquet(f"{sf_dir}/context_windows.parquet")
    rows = p8_packing(spark, sf_dir)
    containers = rows.groupBy("window_name", "container").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("part_no") > 0).alias("cut"))
    used = containers.groupBy("window_name").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.sum("cut").alias("later_parts"))
    return used.join(windows, "window_name").withColumn("used", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4))


def p8_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per window: texts, tokens and texts over the capacity, and what must not be: overfull containers, texts cut
    without need, texts with gaps or overlaps between their parts."""
    windows = spark.read.parquet(f"{sf_dir}/context_windows.parquet")
    rows = written(p8_packing(spark, sf_dir), "packed")
    full = rows.groupBy("window_name", "container").agg(F.sum("tokens").alias("t")).join(windows, "window_name")
    full = full.groupBy("window_name").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("overfull"))
    texts = rows.groupBy("window_name", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("parts"), F.max(F.col("token_start") + F.col("tokens")).alias("last"), F.min("token_start").alias("first"))
    texts = texts.join(windows, "window_name")
    cut = F.ceil(F.col("t") / F.col("capacity_tokens"))
    per = texts.groupBy("window_name").agg(
        F.count("*").alias("texts"), F.sum("t").alias("tokens"), F.count_if(F.col("t") > F.col("capacity_tokens")).alias("oversized"),
        F.count_if(F.col("parts") > cut).alias("cut_needlessly"), F.count_if((F.col("first") != 0) | (F.col("last") != F.col("t"))).alias("broken"),
    )
    return per.join(full, "window_name")


QUERIES = {"p8_packing": p8_packing, "p8_usage": p8_usage, "p8_audit": p8_audit}
ORACLE = {
    "p8_audit": """
SELECT window_name, count(*) AS texts, sum(strlen(text) + 1)::BIGINT AS tokens, count(*) FILTER (strlen(text) + 1 > capacity_tokens) AS oversized,
  0::BIGINT AS cut_needlessly, 0::BIGINT AS broken, 0::BIGINT AS overfull
FROM documents, context_windows WHERE doc_id IS NOT NULL AND text IS NOT NULL AND capacity_tokens > 0 GROUP BY window_name""",
}
