"""Problem 2: long exact spans that records share.

Every text is cut into non-overlapping reference blocks of 13 residues. Any
stretch of 25 residues holds a whole block of the other text in which it also
occurs, so every rolling window of 13 residues is probed against the blocks. A
window and a block that agree are an anchor, which is extended by comparing the
twelve residues to either side; stretches of 25 that agree are joined into
maximal spans. A Bloom filter of at most ``FILTER_BITS`` keeps windows that
meet no block out of the shuffle; where a collection outgrows it, it lets more
windows through and changes no result. Anchors are compared by sorting, so that
a block that very many texts hold costs no more per text than a rare one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm.packets import PACKET, Texts, bit_slices, bloom_has, bloom_places, delivered, exchange, merged_bits, mixed, runs, set_bits, volume
from residua.llm.sketches import keys_of, new_texts
from residua.session import written

#: Residues of a shared stretch and of a block; 2 * BLOCK - 1 <= STRETCH.
STRETCH, BLOCK = 25, 13
FLANK = STRETCH - BLOCK
#: Most bits of the block filter (64 MB), bits for each record to aim at, and the
#: fewest before another pass is made.
FILTER_BITS, RECORD_BITS, LEAST_BITS = 1 << 29, 128, 64

ANCHOR = np.dtype([("key", "V6"), ("sid", "<i8"), ("at", "<u4"), ("left", "<u8"), ("right", "<u8")])
SPAN = np.dtype([("sid", "<i8"), ("first", "<u4"), ("last", "<u4")])
SPANS = "sid long, span_start int, span_end int"


def block_values(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, 64-bit value) of all windows of BLOCK residues."""
    text, at, value = texts.windows(BLOCK)
    return text, at, mixed(value)


def of_class(value: np.ndarray, number: int, passes: int) -> np.ndarray:
    return (value >> np.uint64(17)) % np.uint64(passes) == number


def block_filter(text: DataFrame, size: int, number: int = 0, passes: int = 1) -> bytes:
    """Bloom filter of all blocks of a pass; ``size`` is a power of two."""

    def fill(batches):
        bits = np.zeros(size // 8, np.uint8)
        for _, texts in new_texts(batches):
            _, at, value = block_values(texts)
            for place in bloom_places(value[(at % BLOCK == 0) & of_class(value, number, passes)], size):
                set_bits(bits, place)
        yield from bit_slices(bits)

    return merged_bits(text.mapInArrow(fill, PACKET), size)


def _flanks(texts: Texts, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """FLANK residues before and after each window as 60-bit values; places outside the text are 0."""
    edge = np.zeros(FLANK, np.uint8)
    codes = np.r_[edge, texts.codes & np.uint8(31), edge]
    place = texts.starts[text] + at + FLANK
    room_left, room_right = at, texts.lengths[text] - at - BLOCK
    left, right = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for i in range(FLANK):
        # left: the nearest residue in the lowest bits; right: in the highest
        left |= np.where(room_left > i, codes[place - 1 - i], 0).astype(np.uint64) << np.uint64(5 * i)
        right |= np.where(room_right > i, codes[place + BLOCK + i], 0).astype(np.uint64) << np.uint64(5 * (FLANK - 1 - i))
    return left, right


#: Key of entries that are spans already: first and last place stand in the flanks.
SETTLED = b"\xff" * 6


def _settled(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries to send, settled spans as entries) of a batch.

    Of anchors that agree with both flanks, in different texts, all stretches are
    shared; one of them is sent for the other batches.
    """
    order = np.lexsort((entries["sid"], entries["right"], entries["left"], keys_of(entries)))
    entries = entries[order]
    same = (entries["left"][1:] == entries["left"][:-1]) & (entries["right"][1:] == entries["right"][:-1]) & (keys_of(entries)[1:] == keys_of(entries)[:-1])
    begin = np.flatnonzero(np.r_[True, ~same])
    size = np.diff(np.r_[begin, len(entries)])
    several = np.repeat(entries["sid"][begin] != entries["sid"][begin + size - 1], size)
    if not several.any():
        return entries, entries[:0]
    spans = entries[several]
    room = [sum((spans[side] >> np.uint64(5 * i) & np.uint64(31)) > 0 for i in range(FLANK)) for side in ("left", "right")]
    first = spans["at"] - room[0]
    last = spans["at"] + BLOCK - 1 + room[1]
    spans["left"], spans["right"], spans["key"] = first, last, np.void(SETTLED)
    keep = ~several
    keep[begin] = True
    return entries[keep], spans[last - first + 1 >= STRETCH]


def _anchors(bits: object, size: int, number: int, passes: int):
    def make(batches):
        held = np.frombuffer(bits.value, np.uint8)
        for sid, texts in new_texts(batches):
            text, at, value = block_values(texts)
            hit = bloom_has(held, value, size) & of_class(value, number, passes)
            text, at, value = text[hit], at[hit], value[hit]
            left, right = _flanks(texts, text, at)
            entries = np.empty(len(value), ANCHOR)
            key = mixed(value)
            entries["key"] = (key >> np.uint64(8)).view(np.uint8).reshape(-1, 8)[:, :6].copy().view("V6").ravel()
            entries["sid"], entries["at"], entries["left"], entries["right"] = sid[text], at, left, right
            entries, spans = _settled(entries) if len(entries) else (entries, entries)
            yield np.r_[entries, spans], np.r_[mixed(keys_of(entries)), mixed(np.ascontiguousarray(spans["sid"]).view(np.uint64))]

    return make


def _stretches(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sid, start) of every stretch of 25 around an anchor that another text has too."""
    key, sid, at = keys_of(entries), entries["sid"], entries["at"].astype(np.int64)
    order = np.argsort(key, kind="stable")
    begin, end = runs(key[order])
    low, high = np.minimum.reduceat(sid[order], begin), np.maximum.reduceat(sid[order], begin)
    order = order[np.repeat(low != high, end - begin)]
    key, sid, at, left, right = mixed(key[order]), sid[order], at[order], entries["left"][order], entries["right"][order]
    found_sid, found_at = [], []
    for before in range(FLANK + 1):
        after = FLANK - before
        low_bits = left & np.uint64((1 << 5 * before) - 1)
        high_bits = right >> np.uint64(5 * (FLANK - after))
        inside = np.ones(len(key), np.bool_)
        if before:
            inside &= (left >> np.uint64(5 * (before - 1)) & np.uint64(31)) > 0
        if after:
            inside &= (right >> np.uint64(5 * (FLANK - after)) & np.uint64(31)) > 0
        # before + after = 12, hence 60 bits for both flanks together
        both = (low_bits << np.uint64(5 * after) | high_bits)[inside]
        name = mixed(both ^ key[inside])
        one, place = sid[inside], at[inside] - before
        order = np.argsort(name, kind="stable")
        begin, end = runs(name[order])
        if not len(begin):
            continue
        low, high = np.minimum.reduceat(one[order], begin), np.maximum.reduceat(one[order], begin)
        order = order[np.repeat(low != high, end - begin)]
        found_sid.append(one[order])
        found_at.append(place[order])
    if not found_sid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_sid), np.concatenate(found_at)


def _joined(sid: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals of each sid, intervals that touch joined; first and last inclusive."""
    order = np.lexsort((first, sid))
    sid, first, last = sid[order], first[order].astype(np.int64), last[order].astype(np.int64)
    if not len(sid):
        return sid, first, last
    # running maximum of last within each sid, with sids kept apart by an offset
    change = np.r_[True, sid[1:] != sid[:-1]]
    base = np.cumsum(change) * (np.int64(1) << 33)
    reach = np.maximum.accumulate(last + base)
    new = np.r_[True, (first + base)[1:] > reach[:-1] + 1]
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(sid)]
    return sid[begin], first[begin], reach[end - 1] - base[end - 1]


def _shared(part: int, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
    known = entries["key"] == np.void(SETTLED)
    spans, entries = entries[known], entries[~known]
    sid, start = _stretches(entries)
    sid, first, last = _joined(sid, start, start)  # runs of consecutive stretch starts
    one, low, high = _joined(np.ascontiguousarray(spans["sid"]), spans["left"], spans["right"])
    sid, first, last = np.r_[sid, one], np.r_[first, low], np.r_[last, high - STRETCH + 1]
    for i in range(0, len(sid), 50_000):
        rows = slice(i, i + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(sid[rows]), pa.array((first[rows] + 1).astype(np.int32)), pa.array((last[rows] + STRETCH).astype(np.int32))], ["sid", "span_start", "span_end"])


def _send_spans(batches):
    for batch in batches:
        entries = np.empty(batch.num_rows, SPAN)
        for name, column in zip(SPAN.names, batch.columns):
            entries[name] = column.to_numpy(zero_copy_only=False)
        yield entries, mixed(np.ascontiguousarray(entries["sid"]).view(np.uint64))


def _join_spans(part: int, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
    sid, first, last = _joined(np.ascontiguousarray(entries["sid"]), entries["first"], entries["last"])
    yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["sid", "span_start", "span_end"])


def text_spans(records: DataFrame, most_bits: int = FILTER_BITS) -> DataFrame:
    """(sid, span_start, span_end) of the spans that different texts share.

    Places count from 1, both ends belong to the span. Texts under 25 residues,
    null ids and null sequences take no part; copies of a text are one text here.
    """
    spark = records.sparkSession
    text = delivered(records, STRETCH).select("sid", "residues")
    size, (rows, residues) = 1 << 16, volume(records)
    while size < most_bits and size < RECORD_BITS * rows:
        size <<= 1
    passes = max(1, -(-LEAST_BITS * rows // most_bits))
    # every block is an anchor of its own text, and some windows of others are
    anchors = residues // BLOCK * 5 // 4
    found = None
    for number in range(passes):
        bits = spark.sparkContext.broadcast(block_filter(text, size, number, passes))
        one = exchange(text, _anchors(bits, size, number, passes), ANCHOR, _shared, SPANS, anchors // passes)
        if passes > 1:
            one = written(one, "spans")
            bits.destroy()
        found = one if found is None else found.union(one)
    return exchange(found, _send_spans, SPAN, _join_spans, SPANS, anchors)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = spark.read.parquet(f"{sf_dir}/provenance_records.parquet")
    return record_spans(records)


def record_spans(records: DataFrame) -> DataFrame:
    """(seq_id, span_start, span_end): a text that several records have is shared as a whole."""
    rows = delivered(records, STRETCH).select("seq_id", "sid", F.length("residues").alias("n")).distinct()
    copied = rows.groupBy("sid").agg(F.count("*").alias("records"))
    members = rows.join(copied, "sid")
    alone = members.where("records = 1").join(text_spans(records), "sid").select("seq_id", "span_start", "span_end")
    return alone.union(members.where("records > 1").select("seq_id", F.lit(1).alias("span_start"), F.col("n").alias("span_end")))


def p2_shared_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every record: its residues, how many of them are found elsewhere, and their share."""
    records = spark.read.parquet(f"{sf_dir}/provenance_records.parquet")
    rows = delivered(records).select("seq_id", F.length("residues").alias("residues")).distinct()
    spans = record_spans(records).groupBy("seq_id").agg(F.sum(F.expr("span_end - span_start + 1")).alias("shared"), F.count("*").alias("spans"))
    joined = rows.join(spans, "seq_id", "left").select("seq_id", "residues", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("spans", F.lit(0)).alias("spans"))
    return joined.withColumn("share", F.round(F.col("shared") / F.col("residues"), 6))


QUERIES = {"p2_found": p2_found, "p2_shared_share": p2_shared_share}

_SPANS = r"""
WITH rec AS (
  SELECT DISTINCT seq_id, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) AS r FROM provenance_records
  WHERE seq_id IS NOT NULL AND sequence IS NOT NULL),
win AS (SELECT seq_id, i, substr(r, i::BIGINT, 25) AS w FROM rec, unnest(generate_series(1, length(r) - 24)) AS u(i) WHERE length(r) >= 25),
twice AS (SELECT w FROM win GROUP BY w HAVING min(seq_id) <> max(seq_id)),
hit AS (SELECT seq_id, i FROM win WHERE w IN (SELECT w FROM twice)),
step AS (SELECT seq_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY seq_id ORDER BY i) <= 25 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT seq_id, i, sum(new) OVER (PARTITION BY seq_id ORDER BY i) AS k FROM step),
span AS (SELECT seq_id, min(i)::INT AS span_start, (max(i) + 24)::INT AS span_end FROM run GROUP BY seq_id, k)
"""
ORACLE = {
    "p2_found": _SPANS + "SELECT seq_id, span_start, span_end FROM span",
    "p2_shared_share": _SPANS
    + """SELECT r.seq_id, length(r.r)::INT AS residues, coalesce(s.shared, 0)::BIGINT AS shared, coalesce(s.spans, 0)::BIGINT AS spans,
round(coalesce(s.shared, 0) / length(r.r), 6) AS share
FROM rec r LEFT JOIN (SELECT seq_id, sum(span_end - span_start + 1) AS shared, count(*) AS spans FROM span GROUP BY seq_id) s
ON s.seq_id = r.seq_id WHERE length(r.r) > 0""",
}
