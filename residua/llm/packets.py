"""Shuffles of packed fixed-width entries, and residue texts as byte arrays.

A shuffle of many tiny rows costs far more in row headers and row handling than
in data. The operators here therefore group a batch's entries by destination
and send one binary value per destination; the receiving task gets its entries
back as one numpy array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def residues(sequence: str | Column) -> Column:
    """Letters A-Z of a sequence in upper case, everything else left out.

    Null gives null; a sequence without letters gives the empty string.
    """
    column = F.col(sequence) if isinstance(sequence, str) else sequence
    return F.upper(F.regexp_replace(column, "[^A-Za-z]+", ""))


def delivered(records: DataFrame, least: int = 1) -> DataFrame:
    """(seq_id, sid, residues) of every delivery with at least ``least`` residues.

    ``sid`` is the 64-bit hash that stands for the residues. Rows with a null
    seq_id or sequence are left out, repeated deliveries stay repeated.
    """
    text = records.select("seq_id", residues("sequence").alias("residues"))
    text = text.where(F.col("seq_id").isNotNull() & (F.length("residues") >= least))
    return text.select("seq_id", F.xxhash64("residues").alias("sid"), "residues")


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit words."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= MIX_1
    h ^= h >> np.uint64(27)
    h *= MIX_2
    h ^= h >> np.uint64(31)
    return h


#: Raw bytes that a receiving task gets, and destinations it works on one after another.
TASK_BYTES, PARTS = 8 << 20, 4


def volume(records: DataFrame) -> tuple[int, int]:
    """Rows of a table of sequences and their characters: bounds on what is made of them."""
    found = records.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("sequence")), F.lit(0)).alias("c")).first()
    return found.n, int(found.c)


class Texts:
    """A batch of ASCII texts as one byte array."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        self.codes = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
        self.starts = bounds - bounds[0]
        self.lengths = np.diff(self.starts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text index, position in the text, 64-bit value) of every window of k bytes."""
        counts = np.maximum(self.lengths - k + 1, 0)
        text = np.repeat(np.arange(len(counts)), counts)
        first = np.cumsum(counts) - counts
        position = np.arange(counts.sum()) - np.repeat(first, counts)
        return text, position, self.rolled(k)[self.starts[text] + position] if len(text) else np.zeros(0, np.uint64)

    def rolled(self, k: int) -> np.ndarray:
        """64-bit value of the k bytes from each place on; exact for k up to 12."""
        n = max(len(self.codes) - k + 1, 0)
        value = np.zeros(n, np.uint64)
        if k <= 12:
            for i in range(k):
                value <<= np.uint64(5)
                value |= self.codes[i : i + n] & np.uint8(31)
        else:
            for i in range(k):
                value *= np.uint64(0x9E3779B97F4A7C15)
                value += self.codes[i : i + n]
                value ^= value >> np.uint64(29)
        return value


def packed(entries: np.ndarray, keys: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Entries grouped by destination ``keys % parts``, byte plane after byte plane, so that constant planes compress."""
    if not len(entries):
        return
    to = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    to = to[order]
    planes = entries[order].view(np.uint8).reshape(len(entries), -1)
    edges = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True])
    yield pa.RecordBatch.from_arrays(
        [pa.array(to[edges[:-1]], pa.int32()), pa.array([planes[a:b].T.tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())],
        ["part", "packet"],
    )


def unpacked(packets: list[bytes], dtype: np.dtype) -> np.ndarray:
    planes = [np.frombuffer(p, np.uint8).reshape(dtype.itemsize, -1).T for p in packets]
    return np.ascontiguousarray(np.concatenate(planes)).view(dtype).ravel()


PACKET = "part int, packet binary"


def exchange(
    df: DataFrame,
    make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]],
    dtype: np.dtype,
    use: Callable[[int, np.ndarray], Iterator[pa.RecordBatch]],
    schema: str,
    entries: int,
) -> DataFrame:
    """Map batches to (entries, keys), shuffle by key, reduce every destination.

    ``use`` gets all entries of a destination as one array of ``dtype``. The
    number of destinations follows ``entries``, a bound on how many there are, so
    that a destination holds about TASK_BYTES / PARTS however much data comes.
    ``make`` combines what one value repeats within a batch: a frequent value then
    weighs as many entries as there are batches.
    """
    tasks = max(1, -(-entries * dtype.itemsize // TASK_BYTES))
    parts = PARTS * tasks

    def sending(batches):
        for some, keys in make(batches):
            yield from packed(some, keys, parts)

    def receiving(batches):
        # rows come sorted by destination
        now, held = None, []
        for batch in batches:
            for part, packet in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != now and held:
                    yield from use(now, unpacked(held, dtype))
                    held = []
                now = part
                held.append(packet.as_buffer().to_pybytes())
        if held:
            yield from use(now, unpacked(held, dtype))

    sent = df.mapInArrow(sending, PACKET)
    return sent.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(receiving, schema)


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1], True])
    return edges[:-1], edges[1:]


class LongFilter:
    """Bloom filter over 64-bit values with at most ``most`` bits (a power of two).

    It only keeps rows out of shuffles; beyond its size it lets more rows through.
    """

    def __init__(self, values: DataFrame, column: str, most: int = 1 << 27):
        size = 1 << 16
        while size < most and size < 16 * values.count():
            size <<= 1
        self.size = size

        def fill(batches):
            bits = np.zeros(size // 8, np.uint8)
            for batch in batches:
                for place in bloom_places(mixed(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)), size):
                    set_bits(bits, place)
            yield from bit_slices(bits)

        self.bits = values.sparkSession.sparkContext.broadcast(merged_bits(values.select(column).mapInArrow(fill, PACKET), size))

    def of(self, df: DataFrame, column: str) -> DataFrame:
        """Rows of ``df`` whose ``column`` may be among the values."""
        size, held, at = self.size, self.bits, df.columns.index(column)

        def keep(batches):
            bits = np.frombuffer(held.value, np.uint8)
            for batch in batches:
                value = mixed(batch.column(at).to_numpy(zero_copy_only=False).view(np.uint64))
                yield batch.filter(pa.array(bloom_has(bits, value, size)))

        return df.mapInArrow(keep, df.schema)


SLICES = 64


def bloom_places(value: np.ndarray, size: int) -> Iterator[np.ndarray]:
    yield value & np.uint64(size - 1)
    yield (value >> np.uint64(32)) * np.uint64(0x9E3779B1) & np.uint64(size - 1)


def set_bits(bits: np.ndarray, place: np.ndarray) -> None:
    np.bitwise_or.at(bits, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))


def bloom_has(bits: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    hit = np.ones(len(value), np.bool_)
    for place in bloom_places(value, size):
        hit &= (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(np.bool_)
    return hit


def bit_slices(whole: np.ndarray) -> Iterator[pa.RecordBatch]:
    step = len(whole) // SLICES
    for i in range(SLICES):
        part = whole[i * step : (i + 1) * step]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["part", "packet"])


def merged_bits(slices: DataFrame, size: int) -> bytes:
    """All tasks' bit slices united; at most ``size`` bits come to the driver."""

    def merge(batches):
        merged: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packet in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(packet.as_buffer(), np.uint8)
                merged[i] = merged[i] | part if i in merged else part.copy()
        for i, part in merged.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["part", "packet"])

    whole = np.zeros(size // 8, np.uint8)
    step = len(whole) // SLICES
    for row in slices.repartition(SLICES // 8, "part").mapInArrow(merge, PACKET).toLocalIterator():
        whole[row.part * step : (row.part + 1) * step] = np.frombuffer(row.packet, np.uint8)
    return whole.tobytes()
