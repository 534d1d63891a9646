"""Seeds by which similar residue texts find each other.

All windows of ``k`` residues have one random order, and the seeds of a text are
its first ``n`` distinct windows in that order. A window that two texts share
and that comes early is a seed of both: of texts of equal size with a share s of
their windows in common, about n * s seeds agree, and the pair is missed with a
probability below (1 - s) ** n; short texts give all their windows. Seeds do not
depend on the collection: a text keeps its seeds however large it grows.

Among millions of texts a window of eight residues is shared by chance. A seed
therefore goes with the residues around it, two bits each: similar texts go on
alike beside a common window, unrelated ones agree in about a quarter of the
places, and only texts that agree in enough of them are linked. Without that,
chance links would tie most texts of a large collection together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame

from residua.llm.forests import FOREST, spanning
from residua.llm.packets import Texts, exchange, mixed, runs, volume

#: The destination holds a part of a key too, so that three bytes of it do inside.
ENTRY = np.dtype([("key", "V3"), ("flank", "<u4"), ("sid", "<i8")])
#: Residues on either side of a seed that go with it, and what stands for a letter: four classes about as frequent.
FLANK = 8
CLASS = np.zeros(32, np.uint16)
for _i, _letters in enumerate(("LAKWBX", "GVENJZ", "SIRTCO", "DPQFYMHU")):
    CLASS[[ord(c) & 31 for c in _letters]] = _i
#: Different surroundings of one seed that are compared pair by pair; more of them are linked as they are.
COMPARED = 2_000


def flanks(texts: Texts, text: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The residues around the k at each place of the texts, those before in the upper half; 0 beyond an end."""
    kind = np.zeros(len(texts.codes) + 2 * FLANK, np.uint16)
    kind[FLANK : FLANK + len(texts.codes)] = CLASS[texts.codes & np.uint8(31)]
    run = np.zeros(len(texts.codes) + FLANK + 1, np.uint16)
    for i in range(FLANK):
        run = run << np.uint16(2) | kind[i : i + len(run)]
    one, bits = np.uint32(1), np.uint32(2 * FLANK)
    start = texts.starts[text]
    before = 2 * np.minimum(place - start, FLANK).astype(np.uint32)
    after = 2 * np.minimum(start + texts.lengths[text] - place - k, FLANK).astype(np.uint32)
    left = run[place] & ((one << before) - one)
    right = run[place + k + FLANK].astype(np.uint32) >> (bits - after) << (bits - after)
    return left << bits | right


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places around their seeds two texts agree."""
    other = a ^ b
    return 2 * FLANK - np.bitwise_count((other | other >> np.uint32(1)) & np.uint32(0x55555555))


def seeds(texts: Texts, k: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, key, flank) of all seeds, by text; a text under k residues has none."""
    text, position, value = texts.windows(k)
    value = mixed(value)
    counts = np.maximum(texts.lengths - k + 1, 0)
    # few windows beyond the n-th of a text lie below this bound; a text with too few below it keeps all
    share = np.minimum(1.0, (n + 5 * n**0.5) / np.maximum(counts, 1))
    bound = np.where(share < 1, (share * 2.0**64).astype(np.float64), 0).astype(np.uint64) - np.uint64(1)
    # text and value in one word, so that one sort does
    bits = np.uint64(max(1, len(counts)).bit_length())

    def ordered(kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(kept)
        word = text[at].astype(np.uint64) << (np.uint64(64) - bits) | value[at] >> bits
        order = np.argsort(word)
        word, at = word[order], at[order]
        if len(word):
            # of a repeated window the first place
            new = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            word, at = word[new], np.minimum.reduceat(at, new)
        return (word >> (np.uint64(64) - bits)).astype(np.int64), word, at

    low = value <= bound[text]
    owner, word, at = ordered(low)
    # repeated windows or chance may leave a text too few below its bound
    few = (np.bincount(owner, minlength=len(counts)) < n) & (share < 1)
    if few.any():
        owner, word, at = ordered(low | few[text])
    rank = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(counts)))[owner]
    early = rank < n
    owner, at = owner[early], at[early]
    return owner, mixed(word[early] << bits >> np.uint64(16)), flanks(texts, owner, texts.starts[owner] + position[at], k)


def new_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Texts]]:
    """(sid, texts) of each batch of (sid, residues), copies left out as far as the task has met them."""
    met: set[int] = set()
    for batch in batches:
        sid = batch.column(0).to_numpy(zero_copy_only=False)
        _, first = np.unique(sid, return_index=True)
        first = np.array([i for i in np.sort(first) if sid[i] not in met], np.int64)
        if not len(first):
            continue
        if len(met) > 1_000_000:
            met.clear()
        met.update(sid[first].tolist())
        yield sid[first], Texts(batch.column(1).take(pa.array(first)))


def keyed(key: np.ndarray, flank: np.ndarray, sid: np.ndarray) -> np.ndarray:
    entries = np.empty(len(key), ENTRY)
    entries["key"] = (key >> np.uint64(40)).view(np.uint8).reshape(-1, 8)[:, :3].copy().view("V3").ravel()
    entries["flank"] = flank
    entries["sid"] = sid
    return entries


def keys_of(entries: np.ndarray) -> np.ndarray:
    """The keys of entries as words; a key may have up to eight bytes."""
    wide = np.zeros((len(entries), 8), np.uint8)
    bytes_ = entries.dtype["key"].itemsize
    wide[:, :bytes_] = np.ascontiguousarray(entries["key"]).view(np.uint8).reshape(-1, bytes_)
    return wide.view(np.uint64).ravel()


def combined(keys: np.ndarray, flank: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, flank, sid) that link the same texts with one entry for each key and flank.

    Texts of a batch that share a seed and what is around it are linked at once,
    by a key of their own for each link of their spanning forest; one of them
    then stands for all, so that a stretch which very many texts have weighs one
    entry for each batch.
    """
    whole = mixed(keys ^ mixed(flank.astype(np.uint64)))
    order = np.argsort(whole, kind="stable")
    begin, end = runs(whole[order])
    several = end - begin > 1
    if not several.any():
        return keys, flank, sid
    first = np.repeat(order[begin], end - begin)
    linked = sid[order] != sid[first]
    node, root = spanning(sid[order][linked], sid[first][linked])
    link = mixed(node.view(np.uint64) ^ mixed(root.view(np.uint64)))
    kept, none = order[begin], np.zeros(len(node), np.uint32)
    return np.r_[keys[kept], link, link], np.r_[flank[kept], none, none], np.r_[sid[kept], node, root]


def seeding(k: int, n: int):
    """Batches of (sid, residues) to seed entries."""

    def make(batches):
        for sid, texts in new_texts(batches):
            text, keys, flank = seeds(texts, k, n)
            keys, flank, owner = combined(keys, flank, sid[text])
            # keys in order, so that their upper bytes compress
            order = np.argsort(keys)
            yield keyed(keys[order], flank[order], owner[order]), keys[order]

    return make


def linked_by_seeds(text: DataFrame, k: int, n: int, records: DataFrame, agree: int = 0) -> DataFrame:
    """(node, root) forests of the texts (sid, residues) of ``records`` that share one of their ``n`` seeds.

    They must agree in ``agree`` of the 2 * FLANK places around it.
    """
    rows, residues = volume(records)
    return exchange(text, seeding(k, n), ENTRY, shared_seeds(agree), FOREST, min(n * rows, residues))


def grams(text: str, k: int) -> frozenset[str]:
    """Distinct windows of k residues."""
    return frozenset(text[i : i + k] for i in range(len(text) - k + 1))


def shared_seeds(agree: int):
    """Spanning forest of the texts that share seeds within one destination."""

    def use(part: int, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
        sid, flank = entries["sid"], entries["flank"]
        word = keys_of(entries) << np.uint64(32) | flank
        order = np.lexsort((sid, word))
        word, sid, flank = word[order], sid[order], flank[order]
        begin, end = runs(word)
        a, b = [sid], [np.repeat(sid[begin], end - begin)]
        # one text for each seed and surroundings; those of a seed meet
        head, near = sid[begin], flank[begin]
        begin, end = runs(word[begin] >> np.uint64(32))
        many = end - begin > (COMPARED if agree > 0 else 1)
        for i, j in zip(begin[many], end[many]):
            a.append(head[i:j])
            b.append(np.full(j - i, head[i]))
        begin, size = begin[~many], (end - begin)[~many]
        gap = 1
        while True:
            begin, size = begin[size > gap], size[size > gap]
            if not len(begin):
                break
            count = size - gap
            place = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
            place = place[agreeing(near[place], near[place + gap]) >= agree]
            a.append(head[place])
            b.append(head[place + gap])
            gap += 1
        one, two = np.concatenate(a), np.concatenate(b)
        node, root = spanning(one[one != two], two[one != two])
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])

    return use
