"""Joins of sequences by similarity, and alignments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.functions.scales import RESIDUES, rounded
from residua.session import written


def distinct_texts(df: DataFrame) -> DataFrame:
    """(rep, sequence): one id, the smallest, for every text."""
    return df.groupBy("sequence").agg(F.min("id").alias("rep"))


def window_codes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of the distinct windows of k characters of each text, equal windows with equal codes.

    Codes are made longer by one character at a time, and numbered anew where they grow large, so that they are exact
    for every k; the last numbers go by frequency, and the windows of a text come with the most frequent ones first.
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    held = np.unique(points) if len(points) == 0 or points.max() > 1 << 21 else np.flatnonzero(np.bincount(points) > 0)
    place = np.zeros(int(held.max(initial=0)) + 1, np.int32)
    place[held] = np.arange(len(held))
    single, letters = place[points], max(len(held), 1)
    code, names = single, letters
    for i in range(1, k):
        head = code[: max(len(points) - i, 0)]
        if names * letters < 1 << 22:
            code, names = head * np.int32(letters) + single[i:], names * letters
        else:
            known, code = np.unique(head.astype(np.int64) * letters + single[i:], return_inverse=True)
            code, names = code.astype(np.int32), max(len(known), 1)
    starts = np.cumsum(lengths) - lengths
    counts = np.maximum(lengths - k + 1, 0)
    # a million windows at a time
    cuts = np.searchsorted(np.cumsum(counts), np.arange(0, counts.sum(), 1 << 20), side="left").tolist()
    cuts = [*dict.fromkeys([0, *cuts]), len(texts)]
    often, parts = np.zeros(names, np.int64), []
    for lo, hi in zip(cuts, cuts[1:]):
        n = counts[lo:hi]
        parts.append(code[np.arange(n.sum(), dtype=np.int64) + np.repeat(starts[lo:hi] - np.cumsum(n) + n, n)])
        often += np.bincount(parts[-1], minlength=names)
    rank = np.empty(names, np.int32)
    rank[np.argsort(-often, kind="stable")] = np.arange(names)
    out = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    width = int(names - 1).bit_length()
    for (lo, hi), found in zip(zip(cuts, cuts[1:]), parts):
        kind = np.int32 if (hi - lo) << width < 1 << 31 else np.int64
        one = np.repeat(np.arange(hi - lo, dtype=kind) << kind(width), counts[lo:hi])
        one += rank[found]
        one.sort()
        if len(one):
            one = one[np.r_[True, one[1:] != one[:-1]]]
        out[0].append((one >> kind(width)).astype(np.int32) + np.int32(lo))
        out[1].append((one & kind((1 << width) - 1)).astype(np.int32))
    return np.concatenate(out[0]), np.concatenate(out[1])


def summed(bits: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Binary digits, the lowest first, of the sums of the named rows of bits, column by column; ``rows`` is (rows, sums)."""
    shape = (rows.shape[1], bits.shape[1])
    spare, waiting = [], []

    def add(digit: np.ndarray, level: int) -> None:
        while True:
            if level == len(waiting):
                waiting.append([])
            waiting[level].append(digit)
            if len(waiting[level]) < 3:
                return
            a, b, c = waiting[level]
            digit = spare.pop() if spare else np.empty(shape, bits.dtype)
            np.bitwise_and(a, b, out=digit)
            np.bitwise_xor(a, b, out=a)
            np.bitwise_and(a, c, out=b)
            np.bitwise_or(digit, b, out=digit)
            np.bitwise_xor(a, c, out=a)
            spare.extend((b, c))
            waiting[level] = [a]
            level += 1

    for row in rows:
        add(np.take(bits, row, axis=0, out=spare.pop() if spare else np.empty(shape, bits.dtype), mode="clip"), 0)
    level = 0
    while level < len(waiting):
        if len(waiting[level]) == 2:
            a, b = waiting[level]
            waiting[level] = [a ^ b]
            add(a & b, level + 1)
        level += 1
    return [d for d, in waiting]


def matched_windows(texts: list[str], k: int, share: tuple[int, int], home: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, common, either) of all pairs of places of texts that share enough windows, x < y.

    With ``home``, x is one of the first ``home`` texts and y one of the rest. Every window has a row of bits, one for
    each text; a text adds up the rows of its windows, 64 texts at once. Where so many common windows are needed that
    chance does not bring them about, up to 16 texts are one at first, which has the windows of all: only where it
    has enough are they told apart. In the same way, of the most frequent windows of a text as many are left out at
    first as even together do not decide: a pair that has enough of the others is counted whole.
    """
    up, down = share
    text, code = window_codes(texts, k)
    size = np.bincount(text, minlength=len(texts))
    first = np.r_[0, np.cumsum(size)]
    out = [[np.zeros(0, np.int64)] for _ in range(4)]
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    xs, ys = (order, order) if home is None else (order[order < home], order[order >= home])
    if not len(xs) or not len(ys):
        return tuple(np.concatenate(c) for c in out)
    names = int(code.max()) + 1
    wide = max(1024, min(32_768, (1 << 28) // names // 1024 * 1024))
    if home is None:
        # half of what a stretch of texts has to do with itself is done twice
        wide = min(wide, max(4096, len(ys) // 6))
    end = 0
    for near in np.array_split(ys, -(-len(ys) // wide)):
        n, end = size[near], end + len(near)
        w = -(-len(near) // 1024) * 16
        # a row of bits for each window, one for each text of these; the last row is empty
        bits = np.zeros((names + 1, w), np.uint64)
        own = np.repeat(np.arange(len(near)), n)
        entries = code[np.arange(len(own)) + np.repeat(first[near] - np.cumsum(n) + n, n)].astype(np.int64)
        np.bitwise_or.at(bits.reshape(-1), entries * w + (own >> 6), np.uint64(1) << (own & 63).astype(np.uint64))
        del own, entries
        # the same for 2, 4, 8, 16 texts together, and how many of them have a window
        folds = [bits]
        while len(folds) < 5:
            half = folds[-1].shape[1] // 2
            folds.append(folds[-1][:, :half] | folds[-1][:, half:])
        chance = [np.bitwise_count(f).sum(1, dtype=np.int64) / min(64 * f.shape[1], len(near)) for f in folds]
        met = xs if home is not None else xs[:end]
        met = met[(size[met] * down >= n[0] * up) & (size[met] * up <= n[-1] * down)]

        # the last place at which what is left of the windows needed is still beyond chance, or -1
        def spares(held: np.ndarray, inside: np.ndarray, need: np.ndarray, fold: int) -> np.ndarray:
            place = np.arange(len(held))[:, None]
            rest = np.cumsum(np.where(inside, chance[fold][held], 0)[::-1], axis=0)[::-1]
            spared = (need - place >= rest + 4 * np.sqrt(rest) + 2) & inside
            return np.where(spared.any(0), len(place) - 1 - np.argmax(spared[::-1], axis=0), -1)

        # the windows of texts in columns, and how many a pair needs at least: up / (up + down) of both sizes together
        def windows(some: np.ndarray) -> tuple[np.ndarray, ...]:
            m = size[some]
            place = np.arange(int(m.max()))[:, None]
            inside = place < m
            held = np.where(inside, code[np.minimum(first[some] + place, len(code) - 1)], names)
            least = np.maximum(n[0], m if home is None else -(-m * up // down))
            return m, place, inside, held, -(-(m + least) * up // (up + down))

        at = 0
        while at < len(met):
            m, _, inside, held, need = windows(met[at : at + 1])
            fold = max(range(5), key=lambda f: (s := int(spares(held, inside, need, f)[0])) >= 0 and 2.0**f / (m[0] - s) or 0.0)
            some = met[at : at + max(1, 16_384 // folds[fold].shape[1])]
            some = some[: max(1, (1 << 20) // int(size[some[-1]]))]
            at += len(some)
            m, place, inside, held, need = windows(some)
            skip = np.maximum(spares(held, inside, need, fold), 0)
            counted = m - skip
            take = place[: int(counted.max())]
            used = np.where(take < counted, held[np.minimum(take + skip, len(place) - 1), np.arange(len(some))], names)
            planes = summed(folds[fold], used)
            least = np.maximum(need - skip, 1)
            # 1 where the number is not below the least
            enough = np.full(planes[0].shape, ~np.uint64(0))
            for i, plane in enumerate(planes):
                zero = np.where(least >> i & 1, np.uint64(0), ~np.uint64(0))[:, None]
                enough = (plane & enough) | (zero & (plane | enough))
            enough[least >= 1 << len(planes)] = 0
            i, word = np.nonzero(enough)
            hit, bit = np.nonzero(enough[i, word][:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1))
            i, word, bit = i[hit], word[hit], bit.astype(np.uint64)
            common = sum(((plane[i, word] >> bit & np.uint64(1)).astype(np.int64) << p for p, plane in enumerate(planes)), np.zeros(len(i), np.int64))
            # texts that were one are told apart by halves
            for f in range(fold - 1, -1, -1):
                i, word, bit = np.tile(i, 2), np.r_[word, word + folds[f + 1].shape[1]], np.tile(bit, 2)
                octets = folds[f].astype("<u8", copy=False).view(np.uint8).reshape(-1)
                at_octet, mask = word * 8 + (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8)
                rows = used.astype(np.int64) * (8 * folds[f].shape[1])
                common = np.concatenate([np.count_nonzero(octets.take(rows[:, i[c : c + 2048]] + at_octet[c : c + 2048]) & mask[c : c + 2048], axis=0) for c in range(0, max(1, len(i)), 2048)])
                good = common >= least[i]
                i, word, bit, common = i[good], word[good], bit[good], common[good]
            y = word * 64 + bit.astype(np.int64)
            both = m[i] + n[y]
            good = (common + skip[i]) * (up + down) >= both * up
            i, word, bit, y, common, both = i[good], word[good], bit[good], y[good], common[good], both[good]
            for p in range(int(skip[i].max(initial=0))):
                more = np.flatnonzero(skip[i] > p)
                common[more] += (bits[held[p, i[more]], word[more]] >> bit[more] & np.uint64(1)).astype(np.int64)
            good = common * (up + down) >= both * up
            one, two = some[i], near[y]
            if home is None:
                # both orders are met where the sizes are equal or the texts lie in one stretch
                good &= (size[one] < size[two]) | ((size[one] == size[two]) & (one < two))
            one, two, common, both = one[good], two[good], common[good], both[good]
            for column, values in zip(out, (np.minimum(one, two), np.maximum(one, two), common, both - common)):
                column.append(values)
    return tuple(np.concatenate(c) for c in out)


def jaccard_pairs(df: DataFrame, k: int = 3, share: tuple[int, int] = (7, 20), block: int = 60_000, texts: bool = False) -> DataFrame:
    """(a, b, common, either) of different texts that share enough of their windows, a < b by representative; with ``texts`` also s_a, s_b.

    Of short windows nearly all texts have some in common, so that there are no
    candidates to save: texts are ordered by their number of windows and cut into
    blocks of as many windows, ``block`` texts on average, every block meets every
    other whose numbers allow it, and a task counts the common windows of two
    blocks. Work grows with the square of the number of texts.
    Texts without a window match nothing; null texts and ids are left out.
    """
    up, down = share
    named = distinct_texts(df.where("sequence is not null and id is not null"))

    def sized(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            text, _ = window_codes(frame.sequence.tolist(), k)
            yield frame.assign(size=np.bincount(text, minlength=len(frame)))

    named = written(named.mapInPandas(sized, "sequence string, rep string, size long").where("size > 0"), "texts")
    sizes = named.groupBy("size").agg(F.count("*").alias("n")).orderBy("size").collect()
    number, total = sum(r.n for r in sizes), sum(r.n * r.size for r in sizes)
    blocks = max(1, -(-number // block), min(6, number // 500))
    # texts of one size lie side by side in the order of a hash, so that a size may go through several blocks
    before, places, reach = 0, [], [[1 << 60, 0, 0.0] for _ in range(blocks)]
    for r in sizes:
        span = r.n * r.size
        places.append((r.size, before, span))
        for b in range(before * blocks // total, min(blocks - 1, (before + span) * blocks // total) + 1):
            part = min(before + span, (b + 1) * total / blocks) - max(before, b * total / blocks)
            reach[b] = [min(reach[b][0], r.size), max(reach[b][1], r.size), reach[b][2] + part / r.size]
        before += span
    spark = df.sparkSession
    pairs = [(i, j) for i in range(blocks) for j in range(i, blocks) if reach[j][0] * up <= reach[i][1] * down]
    # a partition for each pair of blocks, which are not put together, the longest work first
    pairs.sort(key=lambda p: -reach[p[0]][2] * reach[p[1]][2] * (reach[p[0]][0] + reach[p[0]][1]) ** 1.5 / (1 + (p[0] == p[1])))
    parts = max(1, min(10_000, len(pairs)))
    slot = {r.part: r.id for r in spark.range(12 * parts).selectExpr("id", f"CAST(pmod(hash(id), {parts}) AS INT) AS part").collect()} if 1 < len(pairs) <= 1_000 else {}
    meet = [(own, slot.get(at, at + 12 * parts), own != i) for at, (i, j) in enumerate(pairs) for own in sorted({i, j})]
    meet = spark.createDataFrame(meet, "own int, slot long, visits boolean")
    alone = {slot.get(at, at + 12 * parts) for at, (i, j) in enumerate(pairs) if i == j}
    placed = named.join(spark.createDataFrame(places, "size long, before long, span long"), "size")
    own = F.expr(f"least({blocks - 1}, CAST(floor((before + span * (pmod(xxhash64(rep, 13), 1048576) / 1048576D)) * {blocks} / {max(total, 1)}) AS INT))").alias("own")

    # a part of a block travels as one compressed value to each block that it meets
    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for place, part in frame.groupby("own"):
                table = pa.Table.from_pandas(part[["rep", "sequence"]].sort_values("rep"), preserve_index=False)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(table)
                rows.append((place, sink.getvalue().to_pybytes()))
            yield pd.DataFrame(rows, columns=["own", "texts"])

    sent = placed.select("rep", "sequence", own).mapInPandas(whole, "own int, texts binary").join(F.broadcast(meet), "own")
    columns = ["a", "b", "common", "either", *(["s_a", "s_b"] if texts else [])]

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("visits")
        within, guests = key[0] in alone, int(frame.visits.sum())
        if not within and guests in (0, len(frame)):
            return pd.DataFrame({c: [] for c in columns})
        held = [pa.ipc.open_stream(t).read_all() for t in frame.texts]
        known, ids = (np.concatenate([t[c].to_numpy() for t in held]) for c in ("sequence", "rep"))
        x, y, common, either = matched_windows(known.tolist(), k, share, None if within else sum(len(t) for t in held[: len(held) - guests]))
        swap = ids[x] > ids[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        return pd.DataFrame({"a": ids[x], "b": ids[y], "common": common, "either": either, "s_a": known[x], "s_b": known[y]})[columns]

    sent = sent.select("slot", "visits", "texts").repartition(parts, "slot")
    return sent.groupBy("slot").applyInPandas(compare, "a string, b string, common int, either int" + ", s_a string, s_b string" * texts)


def positional_identity(a: str, b: str, over: str = "greatest") -> Column:
    """Equal places of two sequences over the longer (or ``least``: shorter) length."""
    same = f"aggregate(sequence(1, least(length({a}), length({b}))), 0, (_sum, _at) -> _sum + CASE WHEN substr({a}, _at, 1) = substr({b}, _at, 1) THEN 1 ELSE 0 END)"
    return F.expr(f"CASE WHEN length({a}) > 0 AND length({b}) > 0 THEN CAST({same} AS DOUBLE) / {over}(length({a}), length({b})) ELSE 0D END")


def identity_variants(a: str, b: str) -> list[Column]:
    """Three ways to share places: for duplicates (lengths within a tenth), for negatives (within two fifths), over the shorter one."""
    gap = F.abs(F.length(a) - F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
    full = positional_identity(a, b)
    return [
        F.when(gap > 0.10, 0.0).otherwise(full).alias("as_duplicate"), F.when(gap > 0.40, 0.0).otherwise(full).alias("as_negative"),
        positional_identity(a, b, "least").alias("over_shorter"),
    ]


def first_retained(pairs: DataFrame) -> DataFrame:
    """(removed, kept) when rows are met in the order of their ids and one near an earlier retained one goes.

    ``pairs`` has two id columns. A round retains all rows without an earlier
    undecided partner, and removes their partners; rounds follow the longest
    chain of partners, not the number of rows. Null ids link nothing.
    """
    a, b = pairs.columns[:2]
    edges = pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = written(edges, "near")
    open_, gone = edges, None
    while True:
        first = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        removed = written(open_.join(first, "a").select("b").distinct(), "removed")
        if not removed.take(1):
            break
        gone = removed if gone is None else gone.union(removed)
        rest = open_.join(removed, "b", "left_anti").join(removed.withColumnRenamed("b", "a"), "a", "left_anti").select("a", "b")
        open_ = written(rest, "undecided")
    if gone is None:
        return edges.select(F.col("b").alias("removed"), F.col("a").alias("kept")).limit(0)
    kept = edges.join(gone.withColumnRenamed("b", "a"), "a", "left_anti").join(gone, "b", "left_semi")
    return kept.groupBy(F.col("b").alias("removed")).agg(F.min("a").alias("kept"))


def positional_pairs(df: DataFrame, identity: float = 0.98) -> DataFrame:
    """(a, b, identity) of different texts with equal residues in at least a share of the places.

    Texts are cut into blocks of half the length at which one difference is
    allowed, so that two such texts agree in about half of their blocks, at the
    same places. Of n blocks of which m agree, one is among the n - m + 1 rarest
    of either text; only these are joined, and a block that very many texts begin
    with is left to the texts that have little else. Shorter texts can only be equal.
    """
    block = max(1, int(0.5 / (1 - identity) + 1e-9))
    text = distinct_texts(df.where("sequence is not null")).withColumn("len", F.length("sequence"))
    blocks = text.where(F.col("len") >= block).select("rep", "len", F.explode(F.expr(f"transform(sequence(0, len DIV {block} - 1), i -> named_struct('i', i, 'h', xxhash64(substr(sequence, i * {block} + 1, {block}))))")).alias("k"))
    blocks = blocks.join(blocks.groupBy("k").agg(F.count("*").alias("texts")), "k").where("texts > 1")
    # agreeing blocks with the shortest partner allowed, and the most differences with the longest
    agree = F.floor(F.col("len") * identity / block + 1e-9) - F.floor(F.col("len") * (1 - identity) / identity + 1e-9)
    every = F.floor(F.col("len") / block)
    # blocks of one text alone come first in the order and use up places
    own = every - F.count("*").over(Window.partitionBy("rep"))
    rare = F.row_number().over(Window.partitionBy("rep").orderBy("texts", "k")) <= every - F.greatest(agree, F.lit(1)) + 1 - own
    blocks = blocks.withColumn("rare", rare).where("rare").select("k", "rep", "len")
    left, right = (blocks.select("k", F.col("rep").alias(c), F.col("len").alias(f"l_{c}")) for c in "ab")
    fits = F.least("l_a", "l_b") >= F.greatest("l_a", "l_b") * identity
    near = left.join(right, "k").where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()
    one, two = (text.select(F.col("rep").alias(c), F.col("sequence").alias(f"s_{c}")) for c in "ab")
    scored = near.join(one, "a").join(two, "b").select("a", "b", positional_identity("s_a", "s_b").alias("v"))
    return scored.where(F.col("v") >= identity).select("a", "b", F.expr(rounded("v", 4)).alias("identity"))


def same_family(a: str, b: str, common: str, either: str, threshold: float = 0.35) -> Column:
    """The homology rule on a pair: lengths, window similarity, edit distance.

    ``common`` and ``either`` are the counts of shared and all windows of three.
    """
    ratio = f"CAST(least(length({a}), length({b})) AS DOUBLE) / greatest(length({a}), length({b}))"
    longest = f"greatest(length({a}), length({b}))"
    j = f"CAST({common} AS DOUBLE) / {either}"
    edit = f"CAST(levenshtein({a}, {b}) AS DOUBLE) / {longest}"
    return F.expr(
        f"CASE WHEN {longest} > 30 AND {ratio} < 0.4 THEN false WHEN {longest} < 30 THEN {edit} <= 1 - {threshold} OR {j} >= 0.30"
        f" ELSE {j} >= {threshold} OR ({j} >= 0.20 AND {longest} <= 120 AND 1 - {edit} >= {threshold}) END"
    )


def edit_distances(text: str, others: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Edit distances of a text of 1 to 64 characters to others, given as rows of code points in the order of their lengths.

    Columns of the distance table are words of vertical differences (Myers, Hyyrö), for all others at once.
    """
    word = np.uint32 if len(text) <= 32 else np.uint64
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, place = np.unique(points, return_inverse=True)
    held = np.zeros(len(letters) + 1, word)
    np.bitwise_or.at(held, place, word(1) << np.arange(len(points), dtype=word))
    at = np.minimum(np.searchsorted(letters, others), len(letters) - 1)
    at[letters[at] != others] = len(letters)
    one, top = word(1), word(len(points) - 1)
    more, less = np.full(len(others), ~word(0)), np.zeros(len(others), word)
    distance = np.full(len(others), len(points), np.int64)
    for j in range(others.shape[1]):
        # those that end before this place keep their distance
        i = int(np.searchsorted(lengths, j, side="right"))
        equal, up, down = held[at[i:, j]], more[i:], less[i:]
        free = (((equal & up) + up) ^ up) | equal | down
        right, left = down | ~(free | up), up & free
        distance[i:] += (right >> top & one).astype(np.int64) - (left >> top & one).astype(np.int64)
        right, left = right << one | one, left << one
        more[i:], less[i:] = left | ~(free | right), right & free
    return distance


def edit_pairs(text: DataFrame, below: int = 30, most: float = 0.65, block: int = 4_000) -> DataFrame:
    """(a, b) of all texts (rep, sequence) under ``below`` residues with an edit distance of at most a share of the longer length.

    Every block of texts meets every other; lengths alone rule pairs out. ``below`` is at most 65.
    """
    if below > 65:
        raise ValueError("texts of more than 64 characters do not fit a word")
    short = written(text.where((F.length("sequence") < below) & (F.length("sequence") > 0)).select("rep", "sequence"), "short")
    number = short.count()
    blocks = max(1, -(-number // block), min(6, number // 200))
    own = short.withColumn("own", F.pmod(F.xxhash64("rep"), F.lit(blocks)))
    sent = own.withColumn("other", F.explode(F.expr(f"sequence(0, {blocks - 1})"))).select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("visits"), "rep", "sequence")

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        within = key[0] == key[1]
        home, other = (frame, frame) if within else (frame[~frame.visits], frame[frame.visits])
        other = other.assign(n=other.sequence.str.len()).sort_values("n")
        lengths, ids = other.n.to_numpy(), other.rep.to_numpy()
        points = np.zeros((len(other), int(lengths.max(initial=0))), np.uint32)
        for row, t in zip(points, other.sequence):
            row[: len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        one, two = [np.zeros(0, object)], [np.zeros(0, object)]
        for rep, t in zip(home.rep, home.sequence):
            fits = np.abs(lengths - len(t)) / np.maximum(lengths, len(t)) <= most
            # the lengths that fit lie side by side
            i, j = (int(np.argmax(fits)), len(fits) - int(np.argmax(fits[::-1]))) if fits.any() else (0, 0)
            near = edit_distances(t, points[i:j, : int(lengths[j - 1])], lengths[i:j]) / np.maximum(lengths[i:j], len(t)) <= most if j else np.zeros(0, bool)
            found = ids[i:j][near]
            found = found[found > rep] if within else found
            one.append(np.full(len(found), rep, object))
            two.append(found)
        x, y = np.concatenate(one), np.concatenate(two)
        swap = x > y
        return pd.DataFrame({"a": np.where(swap, y, x), "b": np.where(swap, x, y)})

    sent = sent.repartition(min(10_000, blocks * (blocks + 1) // 2), "i", "j")
    return sent.groupBy("i", "j").applyInPandas(compare, "a string, b string")


def families(df: DataFrame) -> DataFrame:
    """(a, b) of all different texts that the homology rule puts together, a < b by representative.

    The rule needs a fifth of the windows in common, save for two texts under 30
    residues, of which the edit distance alone may decide.
    """
    text = distinct_texts(df.where("sequence is not null"))
    windows = jaccard_pairs(df, 3, (1, 5), texts=True).where(same_family("s_a", "s_b", "common", "either"))
    return windows.select("a", "b").union(edit_pairs(text)).distinct()


def short_matches(queries: DataFrame, reference: DataFrame, k: int = 6) -> DataFrame:
    """(id, kmer, position, reference_id): the first window of a query that a reference holds.

    Among references the smallest id counts. A reference never matches a query
    with its id or its group (``grp``, null for none; an id has one group).
    Windows are joined. Of the references that hold a window, the smallest and
    the smallest of another group answer every query, so that a window that very
    many references hold is two rows.
    """
    window = lambda d: d.where(f"length(sequence) >= {k}").select("*", F.posexplode(F.expr(f"transform(sequence(1, length(sequence) - {k - 1}), i -> substr(sequence, i, {k}))")).alias("position", "kmer"))
    of = F.coalesce(F.concat(F.lit("g:"), "grp"), F.concat(F.lit("i:"), "id"))
    held = window(reference.select("id", "sequence", "grp")).groupBy("kmer", of.alias("of")).agg(F.min(F.struct(F.col("id").alias("reference_id"), F.col("grp").alias("ref_grp"))).alias("r"))
    first = held.groupBy("kmer").agg(F.min(F.struct("r", "of")).alias("m"))
    second = held.join(first, "kmer").where(F.col("of") != F.col("m.of")).groupBy("kmer").agg(F.min("r").alias("r"))
    known = first.select("kmer", "m.r.*").union(second.select("kmer", "r.*"))
    hits = window(queries).join(known, "kmer").where((F.col("id") != F.col("reference_id")) & ~F.coalesce(F.col("grp") == F.col("ref_grp"), F.lit(False)))
    return hits.groupBy("id").agg(F.min(F.struct("position", "reference_id", "kmer")).alias("m")).select("id", "m.kmer", (F.col("m.position") + 1).alias("position"), "m.reference_id")


def _encode(sequence: str) -> np.ndarray:
    table = np.full(256, 20, np.int8)
    table[[ord(c) for c in RESIDUES]] = np.arange(20)
    return table[np.frombuffer(sequence.encode("ascii", "replace"), np.uint8)]


def global_identity(a: str, b: str, opening: float = 0.5, extension: float = 0.1) -> float:
    """Best sum of matches less gap costs of a global alignment, over the longer length.

    A match scores 1, a mismatch 0, a gap of n places costs opening and n - 1
    extensions. Rows of the alignment are computed as vectors.
    """
    if not a or not b:
        return 1.0 if a == b else 0.0
    x, y = _encode(a), _encode(b)
    n = len(y)
    step = np.arange(n + 1) * extension
    best = np.r_[0.0, -(opening + np.arange(n) * extension)]
    down = np.full(n + 1, -np.inf)
    for i, c in enumerate(x):
        down = np.maximum(down - extension, best - opening)
        diagonal = np.r_[-np.inf, best[:-1] + (y == c)]
        here = np.maximum(diagonal, down)
        here[0] = -(opening + i * extension)
        # gaps along the row: the best opening to the left, carried on by the running maximum
        opened = np.maximum.accumulate(here - opening + extension + step)
        best = np.maximum(here, np.r_[-np.inf, opened[:-1] - step[1:]])
    return max(0.0, float(best[-1]) / max(len(a), len(b)))


def global_identities(pairs: list[tuple[str, str]], opening: float = 0.5, extension: float = 0.1, cells: int = 16_000) -> np.ndarray:
    """``global_identity`` of many pairs, rows of about ``cells`` places of pairs of like lengths side by side."""
    out = np.array([float(a == b) for a, b in pairs])
    whole = [i for i, (a, b) in enumerate(pairs) if a and b]
    whole.sort(key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    at = 0
    while at < len(whole):
        n = len(pairs[whole[at]][1])
        some = whole[at : at + max(1, cells // (n + 1))]
        at += len(some)
        xs, ys = [_encode(pairs[i][0]) for i in some], [_encode(pairs[i][1]) for i in some]
        lengths, widths = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
        n = int(widths.max())
        # filled up with what equals nothing, to the right of and below all that counts
        x, y = np.full((len(some), int(lengths.max())), -1, np.int8), np.full((len(some), n), -2, np.int8)
        for k, (one, two) in enumerate(zip(xs, ys)):
            x[k, : len(one)], y[k, : len(two)] = one, two
        step = np.arange(n + 1) * extension
        best = np.tile(np.r_[0.0, -(opening + np.arange(n) * extension)], (len(some), 1))
        down = np.full(best.shape, -np.inf)
        here, opened = np.empty_like(best), np.empty_like(best)
        for i in range(x.shape[1]):
            down -= extension
            np.subtract(best, opening, out=here)
            np.maximum(down, here, out=down)
            np.add(best[:, :-1], y == x[:, i : i + 1], out=here[:, 1:])
            np.maximum(here[:, 1:], down[:, 1:], out=here[:, 1:])
            here[:, 0] = -(opening + i * extension)
            np.subtract(here, opening, out=opened)
            opened += extension
            opened += step
            np.maximum.accumulate(opened, axis=1, out=opened)
            best[:, 0] = here[:, 0]
            np.subtract(opened[:, :-1], step[1:], out=best[:, 1:])
            np.maximum(here[:, 1:], best[:, 1:], out=best[:, 1:])
            for k in np.flatnonzero(lengths == i + 1):
                out[some[k]] = max(0.0, float(best[k, widths[k]]) / max(lengths[k], widths[k]))
    return out


def local_alignment(a: str, b: str, matrix: np.ndarray, opening: int = 10, extension: int = 2) -> str:
    """Columns of the best local alignment: ``|`` equal, ``.`` different, ``-`` gap.

    ``matrix`` scores the residues in their order, others in the last row.
    """
    x, y = _encode(a), _encode(b)
    m, n = len(x), len(y)
    score, up, left = (np.zeros((m + 1, n + 1)) for _ in range(3))
    up[:], left[:] = -np.inf, -np.inf
    step = np.arange(n + 1) * float(extension)
    for i in range(1, m + 1):
        up[i] = np.maximum(up[i - 1] - extension, score[i - 1] - opening)
        here = np.maximum(np.r_[0.0, score[i - 1, :-1] + matrix[x[i - 1]][y]], np.maximum(up[i], 0))
        opened = np.maximum.accumulate(here - opening + extension + step)
        left[i, 1:] = opened[:-1] - step[1:]
        score[i] = np.maximum(here, left[i])
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    columns: list[str] = []
    while i > 0 and j > 0 and score[i, j] > 0:
        if score[i, j] == score[i - 1, j - 1] + matrix[x[i - 1]][y[j - 1]]:
            columns.append("|" if a[i - 1] == b[j - 1] else ".")
            i, j = i - 1, j - 1
        elif score[i, j] == up[i, j]:
            length = next(k for k in range(1, i + 1) if score[i, j] == score[i - k, j] - opening - (k - 1) * extension)
            columns += "-" * length
            i -= length
        else:
            length = next(k for k in range(1, j + 1) if score[i, j] == score[i, j - k] - opening - (k - 1) * extension)
            columns += "-" * length
            j -= length
    return "".join(reversed(columns))


def window_identities(columns: str, window: int = 80) -> int:
    """Most equal columns in a window of an alignment; 0 where it is shorter than the window."""
    if len(columns) < window:
        return 0
    equal = np.cumsum(np.r_[0, np.frombuffer(columns.encode(), np.uint8) == ord("|")])
    return int((equal[window:] - equal[:-window]).max())


def ungapped_identity(query: str, reference: str, window: int = 80, stride: int = 1) -> float:
    """Largest identity of a query window and a reference window, every diagonal at once.

    A query under the window length slides as a whole; a reference that is
    shorter than the window is compared from its start over its own length.
    """
    w = min(window, len(query))
    if not w or not reference:
        return 0.0
    q, r = _encode(query), _encode(reference)
    if len(r) < w:
        views = np.lib.stride_tricks.sliding_window_view(q, w)[:, : len(r)]
        return float((views == r).mean(1).max())
    equal = q[:, None] == r[None, :]
    best = 0
    for shift in range(-(len(q) - w), len(r) - w + 1):
        diagonal = np.cumsum(np.r_[0, equal.diagonal(shift)])
        sums = diagonal[w:] - diagonal[:-w]
        if stride > 1:
            first = max(shift, 0)
            sums = sums[(-first) % stride :: stride]
        if len(sums):
            best = max(best, int(sums.max()))
    return best / w


def scored_pairs(pairs: DataFrame, score: str = "global") -> DataFrame:
    """Adds ``score`` to pairs with columns s_a and s_b, for whole Arrow batches."""
    many = {"global": global_identities, "ungapped": lambda pairs: [ungapped_identity(a, b) for a, b in pairs]}[score]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield frame.assign(score=[round(float(v), 4) for v in many(list(zip(frame.s_a, frame.s_b)))])

    return pairs.mapInPandas(work, pairs.select("*", F.lit(0.0).alias("score")).schema)


def length_matched(positives: DataFrame, candidates: DataFrame, tolerance: float = 0.15, identity: float = 0.30, width: int = 10) -> DataFrame:
    """(id, negative_id): each positive with a candidate of close length, no candidate twice.

    Lengths may differ by ``tolerance`` of the longer one. Within every band of
    ``width`` lengths the positives are taken in the order of their ids, each
    with the nearest free candidate of its band that is not too similar place by
    place; bands are worked on side by side. What is left goes on to bands moved
    by half and of twice the width, until one band holds all lengths: only
    positives without an admissible free candidate stay out.
    """
    left, right = positives.select("id", "sequence"), candidates.select("id", "sequence")
    lengths = left.select(F.length("sequence").alias("n")).union(right.select(F.length("sequence"))).agg(F.max("n")).first()[0] or 0

    def match(key, pos: pd.DataFrame, neg: pd.DataFrame) -> pd.DataFrame:
        pos, neg = pos.sort_values("id"), neg.sort_values("id").reset_index(drop=True)
        lengths = neg.sequence.str.len().to_numpy()
        free = np.ones(len(neg), bool)
        out = []
        for p in pos.itertuples(index=False):
            gap = np.abs(lengths - len(p.sequence))
            able = np.flatnonzero(free & (gap <= tolerance * np.maximum(lengths, len(p.sequence))))
            for i in able[np.argsort(gap[able], kind="stable")]:
                other = neg.sequence[i]
                same = sum(x == y for x, y in zip(p.sequence, other)) / max(len(p.sequence), len(other), 1)
                if same < identity:
                    free[i] = False
                    out.append((p.id, neg.id[i]))
                    break
        return pd.DataFrame(out, columns=["id", "negative_id"])

    found, offset = None, 0
    while True:
        band = F.floor((F.length("sequence") + offset) / width).alias("band")
        met = left.select("*", band).groupBy("band").cogroup(right.select("*", band).groupBy("band")).applyInPandas(match, "id string, negative_id string")
        met = written(met, "matched")
        found = met if found is None else found.union(met)
        if not offset and width > lengths:
            return found
        left = written(left.join(met, "id", "left_anti"), "unmatched")
        right = written(right.join(met.select(F.col("negative_id").alias("id")), "id", "left_anti"), "free")
        offset, width = (width // 2, width) if not offset else (0, 2 * width)
