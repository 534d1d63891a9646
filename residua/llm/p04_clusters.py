"""Problem 4: clusters of mutually similar records and their typical members.

Two texts are alike if they share a quarter of the distinct three-residue
windows that either has. Texts linked by seeds of eight residues with like
surroundings (see ``sketches``) form shards, inside which every text can meet every other. A shard
is divided by parallel pivot correlation clustering: texts have a random order,
by their digest; a text before all its undecided neighbours becomes a pivot and
absorbs them; rounds go on until every text is decided. Members then move to
their closest pivot. Clusters with alike members merge into the connected sets
of ``p4_found``.

A cluster's medoid is the member whose cosine similarities with all members sum
up to most. Vectors add up, so that the sum is a product with one profile for
each cluster, and work follows the number of members, not of their pairs.

Shards of up to ``SHARD`` texts are clustered where their texts lie. In larger
ones the first undecided texts of the order give pivots in each round, all texts
of the shard meet the new pivots in blocks, and what is left outside the largest
connected set meets the whole shard: links inside that set are never listed.
Both ways have the same order and give the same clusters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm.forests import FOREST, components, spanning
from residua.llm.packets import Texts, delivered, runs
from residua.llm.sketches import grams, linked_by_seeds
from residua.session import written

WINDOW, SHARE, LEAST = 3, (1, 4), 30
#: Of texts just alike a twentieth to a tenth of the 8-residue windows agree.
SEED, SEEDS = 8, 48
#: Places around a common seed, of 16 in four classes, in which they must agree: of texts just alike about 13 do, of others 4 or 5.
AGREE = 9
#: Texts in a shard that one task clusters.
SHARD = 2_000
#: Texts of a shard that are compared pair by pair; more by the lists of their windows.
DENSE = 64
#: Texts in a block of a larger shard, and about as many that give pivots in a round.
BLOCK, BATCH = 2_000, 2_000
MET = "a long, b long, similarity double"
#: Digest values are below this.
TURNS = 1 << 60
#: Weight of a text of one window in a profile.
UNIT = 1 << 20


def run_pairs(sid: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within runs of distinct sids, vectorised by distance within the run."""
    size = end - begin
    begin, size = begin[size > 1], size[size > 1]
    a, b = [], []
    gap = 1
    while len(begin):
        count = size - gap
        place = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        a.append(sid[place])
        b.append(sid[place + gap])
        gap += 1
        begin, size = begin[size > gap], size[size > gap]
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(a), np.concatenate(b)
    return np.minimum(a, b), np.maximum(a, b)


def all_alike(texts: list[str], share: tuple[int, int], window: int, home: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, similarity) of all pairs x < y of places of alike texts.

    With ``home``, x is one of the first ``home`` texts and y one of the rest.
    The texts of every window are listed and counted, so that no pair is left out.
    """
    up, down = share
    text, _, value = Texts(pa.array(texts, pa.string())).windows(window)
    names, gram = np.unique(value, return_inverse=True)
    held = np.unique(text * len(names) + gram)
    text, gram = held // max(len(names), 1), held % max(len(names), 1)
    size = np.bincount(text, minlength=len(texts))
    first = np.r_[0, np.cumsum(size)]
    lists = np.split(text[np.argsort(gram, kind="stable")], np.cumsum(np.bincount(gram, minlength=len(names)))[:-1])
    a, b, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for x in range(len(texts) if home is None else home):
        own = gram[first[x] : first[x + 1]]
        common = np.zeros(len(texts), np.int64)
        for i in range(0, len(own), 256):
            common += np.bincount(np.concatenate([lists[g] for g in own[i : i + 256]]), minlength=len(texts))
        beyond = x + 1 if home is None else home
        common = common[beyond:]
        either = size[x] + size[beyond:] - common
        y = np.flatnonzero((common > 0) & (common * down >= either * up))
        a.append(np.full(len(y), x))
        b.append(y + beyond)
        s.append(common[y] / either[y])
    return np.concatenate(a), np.concatenate(b), np.concatenate(s)


def window_sets(texts: list[str], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, window value, number of windows of each text) of all distinct windows."""
    text, _, value = Texts(pa.array(texts, pa.string())).windows(window)
    held = np.unique(text.astype(np.uint64) << np.uint64(5 * window) | value)
    text = (held >> np.uint64(5 * window)).astype(np.int64)
    return text, (held & np.uint64((1 << 5 * window) - 1)).astype(np.int64), np.bincount(text, minlength=len(texts))


def units(windows: np.ndarray) -> np.ndarray:
    """What a text adds to its cluster's profile at each of its windows: its weight in a unit vector, as an integer."""
    return np.floor(UNIT / np.sqrt(np.maximum(windows, 1))).astype(np.int64)


def pivots_of(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which of n places become pivots, given both directions of all edges; places stand in the order."""
    undecided, pivot = np.ones(n, bool), np.zeros(n, bool)
    while undecided.any():
        live = undecided[u] & undecided[v]
        first = np.full(n, n)
        np.minimum.at(first, u[live], v[live])
        new = undecided & (np.arange(n) < first)
        pivot |= new
        undecided &= ~new
        undecided[v[new[u]]] = False
    return pivot


CLUSTERED = "sid long, pivot long, root long, total long, windows int"


def _clustered(shard: np.ndarray, sid: np.ndarray, texts: list[str], share: tuple[int, int], window: int, typical: bool) -> Iterator[pa.RecordBatch]:
    """Pivot clustering of whole shards, whose texts stand in the order; texts without an alike one are left out."""
    up, down = share
    begin, end = runs(shard)
    small = end - begin <= DENSE
    a, b = run_pairs(np.arange(len(sid)), begin[small], end[small])
    listed = [(x + start, y + start, s) for start, stop in zip(begin[~small], end[~small]) for x, y, s in [all_alike(texts[start:stop], share, window)]]
    value: dict[int, frozenset] = {}
    edges = []
    for x, y in zip(a.tolist(), b.tolist()):
        if x not in value:
            value[x] = grams(texts[x], window)
        if y not in value:
            value[y] = grams(texts[y], window)
        one, two = value[x], value[y]
        if len(two) * down < up * len(one) or len(one) * down < up * len(two):
            continue
        common = len(one & two)
        either = len(one) + len(two) - common
        if common and common * down >= either * up:
            edges.append((x, y, common / either))
    if edges:
        listed.append(tuple(np.array(c) for c in zip(*edges)))
    if not sum(len(x) for x, _, _ in listed):
        return
    a, b, similarity = (np.concatenate(c) for c in zip(*listed))
    u, v, s = np.r_[a, b], np.r_[b, a], np.r_[similarity, similarity]
    pivot = pivots_of(len(sid), u, v)
    # members move to the closest pivot
    own = np.arange(len(sid))
    side = pivot[v] & ~pivot[u]
    order = np.lexsort((v[side], -s[side], u[side]))
    first = np.unique(u[side][order], return_index=True)
    own[first[0]] = v[side][order][first[1]]
    # clusters with alike members merge
    head = sid.copy()
    node, smallest = spanning(sid[a], sid[b])
    by_sid = np.argsort(sid)
    head[by_sid[np.searchsorted(sid, node, sorter=by_sid)]] = smallest
    some = np.unique(u)
    total, windows = np.zeros(len(sid), np.int64), np.zeros(len(sid), np.int64)
    if typical:
        text, gram, size = window_sets([texts[i] for i in some], window)
        _, place = np.unique(own[some][text] << 5 * window | gram, return_inverse=True)
        profile = np.bincount(place, units(size)[text]).astype(np.int64)
        total[some], windows[some] = np.bincount(text, profile[place], len(some)).astype(np.int64), size
    columns = sid[some], sid[own[some]], head[some], total[some], windows[some].astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sid", "pivot", "root", "total", "windows"])


def _in_shards(share: tuple[int, int], window: int, typical: bool):
    """Rows (shard, sid, residues) sorted by shard and order; whole shards are taken together up to a bound."""

    def work(batches):
        shards, sid, texts, last = [], [], [], None
        for batch in batches:
            for shard, one, text in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != last and len(sid) >= SHARD:
                    yield from _clustered(np.array(shards, np.int64), np.array(sid, np.int64), texts, share, window, typical)
                    shards, sid, texts = [], [], []
                last = shard
                shards.append(shard)
                sid.append(one)
                texts.append(text)
        if sid:
            yield from _clustered(np.array(shards, np.int64), np.array(sid, np.int64), texts, share, window, typical)

    return work


def clustered(records: DataFrame, share: tuple[int, int] = SHARE, window: int = WINDOW, least: int = LEAST, shard: int = SHARD, typical: bool = True, batch: int = BATCH, complete: bool = False) -> DataFrame:
    """(sid, pivot, root, total, windows) of every text that is alike another.

    ``pivot`` names the text's cluster, ``root`` the connected set of clusters.
    ``total`` / sqrt(``windows``) is the sum of the text's cosine similarities to
    the members of its cluster, in units; both are 0 unless ``typical``. Copies
    are one text. Null or short sequences and null ids take no part; extra
    columns are not read; an empty table gives an empty result.

    ``complete`` takes all texts as one shard, so that texts without a common
    seed meet as well; the cost then grows with the square of the collection.
    """
    text = delivered(records, least).select("sid", "residues")
    if complete:
        home = text.select(F.col("sid").alias("node"), F.lit(0).cast("long").alias("root")).distinct()
    else:
        home = components(linked_by_seeds(text, SEED, SEEDS, records, AGREE))
    large = written(home.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") > shard).withColumnRenamed("root", "shard"), "large")
    turn = F.conv(F.substring(F.md5("residues"), 1, 15), 16, 10).cast("long").alias("turn")
    placed = text.join(home.select(F.col("node").alias("sid"), F.col("root").alias("shard")), "sid").select("shard", "sid", "residues")
    small = placed.join(large, "shard", "left_anti").distinct().select("shard", turn, "sid", "residues")
    ordered = small.repartition("shard").sortWithinPartitions("shard", "turn", "sid").select("shard", "sid", "residues")
    out = ordered.mapInArrow(_in_shards(share, window, typical), CLUSTERED)
    if large.take(1):
        slots = F.ceil(F.col("size") / BLOCK).cast("int").alias("slots")
        rest = placed.join(large, "shard").distinct().select("shard", turn, "sid", "residues", slots)
        rest = rest.withColumn("slot", F.pmod(F.xxhash64("sid", F.lit(29)), F.col("slots")).cast("int"))
        out = out.union(_large(written(rest, "texts"), share, window, typical, batch))
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of rows with equal first columns, as lists of the other columns."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != now:
                if held:
                    yield now, [list(c) for c in zip(*held)]
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield now, [list(c) for c in zip(*held)]


def _chosen(share: tuple[int, int], window: int):
    """Rows (shard, turn, sid, residues), sorted, to those of each shard that become pivots."""

    def work(batches):
        for (shard,), (turn, sid, texts) in _groups(batches, 1):
            x, y, _ = all_alike(texts, share, window)
            kept = np.flatnonzero(pivots_of(len(sid), np.r_[x, y], np.r_[y, x]))
            columns = np.full(len(kept), shard), np.array(turn, np.int64)[kept], np.array(sid, np.int64)[kept]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array([texts[i] for i in kept], pa.string())], ["shard", "turn", "sid", "residues"])

    return work


def _met(share: tuple[int, int], window: int):
    """Rows (shard, slot, visits, name, residues), sorted, to (a, b, similarity): names of alike texts at home and visiting."""

    def work(batches):
        for _, (visits, name, texts) in _groups(batches, 2):
            home = len(visits) - sum(visits)
            x, y, similarity = all_alike(texts, share, window, home)
            a, b = (np.array(name, np.int64)[i] for i in (x, y))
            for i in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in (a, b, similarity)], ["a", "b", "similarity"])

    return work


def _bridges(share: tuple[int, int], window: int):
    """As ``_met``, but a spanning forest of the names only."""

    def work(batches):
        for _, (visits, name, texts) in _groups(batches, 3):
            x, y, _ = all_alike(texts, share, window, len(visits) - sum(visits))
            names = np.array(name, np.int64)
            node, root = spanning(names[x], names[y])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])

    return work


def _large(texts: DataFrame, share: tuple[int, int], window: int, typical: bool, batch: int) -> DataFrame:
    """``clustered`` rows of the shards of ``texts`` (shard, turn, sid, residues, slots, slot), however large they are."""
    sizes = texts.groupBy("shard").agg(F.max("slots").alias("slots"))
    undecided, pivots, edges = texts.select("shard", "turn", "sid"), None, None
    while True:
        # the first texts of each shard's order, about ``batch`` of them since digests are even
        left = undecided.groupBy("shard").agg(F.count("*").alias("n"), F.min("turn").alias("low"))
        early = F.col("turn") - F.col("low") <= (F.lit(TURNS) - F.col("low")) * F.least(F.lit(1.0), F.lit(float(batch)) / F.col("n"))
        first = undecided.join(left, "shard").where(early).select("sid")
        asked = texts.join(first, "sid").select("shard", "turn", "sid", "residues")
        new = written(asked.repartition("shard").sortWithinPartitions("shard", "turn", "sid").mapInArrow(_chosen(share, window), "shard long, turn long, sid long, residues string"), "pivots")
        home = new.join(sizes, "shard").select("shard", F.explode(F.expr("sequence(0, slots - 1)")).alias("slot"), F.lit(False).alias("visits"), "sid", "residues")
        rows = home.union(texts.select("shard", "slot", F.lit(True), "sid", "residues")).repartition("shard", "slot").sortWithinPartitions("shard", "slot", "visits", "sid")
        met = written(rows.mapInArrow(_met(share, window), MET).where("a <> b"), "met")
        pivots, edges = (new, met) if pivots is None else (pivots.union(new), edges.union(met))
        undecided = undecided.join(met.select(F.col("b").alias("sid")).union(new.select("sid")).distinct(), "sid", "left_anti").select("shard", "turn", "sid")
        undecided = written(undecided, "undecided")
        if not undecided.take(1):
            break
    order = pivots.select(F.col("sid").alias("a"), (-F.col("turn")).alias("t"))
    best = edges.join(order, "a").groupBy("b").agg(F.max(F.struct("similarity", "t", (-F.col("a")).alias("n"))).alias("m")).select(F.col("b").alias("sid"), (-F.col("m.n")).alias("pivot"))
    cluster = written(best.union(pivots.select("sid", F.col("sid").alias("pivot"))), "clusters")
    # most texts are tied together by pivots; what is not meets the whole shard
    label = components(edges.select("a", "b")).select(F.col("node").alias("sid"), F.col("root").alias("label"))
    named = written(texts.join(label, "sid", "left").withColumn("label", F.coalesce("label", "sid")), "labels")
    top = named.groupBy("shard", "label").count().groupBy("shard").agg(F.max_by("label", F.struct("count", "label")).alias("top"))
    apart = named.join(top, "shard").where("label <> top").drop("top")
    blocks = apart.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    home = apart.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("sid", F.lit(31)), F.col("blocks")).cast("int"))
    home = home.select("shard", "block", F.explode(F.expr("sequence(0, slots - 1)")).alias("slot"), F.lit(False).alias("visits"), F.col("label").alias("name"), "residues")
    guests = named.join(blocks, "shard").select("shard", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "slot", F.lit(True), "label", "residues")
    rows = home.union(guests).repartition("shard", "block", "slot").sortWithinPartitions("shard", "block", "slot", "visits", "name")
    merged = components(rows.mapInArrow(_bridges(share, window), FOREST)).select(F.col("node").alias("label"), "root")
    out = cluster.join(named.select("sid", "label"), "sid").join(merged, "label", "left").select("sid", "pivot", F.coalesce("root", "label").alias("root"))
    # texts that are alike no other are pivots without members
    linked = edges.select(F.col("a").alias("sid")).union(edges.select("b")).union(merged.select("label")).distinct()
    out = out.join(linked, "sid", "left_semi")
    if not typical:
        return out.select("sid", "pivot", "root", F.lit(0).cast("long").alias("total"), F.lit(0).alias("windows"))
    member = written(texts.join(out.select("sid", "pivot"), "sid").select("pivot", "slot", "sid", "residues"), "members")
    return out.join(_totals(member, window), "sid").select("sid", "pivot", "root", "total", "windows")


def _totals(member: DataFrame, window: int) -> DataFrame:
    """(sid, total, windows) of the texts (pivot, slot, sid, residues), by one profile of each cluster."""

    def count(batches):
        for batch in batches:
            pivot, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            names, at = np.unique(pivot, return_inverse=True)
            text, gram, size = window_sets(texts, window)
            key, place = np.unique(at[text] << 5 * window | gram, return_inverse=True)
            value = np.bincount(place, units(size)[text]).astype(np.int64)
            columns = names[key >> 5 * window], key & ((1 << 5 * window) - 1), value
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["pivot", "gram", "value"])

    def total(batches):
        for _, (_, sid, texts, gram, value) in _groups(batches, 2):
            profile = np.zeros(1 << 5 * window, np.int64)
            profile[gram[0]] = value[0]
            text, own, size = window_sets(texts[1:], window)
            sums = np.zeros(len(size), np.int64)
            np.add.at(sums, text, profile[own])
            columns = np.array(sid[1:], np.int64), sums, size.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sid", "total", "windows"])

    # at most 26 ** window entries a profile
    counted = member.select("pivot", "residues").mapInArrow(count, "pivot long, gram long, value long").groupBy("pivot", "gram").agg(F.sum("value").alias("value"))
    profile = counted.groupBy("pivot").agg(F.collect_list(F.struct("gram", "value")).alias("p")).select("pivot", F.col("p.gram").alias("gram"), F.col("p.value").alias("value"))
    held = member.select("pivot", "slot").distinct().join(profile, "pivot")
    none = F.lit(None)
    first = held.select("pivot", "slot", F.lit(0).alias("turn"), none.cast("long").alias("sid"), none.cast("string").alias("residues"), "gram", "value")
    rows = first.union(member.select("pivot", "slot", F.lit(1), "sid", "residues", none.cast("array<long>"), none.cast("array<long>")))
    rows = rows.repartition("pivot", "slot").sortWithinPartitions("pivot", "slot", "turn")
    return rows.mapInArrow(total, "sid long, total long, windows int")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = spark.read.parquet(f"{sf_dir}/provenance_records.parquet")
    members = delivered(records, LEAST).select("seq_id", "sid").distinct()
    label = clustered(records, typical=False).select("sid", "root")
    placed = members.join(label, "sid", "left").select("seq_id", F.coalesce("root", "sid").alias("root"))
    placed = written(placed, "placed")
    first = placed.groupBy("root").agg(F.min("seq_id").alias("first_seq_id"), F.count("*").alias("n")).where("n > 1")
    return placed.join(first, "root").select("seq_id", "first_seq_id")


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivot clusters: size, medoid, up to three typical members, and how far the shipped clustering agrees.

    ``shipped_name`` is the most frequent name (lower case, without blanks around
    it) that cluster_assignments gives to the members, ``shipped_share`` the share
    of the members that have it; both are null where no member has a name. A
    text's copies count in the size; the typical members, joined by ``|``, are one
    record a text.
    """
    records = spark.read.parquet(f"{sf_dir}/provenance_records.parquet")
    shipped = spark.read.parquet(f"{sf_dir}/cluster_assignments.parquet")
    members = delivered(records, LEAST).select("seq_id", "sid").distinct()
    text = members.groupBy("sid").agg(F.min("seq_id").alias("seq_id"), F.count("*").alias("copies"))
    placed = written(text.join(clustered(records), "sid", "left").withColumn("pivot", F.coalesce("pivot", "sid")), "placed")
    ranked = placed.withColumn("sum", F.coalesce(F.col("total") / F.sqrt("windows"), F.lit(0.0)))
    # the three best of each cluster by three partial maxima, so that no cluster is gathered
    best = F.struct(F.col("sum"), F.col("seq_id"))
    size = ranked.groupBy("pivot").agg(F.sum("copies").alias("size"), F.count("*").alias("texts"), F.expr("max_by(seq_id, struct(sum, seq_id))").alias("medoid"), F.max(best).alias("m1"))
    second = ranked.join(size.select("pivot", "m1"), "pivot").where(best < F.col("m1")).groupBy("pivot", "m1").agg(F.max(best).alias("m2"))
    third = ranked.join(second, "pivot").where(best < F.col("m2")).groupBy("pivot").agg(F.max(best).alias("m3"))
    typical = size.join(second.drop("m1"), "pivot", "left").join(third, "pivot", "left")
    name = F.lower(F.trim("assignments"))
    names = shipped.select("seq_id", name.alias("name")).where("name is not null").distinct()
    counted = members.join(placed.select("sid", "pivot"), "sid").join(names, "seq_id").groupBy("pivot", "name").count()
    top = counted.groupBy("pivot").agg(F.max(F.struct("count", "name")).alias("t"))
    return (
        typical.where("size > 1")
        .join(top, "pivot", "left")
        .select(
            "medoid", "size", "texts",
            F.array_join(F.array("m1.seq_id", "m2.seq_id", "m3.seq_id"), "|").alias("typical"),
            F.col("t.name").alias("shipped_name"), F.round(F.col("t.count") / F.col("size"), 4).alias("shipped_share"),
        )
    )


QUERIES = {"p4_found": p4_found, "p4_clusters": p4_clusters}

_ALIKE = r"""
WITH RECURSIVE rec AS (
  SELECT DISTINCT seq_id, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) AS r FROM provenance_records WHERE seq_id IS NOT NULL),
long AS (SELECT * FROM rec WHERE length(r) >= 30),
txt AS (SELECT r, min(seq_id) AS rep FROM long GROUP BY r),
gram AS (SELECT DISTINCT rep, substr(r, i::BIGINT, 3) AS g FROM txt, unnest(generate_series(1, length(r) - 2)) AS u(i)),
size AS (SELECT rep, count(*) AS n FROM gram GROUP BY rep),
hit AS (SELECT a.rep AS x, b.rep AS y, count(*) AS c FROM gram a JOIN gram b ON a.g = b.g AND a.rep <> b.rep GROUP BY 1, 2),
near AS MATERIALIZED (SELECT x, y, c::DOUBLE / (m.n + n.n - c) AS s FROM hit JOIN size m ON m.rep = x JOIN size n ON n.rep = y WHERE 4 * c >= m.n + n.n - c),
reach(rep, other) AS (SELECT rep, rep FROM txt UNION SELECT r.rep, n.y FROM reach r JOIN near n ON n.x = r.other),
label AS MATERIALIZED (SELECT rep, min(other) AS root FROM reach GROUP BY rep),
"""
ORACLE = {
    "p4_found": _ALIKE
    + """placed AS (SELECT l.seq_id, b.root FROM long l JOIN txt t ON t.r = l.r JOIN label b ON b.rep = t.rep)
SELECT seq_id, first_seq_id FROM (
  SELECT seq_id, min(seq_id) OVER (PARTITION BY root) AS first_seq_id, count(*) OVER (PARTITION BY root) AS n FROM placed) WHERE n > 1""",
    # pivots by going through each connected set in the order of the digests
    "p4_clusters": _ALIKE
    + """ord AS MATERIALIZED (SELECT rep, CAST('0x' || substr(md5(r), 1, 15) AS BIGINT) AS turn FROM txt),
pos AS MATERIALIZED (SELECT rep, root, row_number() OVER (PARTITION BY root ORDER BY turn, rep) AS k FROM label JOIN ord USING (rep) WHERE rep IN (SELECT x FROM near)),
nb AS MATERIALIZED (SELECT x AS rep, list(y) AS nbs FROM near GROUP BY x),
walk(root, k, piv) AS (SELECT DISTINCT root, 0::BIGINT, []::VARCHAR[] FROM pos UNION ALL
  SELECT w.root, p.k, CASE WHEN list_has_any(nb.nbs, w.piv) THEN w.piv ELSE list_append(w.piv, p.rep) END FROM walk w JOIN pos p ON p.root = w.root AND p.k = w.k + 1 JOIN nb ON nb.rep = p.rep),
piv AS MATERIALIZED (SELECT unnest(p) AS rep FROM (SELECT arg_max(piv, k) AS p FROM walk GROUP BY root)),
best AS (SELECT x AS rep, arg_min(y, row(-s, turn)) AS hub FROM near JOIN piv ON piv.rep = y JOIN ord ON ord.rep = y WHERE x NOT IN (SELECT rep FROM piv) GROUP BY x),
own AS MATERIALIZED (SELECT t.rep, coalesce(b.hub, t.rep) AS hub FROM txt t LEFT JOIN best b USING (rep)),
prof AS (SELECT hub, g, sum(floor(1048576 / sqrt(n))::BIGINT) AS c FROM gram JOIN size USING (rep) JOIN own USING (rep) GROUP BY 1, 2),
score AS (SELECT g.rep, sum(c)::DOUBLE / sqrt(any_value(z.n)) AS s FROM gram g JOIN own USING (rep) JOIN prof USING (hub, g) JOIN size z ON z.rep = g.rep GROUP BY g.rep),
mem AS (SELECT o.hub, o.rep, count(*) AS copies, any_value(CASE WHEN n.x IS NULL THEN 0 ELSE s END) AS s FROM long l JOIN txt t ON t.r = l.r JOIN own o ON o.rep = t.rep JOIN score c ON c.rep = t.rep
  LEFT JOIN (SELECT DISTINCT x FROM near) n ON n.x = t.rep GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY hub ORDER BY s DESC, rep DESC) AS k FROM mem),
cl AS (SELECT hub, sum(copies)::BIGINT AS size, count(*) AS texts, max(rep) FILTER (k = 1) AS medoid, string_agg(rep, '|' ORDER BY k) FILTER (k <= 3) AS typical FROM rk GROUP BY hub HAVING sum(copies) > 1),
nm AS (SELECT DISTINCT seq_id, lower(trim(assignments)) AS name FROM cluster_assignments WHERE assignments IS NOT NULL),
ct AS (SELECT o.hub, nm.name, count(*) AS c FROM long l JOIN txt t ON t.r = l.r JOIN own o ON o.rep = t.rep JOIN nm ON nm.seq_id = l.seq_id GROUP BY 1, 2),
top AS (SELECT hub, max(row(c, name)) AS t FROM ct GROUP BY hub)
SELECT medoid, size, texts, typical, t[2] AS shipped_name, round(t[1] / size, 4) AS shipped_share FROM cl LEFT JOIN top USING (hub)""",
}
