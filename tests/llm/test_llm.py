"""The training-data operators against plain versions, and on awkward input."""

import itertools
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from residua.llm import p01_near_duplicates as p1
from residua.llm import p02_exact_spans as p2
from residua.llm import p03_groups as p3
from residua.llm import p04_clusters as p4
from residua.llm import p05_splits as p5
from residua.llm import p06_overlap as p6
from residua.llm import p07_layout as p7
from residua.llm import p08_packing as p8
from residua.llm import p09_leaks as p9
from residua.llm import p10_lookalikes as p10
from residua.llm.forests import components, spanning
from residua.llm.packets import Texts, delivered
from residua.llm.sketches import CLASS, ENTRY, FLANK, agreeing, flanks, keys_of, linked_by_seeds

LETTERS = "ACDEFGHIKLMNPQRSTVWY"
RECORD = "seq_id string, sequence string, a long, sid long, residues string, shard int"


def random_text(rng, n):
    return "".join(rng.choice(LETTERS) for _ in range(n))


def mutated(rng, text, rate):
    out = []
    for c in text:
        x = rng.random()
        if x < rate / 3:
            continue
        out.append(rng.choice(LETTERS) if x < rate else c)
        if x > 1 - rate / 3:
            out.append(rng.choice(LETTERS))
    return "".join(out)


def family_rows(seed=3, families=12, size=6, extra=()):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(families):
        base = random_text(rng, rng.randint(28, 220))
        for k in range(size):
            text = mutated(rng, base, 0.02 * k)
            rows.append((f"Q{n:05d}", text))
            n += 1
            if k == 1:
                rows.append((f"Q{n:05d}", text.lower()[:10] + " \n" + text[10:]))
                n += 1
    rows += [(f"X{i}", t) for i, t in enumerate(["", None, "acd", "A" * 40, "A" * 41, " - ", "éè", "AC" * 3000])]
    rows += rows[:5] + [(None, random_text(rng, 50))] + list(extra)
    return [(i, s, 1, 2, "zz", 3) for i, s in rows]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(family_rows(), RECORD).repartition(5)


def clean(rows):
    out = {}
    for i, s, *_ in rows:
        if i is not None and s is not None:
            out[i] = "".join(c for c in s.upper() if "A" <= c <= "Z" and c.isascii())
    return out


def windows(s, k):
    return {s[i : i + k] for i in range(len(s) - k + 1)}


def near(texts, k, up, down):
    long = sorted((i, windows(s, k)) for i, s in texts.items() if len(s) >= 30)
    return {(a, b) for (a, x), (b, y) in itertools.combinations(long, 2) if len(x & y) * down >= up * len(x | y)}


def seq_pairs(df):
    return {(r[0], r[1]) for r in df.collect()}


def test_near_pairs_with_members(spark, records):
    pairs = p1.near_pairs(records).select("a", "b")
    members = p1.delivered(records, 30).select("seq_id", "sid").distinct()
    copies = members.groupBy("sid").count().where("count > 1").selectExpr("sid as a", "sid as b")
    got = seq_pairs(p1.expanded(pairs.union(copies), members).where("seq_id_a < seq_id_b").distinct())
    assert got == near(clean(family_rows()), 5, 3, 5)


def test_near_pairs_in_blocks(records):
    whole = {tuple(r) for r in p1.near_pairs(records).collect()}
    assert {tuple(r) for r in p1.near_pairs(records, shard=2).collect()} == whole
    assert whole


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ACDE", min_size=5, max_size=25), min_size=1, max_size=30), st.text("ACDE", min_size=5, max_size=25))
def test_tree_finds_all(texts, query):
    tree = p1.BKTree()
    values = [frozenset(windows(t, 5)) for t in texts]
    for i, v in enumerate(values):
        tree.add(i, v)
    q = frozenset(windows(query, 5))
    assert {k for k, *_ in tree.within(q, (3, 5))} == {i for i, v in enumerate(values) if len(q & v) * 5 >= 3 * len(q | v)}


def shared_runs(texts):
    where = {}
    for i, s in texts.items():
        for p in range(len(s) - 24):
            where.setdefault(s[p : p + 25], set()).add(i)
    out = set()
    for i, s in texts.items():
        marked = [False] * len(s)
        for p in range(len(s) - 24):
            if len(where[s[p : p + 25]]) > 1:
                marked[p : p + 25] = [True] * 25
        p = 0
        while p < len(s):
            if marked[p]:
                e = p
                while e + 1 < len(s) and marked[e + 1]:
                    e += 1
                out.add((i, p + 1, e + 1))
                p = e
            p += 1
    return out


def span_rows():
    rng = random.Random(8)
    piece = [random_text(rng, n) for n in (25, 26, 40, 24, 90)]
    extra = [(f"S{i}", random_text(rng, rng.randint(0, 60)) + piece[i % 5] + random_text(rng, rng.randint(0, 60)) + piece[(i * 3 + 1) % 5]) for i in range(25)]
    return family_rows(extra=extra)


def test_spans(spark):
    df = spark.createDataFrame(span_rows(), RECORD)
    got = {tuple(r) for r in p2.record_spans(df).collect()}
    assert got == shared_runs(clean(span_rows()))


def test_span_filter_only_saves_work(spark):
    df = spark.createDataFrame(span_rows(), RECORD)
    assert {tuple(r) for r in p2.text_spans(df, 1 << 16).collect()} == {tuple(r) for r in p2.text_spans(df).collect()}


def plain_groups(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), max_size=60))
def test_spanning_forest(pairs):
    pairs = [(a, b) for a, b in pairs if a != b]
    a, b = (np.array(c, np.int64) for c in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
    node, root = spanning(a, b)
    want = plain_groups(pairs)
    assert dict(zip(node.tolist(), root.tolist())) == {k: v for k, v in want.items() if k != v}


@pytest.mark.parametrize("one_task", [4_000_000, 1])
def test_components_small_and_star_rounds(spark, one_task):
    rng = random.Random(5)
    pairs = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "x long, y long").repartition(6), one_task=one_task).collect()}
    assert got == plain_groups([p for p in pairs if None not in p and p[0] != p[1]])


def test_groups_by_name(spark):
    rows = [("q1 ", "\tQ2", 0), ("Q2", "r9", 0), ("R9", "q2", 0), ("Q7", "q7 ", 0), (None, "Q1", 0), ("Q8", None, 0), ("a", "B", 0), ("a", "B", 0)]
    df = spark.createDataFrame(rows, "removed_id string, retained_duplicate_id string, node int")
    got = {tuple(r) for r in p3.grouped(df, "removed_id", "retained_duplicate_id").collect()}
    assert got == {("Q1", "Q1"), ("Q2", "Q1"), ("R9", "Q1"), ("A", "A"), ("B", "A")}


def common_rows(count=60):
    """Texts that share one stretch of 50 residues, some of them nothing else, and texts that share none."""
    rng = random.Random(41)
    block = random_text(rng, 50)
    rows = [(f"B{k:03d}", random_text(rng, k % 7 * 5) + block + random_text(rng, k % 5 * 8)) for k in range(count)]
    rows += [(f"N{k:03d}", random_text(rng, 60)) for k in range(9)]
    return [(i, s, 1, 2, "zz", 3) for i, s in rows]


def test_spans_in_passes_are_the_same(spark):
    df = spark.createDataFrame(common_rows() + family_rows(), RECORD).repartition(3)
    one = sorted(map(tuple, p2.text_spans(df).collect()))
    # 150 rows of 64 bits at least take several passes of 4096 bits
    assert one == sorted(map(tuple, p2.text_spans(df, most_bits=4096).collect()))
    texts = {r.sid: r.residues for r in p1.delivered(df, 25).collect()}
    held = {}
    for sid, text in texts.items():
        for i in range(len(text) - 24):
            held.setdefault(text[i : i + 25], set()).add(sid)
    want = {sid: {i + k for i in range(len(t) - 24) if len(held[t[i : i + 25]]) > 1 for k in range(1, 26)} for sid, t in texts.items()}
    got = {}
    for sid, first, last in one:
        got.setdefault(sid, set()).update(range(first, last + 1))
    assert got == {sid: places for sid, places in want.items() if places}


def cluster_rows():
    rng = random.Random(11)
    rows = []
    for f in range(15):
        base = random_text(rng, rng.randint(60, 160))
        rows += [(f"C{f:02d}{k}", mutated(rng, base, 0.07)) for k in range(5)]
    return [(i, s, 1, 2, "zz", 3) for i, s in rows] + family_rows()[-14:]


@pytest.mark.parametrize("shard", [20_000, 1])
def test_clusters(spark, shard):
    df = spark.createDataFrame(cluster_rows(), RECORD)
    texts = clean(cluster_rows())
    want = plain_groups(near(texts, 3, 1, 4))
    rows = p4.clustered(df, shard=shard).collect()
    sid = {r.seq_id: r.sid for r in p1.delivered(df, 30).collect()}
    by_root = {}
    for r in rows:
        by_root.setdefault(r.root, set()).update(i for i, s in sid.items() if s == r.sid)
    wanted = {}
    for i, root in want.items():
        wanted.setdefault(root, set()).add(i)
    got = {frozenset(g) for g in by_root.values()}
    assert {frozenset(g) for g in wanted.values() if len({texts[i] for i in g}) > 1} == got
    pivots = {r.sid: r.pivot for r in rows}
    alike = {(sid[a], sid[b]) for a, b in near(texts, 3, 1, 4)}
    alike |= {(b, a) for a, b in alike}
    for member, pivot in pivots.items():
        assert pivots[pivot] == pivot
        assert member == pivot or (member, pivot) in alike
    chosen = sorted(set(pivots.values()))
    assert not any((a, b) in alike for a, b in itertools.combinations(chosen, 2))


def test_clusters_do_not_depend_on_the_shard(spark):
    df = spark.createDataFrame(cluster_rows(), RECORD)
    ways = [{}, {"shard": 1}, {"shard": 3, "batch": 2}, {"complete": True}, {"complete": True, "shard": 1, "batch": 7}]
    results = [sorted(map(tuple, p4.clustered(df, **way).collect())) for way in ways]
    assert results[0] and results.count(results[0]) == len(results)


def test_a_wide_family_is_whole(spark):
    """Members and satellites of one base, compared with all pairs."""
    rng = random.Random(5)
    base = random_text(rng, 150)
    members = [mutated(rng, base, 0.10) for _ in range(120)]
    texts = {f"F{k:03d}": t for k, t in enumerate([*members, *(mutated(rng, m, 0.16) for m in members)])}
    want = plain_groups(near(texts, 3, 1, 4))
    df = spark.createDataFrame([(i, t, 1, 2, "zz", 3) for i, t in texts.items()], RECORD)
    name = {r.sid: r.seq_id for r in p1.delivered(df, 30).collect()}
    for way in ({}, {"shard": 20, "batch": 9}, {"complete": True, "shard": 50}):
        got = {name[r.sid]: r.root for r in p4.clustered(df, **way).collect()}
        assert set(got) == set(want)
        assert len(set(got.values())) == len(set(want.values()))


def tagged_rows(count=1300):
    """Texts with one tag of 40 residues; two and two are alike, by windows too short for a seed outside the tag."""
    rng = random.Random(23)
    tag, rows = random_text(rng, 40), []
    for k in range(count):
        body = random_text(rng, 104)
        other = "".join(LETTERS[(LETTERS.index(c) + 7) % 20] if i % 8 == 7 else c for i, c in enumerate(body))
        rows += [(f"T{k:04d}a", tag + body, 1, 2, "zz", 3), (f"T{k:04d}b", tag + other, 1, 2, "zz", 3)]
    return rows


@pytest.mark.parametrize("shard", [5_000, 1])
def test_families_inside_a_dense_one(spark, shard):
    df = spark.createDataFrame(tagged_rows(), RECORD)
    sid = {r.sid: r.seq_id for r in p1.delivered(df, 30).collect()}
    by_root = {}
    for r in p4.clustered(df, shard=shard).collect():
        by_root.setdefault(r.root, set()).add(sid[r.sid])
    assert sorted(map(sorted, by_root.values())) == [[f"T{k:04d}a", f"T{k:04d}b"] for k in range(1300)]


@pytest.mark.parametrize("shard", [5_000, 1])
def test_totals_count_all_members(spark, shard):
    """Two of three texts share their windows of 8 with the first only, yet are alike."""
    rng = random.Random(29)
    texts = {}
    for k in range(24):
        base = random_text(rng, 112)
        other = "".join(LETTERS[(LETTERS.index(c) + 7) % 20] if i % 8 == 7 else c for i, c in enumerate(base))
        texts |= {f"W{k:02d}a": base, f"W{k:02d}b": base[:56] + other[56:], f"W{k:02d}c": other[:56] + base[56:]}
    df = spark.createDataFrame([(i, t, 1, 2, "zz", 3) for i, t in texts.items()], RECORD)
    name = {r.sid: r.seq_id for r in p1.delivered(df, 30).collect()}
    rows = {name[r.sid]: r for r in p4.clustered(df, shard=shard).collect()}
    windows = {i: {t[k : k + 3] for k in range(len(t) - 2)} for i, t in texts.items()}
    cosine = lambda a, b: len(windows[a] & windows[b]) / (len(windows[a]) * len(windows[b])) ** 0.5
    assert any(sum(q.pivot == r.pivot for q in rows.values()) == 3 for r in rows.values())
    for i, r in rows.items():
        members = [j for j, q in rows.items() if q.pivot == r.pivot]
        assert r.total / r.windows**0.5 / p4.UNIT == pytest.approx(sum(cosine(i, j) for j in members), rel=1e-4)


def test_long_common_heads_are_split(spark):
    """Values that differ only far from their start still part into buckets, and equal ones end the splitting."""
    head = "K" * 300
    rows = [(f"K{k:03d}", head + random_text(random.Random(k // 2), 6)) for k in range(60)] + [(f"S{k}", head) for k in range(9)]
    df = spark.createDataFrame(rows, "row_key string, value string")
    whole, split = ({tuple(r) for r in p7.copies(df, most).collect()} for most in (p7.BUCKET, 3))
    assert whole == split and len(whole) == 31
    assert any(len(n) > 64 for n in p7.bucket_names(df.selectExpr("encode(value, 'UTF-8') AS value"), 3))


@pytest.mark.parametrize("text", ["ϲ", "Ϲ", "Ꭺ", "ꓐ", "Ⲟ", "ჿ", "ⵔ", "Տ", "ρ", "ᴏ", "\u1680"])
def test_letters_of_any_alphabet(text):
    assert p10.one_form("x" + text + "y").isascii()
    assert p10.one_form(text).isascii()


def test_placement_meets_proportions():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 8, 4000)
    positive = rng.binomial(size, 0.2)
    vectors = np.stack([size, positive, size - positive], 1).astype(float)
    wanted = np.array([0.6, 0.2, 0.2])[:, None] * vectors.sum(0)
    to = p5.place(vectors, wanted)
    for s in range(3):
        assert abs(vectors[to == s, 0].sum() / size.sum() - (0.6, 0.2, 0.2)[s]) < 0.005
        assert abs(vectors[to == s, 1].sum() / positive.sum() - (0.6, 0.2, 0.2)[s]) < 0.005


def test_stratified_in_shards(spark):
    sets = spark.range(3000).selectExpr("id as set_id", "case when id = 0 then 900 else 1 + id % 4 end as records", "id % 3 as positive", "cast(null as long) as negative")
    rows = p5.stratified(sets, [("a", 0.6), ("b", 0.2), ("c", 0.2)], shard_sets=500).join(sets, "set_id").groupBy("split_name").sum("records").collect()
    total = sum(r[1] for r in rows)
    assert sets.count() == p5.stratified(sets, [("a", 0.6), ("b", 0.4)]).count()
    assert {r[0]: round(r[1] / total, 1) for r in rows} == {"a": 0.6, "b": 0.2, "c": 0.2}
    assert p5.stratified(sets.limit(0), [("a", 1.0)]).count() == 0


def test_linked_sets(spark):
    clusters = spark.createDataFrame([("Q1", " C1"), ("Q2", "c1\t"), ("Q2-2", "c3"), ("Q5", "c3"), ("Q6", None), (None, "c1"), ("Q7", " ")], "seq_id string, assignments string")
    ids = spark.createDataFrame([("Q1-9",), ("Q9",), ("Q9",), (None,)], "seq_id string")
    groups = {}
    for r in p5.linked_sets(ids, clusters).collect():
        groups.setdefault(r.set_id, set()).add(r.seq_id)
    assert sorted(map(sorted, groups.values())) == [["Q1", "Q1-9", "Q2", "Q2-2", "Q5"], ["Q6"], ["Q7"], ["Q9"]]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 12), st.floats(0.1, 5), min_size=1, max_size=8), min_size=2, max_size=14), st.floats(0.2, 0.95))
def test_cosine_join_is_exact(vectors, least):
    unit = [{t: w / sum(x * x for x in v.values()) ** 0.5 for t, w in v.items()} for v in vectors]
    half = len(unit) // 2
    train, held = list(enumerate(unit[:half])), [(i + half, v) for i, v in enumerate(unit[half:])]
    dots = {(a, b): sum(w * y.get(t, 0.0) for t, w in x.items()) for a, x in train for b, y in held}
    got = {(a, b) for a, b, _ in p6.cosine_join(train, held, least)}
    assert {k for k, d in dots.items() if d >= least + 1e-6} <= got <= {k for k, d in dots.items() if d >= least - 1e-6}


@pytest.mark.parametrize("shard", [4000, 2])
def test_overlaps(spark, records, shard):
    texts = clean(family_rows())
    names = {i: ("inner_train", "inner_calibration", "outer_test", None)[k % 4] for k, i in enumerate(sorted(texts))}
    rows = [(i, n) for i, n in names.items()] + [("nobody", "inner_train")]
    splits = spark.createDataFrame(rows + rows[:4], "seq_id string, split_name string")
    equal = {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if texts[a] == texts[b] and texts[a]}
    want = {(a, b) for a, b in near(texts, 5, 3, 5) | equal if names[a] and names[b] and (names[a] == "inner_train") != (names[b] == "inner_train")}
    got = {(min(r.train_id, r.held_id), max(r.train_id, r.held_id)) for r in p6.overlaps(records, splits, shard=shard).collect()}
    assert got == want


def test_copies_in_small_buckets(spark):
    rng = random.Random(2)
    values = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(800)] + ["same" * 30] * 400 + ["", None, "é|x", "é|x"]
    rows = [(f"k{i:05d}", v) for i, v in enumerate(values)]
    want = {}
    for k, v in rows:
        if v:
            want.setdefault(v.encode(), []).append(k)
    want = {(v, len(k), min(k)) for v, k in want.items() if len(k) > 1}
    df = spark.createDataFrame(rows, "row_key string, value string").repartition(6)
    for most in (3, 200_000):
        assert {(bytes(r.value), r.n, r.first_key) for r in p7.copies(df, most).collect()} == want
    assert p7.copies(df.limit(0)).count() == 0


def test_fields_in_any_order(spark):
    rows = [("A b|c-D", 1), ("cd;ab", 1), ("ab|cd|cd", 2), ("c d | a.b ;; CD", 2), ("|;", None), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "x string, k int").select("k", p7.canonical_fields("x").alias("v"))
    values = {}
    for r in df.collect():
        values.setdefault(r.k, set()).add(r.v)
    assert values[None] == {None} and len(values[1]) == len(values[2]) == 1 and values[1] != values[2]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=6), max_size=40))
def test_trie_counts(values):
    trie = p7.Trie()
    for i, v in enumerate(values):
        trie.add(v, 1, f"{i:03d}")
    want = {}
    for i, v in enumerate(values):
        n, k = want.get(v, (0, f"{i:03d}"))
        want[v] = n + 1, k
    assert {(v, n, k) for v, n, k in trie.terminals()} == {(v, *x) for v, x in want.items()}


def check_packing(rows, sizes, capacity):
    parts, load = {}, {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append((r.part_no, r.token_start, r.tokens))
        load[r.container] = load.get(r.container, 0) + r.tokens
    assert max(load.values(), default=0) <= capacity
    assert set(parts) == set(sizes)
    for d, p in parts.items():
        p.sort()
        at = 0
        for k, (no, start, tokens) in enumerate(p):
            assert no == k and start == at
            at += tokens
        assert at == sizes[d] and (len(p) == 1 or sizes[d] > capacity)
        assert all(t == capacity for _, _, t in p[:-1])
    return sum(sizes.values()) / (len(load) * capacity) if load else 1.0


def test_packing(spark):
    rng = random.Random(4)
    texts = ["x" * min(int(rng.lognormvariate(4.5, 1)), 5000) for _ in range(3000)] + ["", "é", None, "y" * 4095, "y" * 4096, "z" * 511]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(None, "abc", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int").repartition(7)
    sizes = {i: len(t.encode()) + 1 for i, t in enumerate(texts) if t is not None}
    for capacity in (512, 4096, 3):
        used = check_packing(p8.packed(df.where("doc_id < 40 or doc_id > 2990") if capacity == 3 else df, capacity).collect(), {k: v for k, v in sizes.items() if capacity != 3 or k < 40 or k > 2990}, capacity)
        assert used > (0.9 if capacity > 3 else 0.5)
    assert p8.packed(df.limit(0), 512).count() == 0


def test_one_length_for_all(spark):
    df = spark.range(1000).selectExpr("id as doc_id", "repeat('a', 99) as text")
    assert check_packing(p8.packed(df, 1000).collect(), {i: 100 for i in range(1000)}, 1000) == 1.0


def test_leaks(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "naïve", "7", "x2"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((5, 12, 13, 40))))) for i in range(20)] + [(20, ""), (21, None)]
    documents = []
    for d in range(120):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        words = (rng.choice(items[:20])[1] or "").split()
        n = rng.choice((11, 12, 13, 30))
        at = rng.randint(0, max(0, len(words) - n))
        text[20:20] = words[at : at + n]
        documents.append((d, rng.choice((" ", ", ", "\n- ", "_")).join(text).upper(), 1))
    documents += [(500, None, 1), (501, "", 1), (None, "x", 1), documents[0]]

    def grams(t):
        w = p9.words(t)
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    want = {(d, i) for d, t, _ in documents if t and d is not None for i, s in items if s and grams(t) & grams(s)}
    got = {tuple(r) for r in p9.leaks(spark.createDataFrame(documents, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and want


def test_one_form_cases():
    same = [
        ("café", "café"), ("file", "ﬁle"), ("ABC 1", "ＡＢＣ １"), ("paypal", "pаypаl"), ("TOP", "ΤΟΡ"), ("co­op", "coop"), ("zero", "ze​ro"),
        ("é", "е́"), ("Å", "Å"), ("a‍́b", "áb"), ("gas", "ɡɑѕ"), ("x y", "x y"), ("5 µg", "5 μg"),
    ]
    for a, b in same:
        assert p10.one_form(a) == p10.one_form(b), (a, b)
    for a, b in [("Case", "case"), ("a-b", "a b"), ("1", "l"), ("α", "a"), ("a\tb", "a b"), ("a.", "a")]:
        assert p10.one_form(a) != p10.one_form(b), (a, b)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aeoX .1\t ́̈​­ éаеоıﬁＡÅ̧日ё　각"), max_size=14))
def test_segments_give_the_form_of_the_whole(text):
    whole = unicodedata.normalize("NFKC", p10.INVISIBLE.sub("", unicodedata.normalize("NFKD", p10.BLANK.sub(" ", p10.INVISIBLE.sub("", text)))).translate(p10.TABLE))
    assert p10.one_form(text) == whole
    assert p10.one_form(whole) == whole


def test_same_look(spark):
    rows = [(1, "abc"), (2, "аbc"), (3, "abc"), (4, "ABC"), (5, None), (None, "abc"), (6, ""), (7, "​"), (2, "аbc")]
    got = {tuple(r) for r in p10.same_look(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 2), (2, 3), (6, 7)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], RECORD)
    splits = spark.createDataFrame([], "seq_id string, split_name string")
    assert p1.near_pairs(none).count() == 0
    assert p2.record_spans(none).count() == 0
    assert p4.clustered(none).count() == 0
    assert p6.overlaps(none, splits).count() == 0
    assert p10.same_look(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert p9.leaks(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_windows_of_batches():
    texts = Texts(pa.array(["ABCDE", "", "AB", "ABCDE"]).slice(0, 4))
    text, at, value = texts.windows(3)
    assert text.tolist() == [0, 0, 0, 3, 3, 3] and at.tolist() == [0, 1, 2] * 2
    assert value[:3].tolist() == value[3:].tolist() and len(set(value.tolist())) == 3


def test_p4_chance_windows_tie_no_shards_together(spark):
    rng = np.random.default_rng(31)
    # a chain of unrelated texts, each with a window of eight residues of the next, and mutated copies of each
    chain = ["".join(rng.choice(list(LETTERS), 60)) for _ in range(40)]
    chain = [a[:30] + b[10:18] + a[38:] for a, b in zip(chain, [*chain[1:], chain[0]])]
    changed = [t[:50] + ("A" if t[50] != "A" else "C") + t[51:] for t in chain]
    records = spark.createDataFrame([(f"p{i:03d}", t) for i, t in enumerate(chain + changed)], "seq_id string, sequence string")
    text = delivered(records, 30).select("sid", "residues")
    found = {agree: components(linked_by_seeds(text, p4.SEED, 64, records, agree)).groupBy("root").count().agg({"count": "max"}).first()[0] for agree in (0, p4.AGREE)}
    assert found == {0: 80, p4.AGREE: 2}
    out = p4.clustered(records).select("sid", "root").collect()
    assert len(out) == 80 and len({r.root for r in out}) == 40


def test_keys_of_any_width():
    for dtype, width in ((ENTRY, 3), (p2.ANCHOR, 6)):
        entries = np.zeros(3, dtype)
        entries["key"] = [bytes([i] * width) for i in (1, 2, 255)]
        assert keys_of(entries).tolist() == [int.from_bytes(bytes([i] * width), "little") for i in (1, 2, 255)]


def test_flanks_beside_seeds():
    texts = Texts(pa.array(["ACDEFGHIKLMNPQRSTVWYACDEFG", "", "GHIKLMNPQ"]))
    place = np.array([0, 10, 18, 26, 27])
    text = np.array([0, 0, 0, 2, 2])
    kinds = [[0] * FLANK + [CLASS[ord(c) & 31] for c in t] + [0] * FLANK for t in ("ACDEFGHIKLMNPQRSTVWYACDEFG", "GHIKLMNPQ")]
    plain = []
    for i, at in zip((0, 0, 0, 1, 1), (0, 10, 18, 0, 1)):
        row = kinds[i]
        plain.append(sum(int(c) << 2 * (15 - j) for j, c in enumerate(row[at : at + 8] + row[at + 16 : at + 24])))
    got = flanks(texts, text, place, 8)
    assert got.tolist() == plain
    assert agreeing(got, got).tolist() == [16] * 5
    assert agreeing(np.array([0b1101], np.uint32), np.array([0b0001], np.uint32)).tolist() == [15]


def chained_texts(seed):
    """Unrelated texts, each with a window of eight residues of the next, and a mutated copy of each."""
    rng = np.random.default_rng(seed)
    chain = ["".join(rng.choice(list(LETTERS), 30)) for _ in range(40)]
    chain = [a[:11] + b[2:10] + a[19:] for a, b in zip(chain, [*chain[1:], chain[0]])]
    return chain, [t[:29] + ("A" if t[29] != "A" else "C") for t in chain]


def largest_shard(module, monkeypatch):
    sizes = []

    def measured(edges):
        out = components(edges)
        sizes.append(out.groupBy("root").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(module, "components", measured)
    return sizes


def test_p1_chance_windows_tie_no_shards_together(spark, monkeypatch):
    chain, changed = chained_texts(37)
    sizes = largest_shard(p1, monkeypatch)
    records = spark.createDataFrame([(f"p{i:03d}", t) for i, t in enumerate(chain + changed)], "seq_id string, sequence string")
    assert p1.near_pairs(records).count() == 40
    assert sizes == [2]


def test_p6_chance_windows_tie_no_shards_together(spark, monkeypatch):
    chain, changed = chained_texts(37)
    sizes = largest_shard(p6, monkeypatch)
    records = spark.createDataFrame([(f"p{i:03d}", t) for i, t in enumerate(chain + changed)], "seq_id string, sequence string")
    splits = spark.createDataFrame([(f"p{i:03d}", "inner_train" if i < 40 else "outer_test") for i in range(80)], "seq_id string, split_name string")
    assert p6.overlaps(records, splits).count() == 40
    assert sizes == [2]
