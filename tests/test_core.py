"""Core operators against plain Python, published facts and awkward input."""

import collections
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.functions import features, scales, scoring
from residua.plans import relation_queries
from residua.operators import conformal, curation, domain, drift, epitopes, graph, metrics, models, pareto, similarity, splits
from residua.sources import fasta, files
from residua.streaming import windows

PEPTIDE = "GIGAVLKVLTTGLPALISWIKRKRQQ"
LETTERS = scales.RESIDUES


def seqs(spark, texts):
    return spark.createDataFrame([(f"s{i:03d}", t) for i, t in enumerate(texts)], "id string, sequence string")


def random_texts(n, seed=1, low=1, high=120):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(low, high))) for _ in range(n)]


def one(df):
    return df.first().asDict()


def test_composition_and_groups_of_a_known_peptide(spark):
    df = seqs(spark, [PEPTIDE])
    total = sum(v for k, v in one(features.aac(df)).items() if k != "id") + sum(v for k, v in one(features.pcp(df)).items() if k != "id")
    assert round(total, 2) == 104.95
    assert one(features.aac(df))["aac_A"] == 7.692


def test_empty_and_short_sequences(spark):
    df = seqs(spark, ["", "A", "AC", None])
    for f in (features.aac, features.pcp, features.physical, features.autocorrelation, features.complexity, epitopes.regions, domain.instability_index):
        f(df).collect()
    assert epitopes.regions(df).count() == 0
    assert features.isoelectric(df).count() == 2
    assert [len(r.terms) for r in features.acc(df).collect()] == [125] * 3


def test_autocorrelation_and_covariance(spark):
    texts = random_texts(40)
    df = seqs(spark, texts)
    got = {r.id: r for r in features.autocorrelation(df).collect()}
    terms = {r.id: r.terms for r in features.acc(df).collect()}
    for i, t in enumerate(texts):
        kd = [scales.HYDROPATHY[c] / 10 for c in t]
        for lag in (1, 2, 3):
            want = sum(a * b for a, b in zip(kd, kd[lag:])) / (len(t) - lag) if len(t) > lag else 0.0
            assert got[f"s{i:03d}"][f"ACR_lag_{lag}"] == pytest.approx(want, abs=6e-4)
        z = np.array([scales.Z_COMPOSITION[c] for c in t]) / 100
        z = z - z.mean(0)
        want = (z[:-2, 0] * z[2:, 0]).mean() if len(t) > 2 else 0
        assert terms[f"s{i:03d}"][1] == pytest.approx(want, abs=1e-6)


def test_epitopes_are_runs(spark):
    texts = random_texts(60, 2)
    got = {(r.id, r.start, r.end, r.region) for r in epitopes.regions(seqs(spark, texts)).collect()}
    want = set()
    for i, t in enumerate(texts):
        v = [scales.ANTIGENIC[c] for c in t]
        hot = [sum(v[p : p + 7]) >= 7000 for p in range(len(t) - 6)]
        p = 0
        while p < len(hot):
            if hot[p]:
                e = p
                while e + 1 < len(hot) and hot[e + 1]:
                    e += 1
                want.add((f"s{i:03d}", p + 1, e + 7, t[p : e + 7]))
                p = e
            p += 1
    assert got == want


def test_charge_is_zero_at_the_isoelectric_point(spark):
    df = seqs(spark, random_texts(50, 3, 5))
    rows = df.join(features.isoelectric(df), "id").select("isoelectric_point", F.expr(features.charge_sql("isoelectric_point")).alias("c")).collect()
    for r in rows:
        assert abs(r.c) < 0.15 or r.isoelectric_point in (4.05, 12.0)


def test_prior_shift_identity_and_direction(spark):
    df = spark.createDataFrame([(0.2,), (0.0,), (1.0,), (0.7,)], "p double")
    same = df.select("p", F.expr(scoring.prior_shift_sql("p", 0.3, 0.3)).alias("q")).collect()
    assert all(r.q == pytest.approx(r.p, abs=2e-6) for r in same)
    lower = df.select("p", F.expr(scoring.prior_shift_sql("p", 0.3, 0.01)).alias("q")).collect()
    assert all(r.q <= r.p for r in lower)


def test_sanitizing_logs_changes(spark):
    df = spark.createDataFrame([("a", "  acBXd*E \n"), ("b", " "), ("c", None), ("d", "ACDE")], "k string, s string")
    rows = {r.k: r for r in curation.sanitized(df, "k", "s").collect()}
    assert set(rows) == {"a", "b", "d"}
    a = rows["a"]
    assert a.sanitized_sequence == "ACNDE" and a.original_length == 7 and a.altered_count == 3
    assert [(x.position, x.action) for x in a.alterations] == [(0, "case_converted"), (1, "case_converted"), (2, "mapped"), (3, "stripped"), (4, "case_converted"), (5, "stripped")]
    assert rows["b"].is_dropped and rows["b"].sanitized_sequence == "" and not rows["d"].alterations


def test_evidence_resolution(spark):
    rows = [("1", "AA", 1, "predicted"), ("2", "AA", 1, "experimental_assay"), ("3", "BB", 0, "predicted"), ("4", "BB", 1, "predicted"), ("5", "CC", 0, "predicted"), ("6", "CC", 1, "experimental_assay"), ("7", "DD", None, None)]
    df = spark.createDataFrame(rows, "id string, sequence string, label int, label_evidence string")
    got = {r.sequence: (r.kept_id, r.conflict) for r in curation.resolved(df).collect()}
    assert got == {"AA": ("2", False), "BB": (None, True), "CC": ("6", False), "DD": ("7", False)}
    log = {(r.id, r.duplicate_of, r.reason) for r in curation.resolved_in_order(df.withColumn("ord", F.col("id"))).collect()}
    assert ("1", "2", "EXACT_DUPLICATE_SUPERSEDED_BY_HIGHER_EVIDENCE") in log and ("4", "3", "UNRESOLVED_CONFLICTING_LABELS_DROPPED") in log and len(log) == 3


def test_guards(spark):
    got = {r.id: r.guard for r in domain.guards(seqs(spark, ["ACDE", "ac-KLMNPQR", "ACDEFGHBKL", "AAAAAAAAAA", "ACDEFGHIKL", "A" * 6 + "CDEF"])).collect()}
    assert got["s000"].startswith("length_under") and got["s001"].startswith("annotated") and got["s002"].startswith("non_canonical")
    assert got["s003"].startswith("extreme_low") and got["s004"] is None and got["s005"].startswith("extreme_skewed")


def auc(y, p):
    pos = [b for a, b in zip(y, p) if a]
    neg = [b for a, b in zip(y, p) if not a]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_ranking_metrics(spark):
    rng = random.Random(9)
    rows = [(f"{i:04d}", rng.randint(0, 1), round(rng.random(), 2)) for i in range(500)] + [("x", None, 0.3), ("y", 1, None)]
    df = spark.createDataFrame(rows, "id string, y int, p double")
    y, p = zip(*[(b, c) for _, b, c in rows if b is not None and c is not None])
    got = one(metrics.ranking(df))
    assert got["auroc"] == pytest.approx(auc(y, p), abs=1e-4)
    flipped = one(metrics.ranking(df.withColumn("p", 1 - F.col("p"))))
    assert got["auroc"] + flipped["auroc"] == pytest.approx(1, abs=2e-4)
    single = one(metrics.ranking(df.where("y = 1")))
    assert single["auroc"] == 0.5 and single["auprc"] == 1.0
    assert sum(r.n for r in metrics.adaptive(df).collect()) == 500
    assert {r.n for r in metrics.adaptive(df).collect()} == {33, 34}
    numbers = [r["rank"] for r in metrics.ranked(df, [F.col("p"), F.col("id")]).orderBy("p", "id").collect()]
    assert numbers == list(range(1, 503))


def test_threshold_table_counts(spark):
    rows = [("a", 1, 0.3), ("b", 0, 0.5), ("c", 1, 0.9), ("d", 0, 0.1)]
    df = spark.createDataFrame(rows, "id string, y int, p double")
    for r in metrics.threshold_table(df, [0.0, 0.3, 0.31, 0.95]).collect():
        assert (r.tp, r.fp, r.fn, r.tn) == tuple(sum(1 for _, y, p in rows if y == a and (p >= r.threshold) == b) for a, b in ((1, True), (0, True), (1, False), (0, False)))
    assert one(metrics.constrained_threshold(df, [0.0, 0.3, 0.31, 0.95], recall=1.0))["threshold"] == 0.3
    assert one(metrics.constrained_threshold(df, [0.3, 0.5], fpr=0.0))["basis"] == "fallback_highest_threshold"


def test_conformal_covers_its_own_class(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(f"{i}", i % 2, min(1.0, max(0.0, rng.gauss(0.3 + 0.4 * (i % 2), 0.2)))) for i in range(400)], "id string, y int, p double")
    q = {r.y: r for r in conformal.quantiles(df, 0.1).collect()}
    assert {r.k for r in q.values()} == {math.ceil(201 * 0.9)}
    cov = {(r.over, r.value): r.coverage for r in conformal.coverage(conformal.sets(df, F.lit(q[0].q), F.lit(q[1].q)), ["y"]).collect()}
    assert cov["y", "0"] >= 0.9 and cov["y", "1"] >= 0.9 and ("all", None) in cov
    assert {r.q for r in conformal.quantiles(df.limit(4), 0.05).collect()} == {1.0}


def test_psi_and_ks(spark):
    rng = random.Random(4)
    a = spark.createDataFrame([(rng.gauss(100, 15),) for _ in range(2000)], "v double")
    b = spark.createDataFrame([(rng.gauss(150, 25),) for _ in range(2000)], "v double")
    assert one(drift.psi(a, a, "v"))["psi"] == 0 and one(drift.psi(a, b, "v"))["psi"] > 0.25
    assert one(drift.ks(a, a, "v"))["statistic"] == 0
    far = one(drift.ks(a, b, "v"))
    assert far["statistic"] > 0.5 and far["p_value"] < 1e-6
    assert one(drift.psi(a, b.limit(0), "v"))["psi"] == 0
    assert drift.student_p(0.5, 20) == pytest.approx(0.02478, abs=1e-4)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randint(0, 90):02d}", f"n{rng.randint(0, 90):02d}") for _ in range(70)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)] + [(None, "c01")]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            a, b = find(a), find(b)
            label[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.connected(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {x: find(x) for x in label}


def test_window_pairs_and_positional_pairs(spark):
    rng = random.Random(7)
    texts = []
    for base in random_texts(15, 5, 20, 140):
        for rate in (0, 0.02, 0.1, 0.3):
            texts.append("".join(rng.choice(LETTERS) if rng.random() < rate else c for c in base))
    texts = list(dict.fromkeys(texts)) + ["AC", "ACD", "ACDACDACDACD"]
    df = seqs(spark, texts)
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} or {t} for t in texts]
    want = {(f"s{i:03d}", f"s{j:03d}") for i, j in itertools.combinations(range(len(texts)), 2) if 20 * len(sets[i] & sets[j]) >= 7 * len(sets[i] | sets[j])}
    assert {(r.a, r.b) for r in similarity.jaccard_pairs(df).collect()} == want
    same = lambda s, t: sum(a == b for a, b in zip(s, t)) / max(len(s), len(t))
    want = {(f"s{i:03d}", f"s{j:03d}") for i, j in itertools.combinations(range(len(texts)), 2) if same(texts[i], texts[j]) >= 0.95}
    assert {(r.a, r.b) for r in similarity.positional_pairs(df, 0.95).collect()} == want


def test_windows_of_a_text_begin_with_the_most_frequent():
    text, code = similarity.window_codes(["ACDEF", "XCDE", "WCDE", "MACD", ""], 3)
    assert text.tolist() == [0, 0, 0, 1, 1, 2, 2, 3, 3] and code[:2].tolist() == [0, 1] and code[[3, 5, 7]].tolist() == [0, 0, 1]


@pytest.mark.parametrize("home", [None, 0, 20, 40])
def test_frequent_windows_are_spared_without_losing_pairs(home):
    rng = random.Random(8)
    texts = random_texts(12, 9, 0, 90) + ["".join(rng.choice("ACD") for _ in range(rng.randint(0, 60))) for _ in range(8)]
    texts += ["".join(rng.choice(LETTERS) if rng.random() < 0.1 else c for c in t) for t in texts]
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    for up, down in ((7, 20), (1, 5), (1, 1)):
        met = itertools.combinations(range(40), 2) if home is None else itertools.product(range(home), range(home, 40))
        want = {(x, y, len(sets[x] & sets[y]), len(sets[x] | sets[y])) for x, y in met if sets[x] & sets[y] and down * len(sets[x] & sets[y]) >= up * len(sets[x] | sets[y])}
        assert set(zip(*(c.tolist() for c in similarity.matched_windows(texts, 3, (up, down), home)))) == want


def test_rows_of_bits_are_summed():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 1 << 62, (20, 2), np.uint64)
    for n in (1, 2, 3, 4, 9, 17):
        rows = rng.integers(0, 20, (n, 3))
        digits = similarity.summed(bits, rows)
        for i, word, bit in itertools.product(range(3), range(2), (0, 5, 61)):
            want = sum(int(bits[r, word]) >> bit & 1 for r in rows[:, i])
            assert sum((int(d[i, word]) >> bit & 1) << p for p, d in enumerate(digits)) == want


@pytest.mark.parametrize("home", [None, 900])
def test_texts_counted_together_are_told_apart(home):
    rng = random.Random(41)
    texts = random_texts(1_500, 42, 20, 160)
    texts += ["".join(rng.choice(LETTERS) if rng.random() < rate else c for c in t) for t in texts[:300] for rate in (0.1, 0.25)]
    rng.shuffle(texts)
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    known = {}
    for i, s in enumerate(sets):
        for w in s:
            known.setdefault(w, []).append(i)
    common = collections.Counter(p for held in known.values() for p in itertools.combinations(held, 2))
    for up, down in ((7, 20), (1, 5)):
        want = {(x, y, n, len(sets[x] | sets[y])) for (x, y), n in common.items() if n * down >= up * (len(sets[x]) + len(sets[y]) - n) and (home is None or x < home <= y)}
        assert set(zip(*(c.tolist() for c in similarity.matched_windows(texts, 3, (up, down), home)))) == want and len(want) > 100


def test_windows_of_many_letters_keep_their_codes():
    texts = ["".join(chr(0x4E00 + (i * 37 + j * j) % 3_000) for j in range(40)) for i in range(60)] + ["ACD", ""]
    text, code = similarity.window_codes(texts, 3)
    held = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    names = {}
    for i, s in enumerate(held):
        own = code[text == i].tolist()
        assert len(own) == len(set(own)) == len(s)
        for c in own:
            names[c] = names.get(c, set(s)) & s
    assert len(names) == len(set().union(*held)) and all(names.values())


def test_window_pairs_come_with_their_texts(spark):
    texts = sorted(set(random_texts(40, 43, 5, 9)))
    text = {f"s{i:03d}": t for i, t in enumerate(texts)}
    for block in (60_000, 9):
        rows = similarity.jaccard_pairs(seqs(spark, texts), 1, (1, 5), block, texts=True).collect()
        assert rows and all(text[r.a] == r.s_a and text[r.b] == r.s_b and r.a < r.b for r in rows)


def test_window_pairs_of_many_blocks(spark):
    rng = random.Random(10)
    bases = random_texts(30, 10, 3, 200)
    texts = sorted({"".join(rng.choice(LETTERS) if rng.random() < rate else c for c in base) for base in bases for rate in (0, 0.05, 0.1)})
    df = seqs(spark, texts)
    one = sorted(map(tuple, similarity.jaccard_pairs(df).collect()))
    assert one == sorted(map(tuple, similarity.jaccard_pairs(df, block=7).collect())) and len(one) > 20
    assert similarity.jaccard_pairs(df.limit(0)).count() == 0


def slow_identity(a, b):
    m, n = len(a), len(b)
    low = -1e9
    M, X, Y = ([[low] * (n + 1) for _ in range(m + 1)] for _ in range(3))
    M[0][0] = 0
    for i in range(m + 1):
        for j in range(n + 1):
            if i:
                X[i][j] = max(max(M[i - 1][j], Y[i - 1][j]) - 0.5, X[i - 1][j] - 0.1)
            if j:
                Y[i][j] = max(max(M[i][j - 1], X[i][j - 1]) - 0.5, Y[i][j - 1] - 0.1)
            if i and j:
                M[i][j] = max(M[i - 1][j - 1], X[i - 1][j - 1], Y[i - 1][j - 1]) + (a[i - 1] == b[j - 1])
    return max(0.0, max(M[m][n], X[m][n], Y[m][n]) / max(m, n))


def test_global_alignment():
    for a, b in zip(random_texts(30, 11, 1, 25), random_texts(30, 12, 1, 25)):
        assert similarity.global_identity(a, b) == pytest.approx(slow_identity(a, b), abs=1e-9)
    assert similarity.global_identity(PEPTIDE, PEPTIDE) == 1.0


def test_alignments_side_by_side_are_those_one_by_one():
    rng = random.Random(16)
    left = random_texts(60, 17, 1, 120) + ["", "A", "", "BXA"]
    right = ["".join(c if rng.random() < 0.8 else rng.choice(LETTERS) for c in t if rng.random() < 0.95) for t in left[:40]] + random_texts(20, 18, 1, 120) + ["", "", "A", "AXB"]
    pairs = list(zip(left, right))
    for cells in (1, 600, 16_000):
        assert similarity.global_identities(pairs, cells=cells).tolist() == [similarity.global_identity(a, b) for a, b in pairs]


def test_local_alignment_windows():
    matrix = np.full((21, 21), -3.0)
    np.fill_diagonal(matrix, 5)
    base = random_texts(1, 13, 100, 100)[0]
    assert similarity.local_alignment(base, base, matrix) == "|" * 100
    assert similarity.local_alignment("A" * 5 + base, base[:50] + base[53:], matrix).count("|") == 97
    assert similarity.window_identities("|" * 28 + "." * 52) == 28 and similarity.window_identities("|" * 79) == 0
    assert similarity.window_identities("." * 30 + "|" * 29 + "." * 51) == 29


def test_ungapped_windows():
    a, b = random_texts(1, 14, 120, 120)[0], random_texts(1, 15, 130, 130)[0]
    want = max(sum(x == y for x, y in zip(a[i : i + 80], b[j : j + 80])) for i in range(41) for j in range(51)) / 80
    assert similarity.ungapped_identity(a, b) == want
    strided = max(sum(x == y for x, y in zip(a[i : i + 80], b[j : j + 80])) for i in range(41) for j in range(0, 51, 3)) / 80
    assert similarity.ungapped_identity(a, b, stride=3) == strided
    assert similarity.ungapped_identity("ACD", "GGACDG") == 1.0


def test_short_match_takes_first_window(spark):
    queries = spark.createDataFrame([("q", "MMACDEFGHHKLMNPQ", "g1"), ("r1", "ACDEFGH", "g1")], "id string, sequence string, grp string")
    reference = spark.createDataFrame([("r2", "KLMNPQ", None), ("r1", "ACDEFG", "g1"), ("r3", "KLMNPQ", "g2")], "id string, sequence string, grp string")
    got = [tuple(r) for r in similarity.short_matches(queries, reference).collect()]
    assert got == [("q", "KLMNPQ", 11, "r2")]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_edit_distances_to_many():
    for low, high in ((1, 29), (31, 34), (60, 64)):
        texts = random_texts(20, 32, low, high)
        others = sorted(random_texts(20, 33, 1, 64) + [texts[0], texts[1][:-1]], key=len)
        points = np.zeros((len(others), len(others[-1])), np.uint32)
        for row, t in zip(points, others):
            row[: len(t)] = [ord(c) for c in t]
        for t in texts:
            assert similarity.edit_distances(t, points, np.array([len(x) for x in others])).tolist() == [edits(t, x) for x in others]


def test_short_texts_are_a_family_by_edits_alone(spark):
    texts = random_texts(60, 31, 6, 34)
    text = {f"r{i:02d}": t for i, t in enumerate(sorted(set(texts)))}
    df = spark.createDataFrame(list(text.items()), "rep string, sequence string")
    want = {(a, b) for a in text for b in text if a < b and max(len(text[a]), len(text[b])) < 30 and edits(text[a], text[b]) <= 0.65 * max(len(text[a]), len(text[b])) + 1e-9}
    assert want
    for block in (1_000, 9):
        assert sorted(map(tuple, similarity.edit_pairs(df, block=block).collect())) == sorted(want)
    found = {tuple(r) for r in similarity.families(df.withColumnRenamed("rep", "id")).collect()}
    assert want <= found


def test_family_clusters_hold_texts_without_common_windows(spark, tmp_path):
    rows = [("a", "ACDEFGHIKLMN"), ("b", "ACWEFWHIWLMW"), ("c", "PPQQRRSSTTVV")]
    df = spark.createDataFrame([(i, t, None, 1, "s", None) for i, t in rows], "seq_id string, sequence string, accession string, label int, source string, organism string")
    df.write.parquet(str(tmp_path / "provenance_records.parquet"))
    got = {r.id: r.cluster_id for r in relation_queries.q_family_clusters(spark, str(tmp_path)).collect()}
    old = {r.id: r.cluster_id for r in relation_queries.q_homology_clusters(spark, str(tmp_path)).collect()}
    assert got["a"] == got["b"] != got["c"] and old["a"] != old["b"]


def test_length_match_uses_each_candidate_once(spark):
    pos, neg = seqs(spark, random_texts(40, 20, 10, 40)), seqs(spark, random_texts(60, 21, 10, 40))
    rows = similarity.length_matched(pos, neg).collect()
    assert rows and len({r.negative_id for r in rows}) == len(rows) == len({r.id for r in rows})


def test_length_match_leaves_no_admissible_candidate(spark):
    pos, neg = [("p1", "A" * 99), ("p2", "C" * 500)], [("n1", "D" * 104), ("n2", "E" * 440), ("n3", "F" * 200)]
    rows = similarity.length_matched(*(spark.createDataFrame(x, "id string, sequence string") for x in (pos, neg))).collect()
    assert {tuple(r) for r in rows} == {("p1", "n1"), ("p2", "n2")}


@pytest.mark.parametrize("identity", [0.9, 0.95, 0.98])
def test_positional_pairs_with_common_heads(spark, identity):
    """Texts that all begin alike, at and around the threshold, against all pairs."""
    rng = random.Random(31)
    head, rows = "".join(rng.choice("ACDEFGHIKL") for _ in range(30)), []
    for f in range(12):
        base = head + "".join(rng.choice("ACDEFGHIKL") for _ in range(rng.randint(0, 130)))
        for _ in range(6):
            text = list(base)
            for at in rng.sample(range(len(text)), min(len(text), rng.randint(0, int(len(text) * 1.6 * (1 - identity)) + 1))):
                text[at] = rng.choice("MNPQRST")
            rows.append("".join(text)[: len(text) - rng.choice([0, 0, 0, 1, 3])])
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame([(f"p{i:03d}", t) for i, t in enumerate(rows)], "id string, sequence string")
    value = lambda s, t: sum(a == b for a, b in zip(s, t)) / max(len(s), len(t))
    want = {(f"p{i:03d}", f"p{j:03d}") for i, s in enumerate(rows) for j, t in enumerate(rows) if i < j and value(s, t) >= identity and max(len(s), len(t)) >= 1 / (1 - identity)}
    got = {(r.a, r.b) for r in similarity.positional_pairs(df, identity).collect()}
    assert want and {p for p in got if p in want} == want
    assert all(value(rows[int(a[1:])], rows[int(b[1:])]) >= identity for a, b in got)


def brute_fronts(points, margin):
    beats = lambda a, b: all(round(x - y, 9) >= -margin for x, y in zip(a, b)) and any(round(x - y, 9) > margin for x, y in zip(a, b))
    live, out, level = set(range(len(points))), {}, 0
    while live:
        first = {i for i in live if not any(beats(points[j], points[i]) for j in live)}
        if not first:
            break
        out.update(dict.fromkeys(first, level))
        live -= first
        level += 1
    return out


@pytest.mark.parametrize("margin", [0.0, 0.02])
def test_fronts_keep_every_row(spark, margin):
    rng = random.Random(6)
    points = [tuple(round(rng.random(), 2) for _ in range(3)) for _ in range(120)] + [(0.54, 0.52, 0.50), (0.50, 0.54, 0.52), (0.52, 0.50, 0.54)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, a double, b double, c double")
    want = brute_fronts(points, margin)
    for one_task in (30_000, 1):
        rows = pareto.fronts(df, ["a", "b", "c"], margin, one_task).collect()
        assert len(rows) == len(points)
        assert {r.id: r.front for r in rows if r.front is not None} == want
    if not margin:
        assert {r.id for r in pareto.front_zero(df, ["a", "b", "c"]).collect()} == {i for i, f in want.items() if f == 0}
        squared = df.select("id", *[(F.col(c) ** 3).alias(c) for c in "abc"])
        assert {r.id: r.front for r in pareto.fronts(squared, ["a", "b", "c"]).collect()} == want


def test_crowding_ends_are_infinite(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 1.0), (2, 0, 0.3, 0.6), (3, 0, 0.6, 0.4), (4, 0, 1.0, 0.0), (5, 1, 0.1, 0.1), (6, None, 0.0, 0.0)], "id long, front int, a double, b double")
    got = {r.id: r.crowding for r in pareto.crowding(df, ["a", "b"]).collect()}
    assert got[1] == got[4] == got[5] == float("inf") and got[6] is None and got[2] == pytest.approx(0.6 + 0.6) and got[3] == pytest.approx(0.7 + 0.6)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(80, 6))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(900, [0.0] * 6), (901, None)], "id long, vec array<double>")
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    cos = np.round(unit @ unit.T, 9)
    for block in (4096, 7):
        got = {(r.id, r["rank"]): r.neighbour for r in domain.nearest(df, df, 3, block).collect()}
        for i in range(80):
            order = sorted((j for j in range(80) if j != i), key=lambda j: (-cos[i, j], j))[:3]
            assert [got[i, k] for k in (1, 2, 3)] == order


def test_shrunk_covariance_and_distance(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, [float(x) for x in rng.normal(i % 2, 1, 4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, label int, vec array<double>").repartition(5)
    means, cov = domain.shrunk_covariance(df)
    x = np.array([r[2] for r in rows])
    for k in (0, 1):
        assert np.allclose(means[k], x[k::2].mean(0))
    assert np.linalg.eigvalsh(cov).min() > 0 and np.allclose(cov, np.eye(4), atol=0.3)
    far = domain.mahalanobis(spark.createDataFrame([(0, [50.0] * 4), (1, [0.0] * 4)], "id long, vec array<double>"), means, cov).orderBy("id").collect()
    assert far[0].distance > 20 > far[1].distance


def test_shared_values_and_folds(spark):
    df = spark.createDataFrame([("1", "a", "x"), ("2", "b", "x"), ("3", "b", "y"), ("4", "c", "y"), ("5", "a", "y"), ("6", None, "x")], "id string, split string, v string")
    assert {tuple(r) for r in splits.shared_values(df, "split", "v").collect()} == {("a", "b", 2), ("a", "c", 1), ("b", "c", 1)}
    rows = splits.nested(df.withColumn("g", F.col("v")), "g").collect()
    by = {}
    for r in rows:
        by.setdefault((r.fold, r.grp), set()).add(r.partition)
    assert all(len(p) == 1 for p in by.values()) and len(rows) == 30


def test_fasta_round_trip(spark, tmp_path):
    text = ">a first one\nACDE\nFGHI\n>b\nACX\n\n>c\n\n>d d\r\nacdb\r\n"
    (tmp_path / "in.fa").write_text(text)
    rows = {r.id: r for r in fasta.read_fasta(spark, str(tmp_path / "in.fa")).collect()}
    assert rows["a"].sequence == "ACDEFGHI" and rows["a"].description == "first one" and rows["a"].problem is None
    assert rows["b"].problem == "too_short" or rows["b"].sequence == "ACA"
    assert rows["c"].problem == "empty" and rows["d"].sequence == "ACDD"
    (tmp_path / "plain.fa").write_text("ACDEFG\nHIKL\n")
    plain = fasta.read_fasta(spark, str(tmp_path / "plain.fa")).collect()
    assert [(r.id, r.sequence) for r in plain] == [(None, "ACDEFGHIKL")]
    df = seqs(spark, random_texts(20, 30, 5))
    fasta.write_fasta(df, str(tmp_path / "out"))
    again = fasta.read_fasta(spark, str(tmp_path / "out")).select("id", "sequence")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))


def test_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"id": "1", "sequence": "acde", "is_toxic": 1}, {"id": "2", "sequence": "AC", "label": 0}, {"id": "3"}]')
    rows = {r.id: r for r in files.read_records(spark, str(tmp_path / "r.json")).collect()}
    assert rows["1"].label == 1 and rows["1"].sequence == "ACDE" and rows["2"].is_dropped and set(rows) == {"1", "2"}
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert files.checksums(spark, str(tmp_path / "x.bin")).first().sha256.startswith("ba7816bf")
    df = spark.createDataFrame([("<b>", 1), ("c", 2)], "id string, n int")
    assert files.table_hash(df, "id") == files.table_hash(df.orderBy(F.desc("n")).repartition(3), "id") != files.table_hash(df.limit(1), "id")
    out = files.export(df, str(tmp_path / "rep.csv"), ("csv", "json", "html"))
    assert spark.read.json(out[1]).count() == 2 and "&lt;b&gt;" in files.report(df)
    files.append_log(df, str(tmp_path / "log"))
    files.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_stream_windows_match_batch(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i % 9:02d} {i % 24:02d}:00:00", i % 3, "t%d" % (i % 2), float(i)) for i in range(300)] + [(999, "2024-03-01 00:00:00", 1, "t1", 1.0)]
    events = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value")
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    query = windows.tumbling(stream).writeStream.format("memory").queryName("tumbled").outputMode("append").start()
    query.processAllAvailable()
    query.processAllAvailable()
    query.stop()
    got = {tuple(r) for r in spark.sql("select * from tumbled").collect()}
    batch = {tuple(r) for r in windows.tumbling(events).where("start < timestamp'2024-02-20'").collect()}
    assert got == batch and len(got) == 18


def test_latch_stays_latched(spark, tmp_path):
    levels = ["RED", "RED", "GREEN", "RED", "RED", "RED", "GREEN"]
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(levels)], "key string, batch_no int, level string")
    df.coalesce(1).write.parquet(str(tmp_path / "al"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "al"))
    query = windows.red_latch(stream).writeStream.format("memory").queryName("latched").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.sql("select * from latched").collect()] == [("k", 0, True)]


def test_fitted_calibration_helps(spark):
    rng = random.Random(8)
    rows = []
    for i in range(1500):
        p = rng.random()
        rows.append((str(i), int(rng.random() < p * p), p))
    df = spark.createDataFrame(rows, "id string, y int, p double")
    coef, intercept = models.sigmoid_fit(df)
    before, after = (one(metrics.losses(d))["brier"] for d in (df, df.withColumn("p", models.sigmoid_apply("p", coef, intercept))))
    assert after < before
    steps = [r.prediction for r in models.isotonic(df).orderBy("boundary").collect()]
    assert steps == sorted(steps)


def test_core_runs_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['residua.llm'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=str(__import__("pathlib").Path(__file__).resolve().parents[1]))
    assert int(out.stdout) > 60, out.stderr
