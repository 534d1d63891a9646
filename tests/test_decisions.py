"""Thresholds, votes, reports, removals and suites against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from residua.operators import decisions, domain, graph, reports, similarity, splits, suites
from residua.session import written
from residua.sources.fasta import read_fasta
from residua.sources.files import read_records


def scores(spark, n=400, seed=2):
    rng = random.Random(seed)
    rows = [(f"r{i:04d}", int(rng.random() < 0.3), round(rng.random(), 3), rng.choice("ab"), rng.randint(5, 60)) for i in range(n)]
    return rows, spark.createDataFrame([*rows, ("x", None, 0.5, "a", 9), ("z", 1, None, "b", 9)], "id string, y int, p double, bin string, len int")


def test_bayes_threshold():
    assert decisions.bayes_threshold(10, 1) == 0.0909
    for costs in ((0, 1), (1, 0), (-1, 2)):
        with pytest.raises(ValueError):
            decisions.bayes_threshold(*costs)


def test_cost_optimal_is_the_cheapest(spark):
    rows, df = scores(spark)
    grid = decisions.cost_grid(50)

    def cost(some, t):
        pos, neg = [r for r in some if r[1]], [r for r in some if not r[1]]
        missed = sum(r[2] < t for r in pos) / len(pos) if pos else 1.0
        return missed * 0.1 * 50 + (sum(r[2] >= t for r in neg) / len(neg) if neg else 0.0) * 0.9 * 7

    best = decisions.cost_optimal(df, 50, 7, 0.1, grid).first()
    assert best.threshold == min(grid, key=lambda t: (round(cost(rows, t), 9), t))
    got = {r.bin: r for r in decisions.cost_optimal_by(df, "bin", ["a", "b", "c"], 50, 7, 0.1, grid).collect()}
    assert got["c"].basis == "all" and got["c"].threshold == best.threshold
    for b in "ab":
        some = [r for r in rows if r[3] == b]
        assert got[b].basis == "own" and got[b].threshold == min(grid, key=lambda t: (round(cost(some, t), 9), t))


def test_votes_go_by_the_scores_that_are_there(spark):
    df = spark.createDataFrame([(0.6, 0.6, 0.1), (0.6, None, 0.1), (None, None, None)], "a double, b double, c double")
    rows = df.select(decisions.soft_vote(["a", "b", "c"], [2, 2, 1]).alias("s"), decisions.majority_vote(["a", "b", "c"]).alias("m")).collect()
    assert [(r.s and round(r.s, 4), r.m) for r in rows] == [(0.5, 1), (0.4333, 0), (None, None)]


def test_first_wins(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, None), ("b", 2, "y"), (None, 0, "z")], "k string, n int, v string")
    assert {tuple(r) for r in decisions.first_wins(df, "k", [F.col("n")]).collect()} == {("a", 1, None), ("b", 2, "y")}
    assert decisions.first_wins(df.limit(0), "k", [F.col("n")]).count() == 0


def test_first_retained_is_the_greedy_removal(spark):
    rng = random.Random(4)
    names = [f"n{i:03d}" for i in range(60)]
    pairs = {tuple(sorted(rng.sample(names, 2))) for _ in range(90)} | {(names[i], names[i + 1]) for i in range(20)}
    near = {}
    for a, b in pairs:
        near.setdefault(b, set()).add(a)
    kept, removed = [], {}
    for n in names:
        before = [k for k in kept if k in near.get(n, ())]
        if before:
            removed[n] = min(before)
        else:
            kept.append(n)
    df = spark.createDataFrame([*((b, a) for a, b in pairs), (None, "n001"), ("n002", "n002")], "a string, b string")
    assert {r.removed: r.kept for r in similarity.first_retained(df).collect()} == removed
    assert similarity.first_retained(df.limit(0)).count() == 0


def test_identity_does_not_clash_with_column_names(spark):
    df = spark.createDataFrame([("ACDEF", "ACDEY", 1), ("ACD", "", 2), ("AAAA", "AA", 3), (None, "A", 4)], "s string, i string, x int")
    rows = df.select("x", *similarity.identity_variants("s", "i")).orderBy("x").collect()
    assert [tuple(r)[1:] for r in rows[:3]] == [(0.8, 0.8, 0.8), (0.0, 0.0, 0.0), (0.0, 0.0, 1.0)]


def test_folds_of_groups(spark):
    rng = random.Random(8)
    rows = [(f"g{i}", 1 + int(rng.paretovariate(1.2)), 0) for i in range(500)] + [("huge", 900, 300), ("none", None, None)]
    rows = [(g, n, p if p is None or p else rng.randint(0, n)) for g, n, p in rows]
    df = spark.createDataFrame(rows, "grp string, rows int, positives int")
    for shard in (20_000, 50):
        got = {r.grp: r.fold for r in splits.stratified_group_folds(df, 3, shard).collect()}
        assert set(got) == {r[0] for r in rows} and set(got.values()) == {0, 1, 2}
        sizes = [sum(n or 0 for g, n, _ in rows if got[g] == f) for f in range(3)]
        assert max(sizes) - min(sizes) < 0.25 * sum(sizes)
    assert splits.stratified_group_folds(df.limit(0)).count() == 0


def test_length_report_has_every_bin(spark):
    _, df = scores(spark)
    rows = {r.bin: r for r in reports.by_length(df.where("len < 25")).collect()}
    assert set(rows) == {"5-9", "10-14", "15-24", "25-49", "50+"}
    assert rows["50+"].samples == 0 and rows["50+"].auroc is None and rows["50+"].sensitivity is None
    assert rows["5-9"].samples > 0 and rows["5-9"].brier is not None


def test_drift_levels(spark):
    base = spark.createDataFrame([(i, 40 + i % 30, i % 10 / 10, None) for i in range(300)], "id long, len int, score double, guard string")
    same = reports.drift_report(base, base).first()
    assert same.level == "GREEN" and same.raised == "" and same.length_ks == 0
    longer = reports.drift_report(base, base.withColumn("len", F.col("len") + 100)).first()
    assert longer.level == "RED" and longer.raised == "length_psi"
    auroc = spark.createDataFrame([(0.75,)], "auroc double")
    assert reports.drift_report(base, base, auroc).first().level == "YELLOW"
    assert reports.drift_report(base, base.limit(0)).first().level == "GREEN"


def test_backtest_needs_entries(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.8)], "y int, p double")
    assert reports.backtest(df).first().status == "INSUFFICIENT_ENTRIES"
    assert reports.backtest(df.union(df)).first().status == "PASS"
    assert reports.backtest(df.union(df).withColumn("p", 1 - F.col("p"))).first().status == "RETRAIN_TRIGGERED"
    assert reports.backtest(df.limit(0)).first().status == "INSUFFICIENT_ENTRIES"


def test_suite_is_stopped_by_the_rules(spark):
    rows = suites.ood_suite(spark, 20)
    guarded = rows.select("category", domain.guard_column()).groupBy("category").agg(F.count("guard").alias("g")).collect()
    assert {r.category: r.g for r in guarded} == {c: 0 if c == "plain" else 20 for c in suites.CATEGORIES}


def test_permuted_labels_keep_their_number(spark):
    rows, df = scores(spark)
    some = suites.permuted(df.na.drop(), 3, 4).groupBy("k").agg(F.sum("y").alias("y"), F.count("*").alias("n"), F.countDistinct("id").alias("d")).collect()
    assert {(r.y, r.n, r.d) for r in some} == {(sum(r[1] for r in rows), 400, 400)} and len(some) == 3


def test_subspace_votes(spark):
    rng = random.Random(9)
    vectors = [(i, [rng.random() for _ in range(6)], i % 2) for i in range(40)] + [(90, None, 1), (91, [0.5] * 6, None)]
    df = spark.createDataFrame(vectors, "id long, vec array<double>, label int")
    spaces = decisions.subspaces(6, 5)
    assert all(len(s) == 3 for s in spaces)
    for block in (4096, 7):
        got = {r.id: r.votes for r in domain.subspace_votes(df.where("id < 5"), df, spaces, block).collect()}
        for i in range(5):
            votes = 0
            for s in spaces:
                near = min((round(sum((vectors[i][1][d] - v[d]) ** 2 for d in s), 9), j) for j, v, y in vectors if j != i and v is not None and y is not None)
                votes += vectors[near[1]][2]
            assert got[i] == votes


def test_headless_files_keep_their_first_line(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"{i:02d}.fasta").write_text(f"MKTAYIAK{'ACDEFGHIKL'[i % 10]}\nQRQ\n>s{i} second\nACDEFG\n")
    (tmp_path / "marked.fasta").write_text(">m1 a b\nACDE\nFG\n>m2\nKLMN\n")
    rows = read_fasta(spark, str(tmp_path)).collect()
    headless = [r for r in rows if r.id is None]
    assert len(headless) == 12 and all(r.sequence.startswith("MKTAYIAK") and r.sequence.endswith("QRQ") for r in headless)
    assert {r.id for r in rows if r.id} == {f"s{i}" for i in range(12)} | {"m1", "m2"}
    assert next(r for r in rows if r.id == "m1").sequence == "ACDEFG"


def test_records_with_one_id_stay_two(spark, tmp_path):
    path = tmp_path / "records.json"
    path.write_text(json.dumps([{"id": "a", "sequence": "ACDEF", "label": 1}, {"id": "a", "sequence": "KLMNP", "is_toxic": 0}, {"sequence": "QRSTV"}, {"id": "n", "sequence": None}]))
    rows = sorted(((r.id or "", r.sequence, r.label) for r in read_records(spark, str(path)).collect()), key=str)
    assert rows == [("", "QRSTV", None), ("a", "ACDEF", 1), ("a", "KLMNP", 0)]


def test_components_end_on_long_chains(spark):
    df = spark.createDataFrame([(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)], "a string, b string").repartition(5)
    assert {(r.node, r.root) for r in graph.connected(df).collect()} == {(f"c{i:03d}", "c000") for i in range(61)}


def test_copies_can_be_forgotten(spark):
    import os

    from residua import session

    one = session.written(spark.range(3), "three")
    path = one.inputFiles()[0].removeprefix("file://")
    assert one.count() == 3 and os.path.exists(path)
    session.forget()
    assert not os.path.exists(path)
    assert session.written(spark.range(2), "two").count() == 2


def test_permuted_labels_are_not_broadcast(spark):
    df = spark.createDataFrame([(str(i), i % 2, i / 100) for i in range(100)], "id string, y int, p double")
    out = suites.permuted(written(df, "scores"), 30)
    assert out.count() == 3000
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
