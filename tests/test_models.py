"""Windows against references, fitted models, settings and stamps."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.functions import features
from residua.operators import domain, models, regulatory, splits
from residua.operators.similarity import local_alignment, ungapped_identity
from residua.sources import config

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def text(rng, n):
    return "".join(rng.choice(LETTERS) for _ in range(n))


@pytest.mark.parametrize("block", [100_000, 150])
def test_window_matches_are_those_of_all_windows(spark, block):
    rng = random.Random(12)
    shared = text(rng, 90)
    queries = [("q1", text(rng, 30) + shared, "g1"), ("q2", shared[5:40], None), ("q3", text(rng, 120), "g2"), ("q4", "ACD", None), ("q5", None, None), ("q6", "", None)]
    refs = [("r1", text(rng, 17) + shared + text(rng, 9), "g9"), ("r2", text(rng, 60), None), ("r3", text(rng, 100), "g2"), ("q1", shared, "g1"), ("r4", shared, "g1"), ("r5", None, None)]
    schema = "id string, sequence string, grp string"
    got = {r.id: (r.identity, r.reference_id) for r in regulatory.window_matches(spark.createDataFrame(queries, schema), spark.createDataFrame(refs, schema), block=block).collect()}
    want = {}
    for i, q, g in queries:
        found = [(-round(ungapped_identity(q, s, 80, 3 if len(q) >= 80 else 1), 4), j) for j, s, h in refs if q and s and i != j and not (g and g == h)]
        if found:
            want[i] = (-min(found)[0], min(found)[1])
    assert got == want
    none = spark.createDataFrame([], schema)
    assert regulatory.window_matches(none, spark.createDataFrame(refs, schema)).count() == 0
    assert regulatory.window_matches(spark.createDataFrame(queries, schema), none).count() == 0


def test_window_matches_take_a_fraction_of_pair_by_pair(spark):
    rng = random.Random(13)
    queries, refs = ([(f"{c}{i:04d}", text(rng, 130), None) for i in range(n)] for c, n in (("q", 256), ("r", 769)))
    began = time.perf_counter()
    pairs = [(ungapped_identity(q, r, 80, 3), j) for _, q, _ in queries[:2] for j, r, _ in refs]
    plain = (time.perf_counter() - began) * len(queries) / 2
    schema = "id string, sequence string, grp string"
    asked, known = spark.createDataFrame(queries, schema), spark.createDataFrame(refs, schema)
    regulatory.window_matches(asked.limit(1), known).collect()
    began = time.perf_counter()
    got = {r.id: (r.identity, r.reference_id) for r in regulatory.window_matches(asked, known).collect()}
    assert time.perf_counter() - began < plain / 12
    for k in range(2):
        v, j = min((-v, j) for v, j in pairs[k * len(refs) : (k + 1) * len(refs)])
        assert got[f"q{k:04d}"] == (round(-v, 4), j)


def test_matrix_file(tmp_path):
    path = tmp_path / "matrix.txt"
    path.write_text("# scores\n   A  C  X\nA  4 -1  0\nC -1  9 -2\nX  0 -2 -1\n")
    m = regulatory.read_matrix(str(path))
    assert m.shape == (21, 21) and m[0, 0] == 4 and m[0, 1] == -1 and m[1, 20] == -2 and m[5, 5] == -2


def test_aligned_windows_count_equal_columns(spark):
    rng = random.Random(3)
    base = text(rng, 100)
    gapped = base[:50] + "WW" + base[50:]
    df = spark.createDataFrame([(1, base, gapped), (2, base[:40], base), (3, base, text(rng, 30))], "k int, s_a string, s_b string")
    got = {r.k: r.equal for r in regulatory.aligned_windows(df, regulatory.grouped_matrix()).collect()}
    assert got[1] >= 78 and got[2] is None and got[3] == 0
    assert local_alignment(base, base, regulatory.grouped_matrix()) == "|" * 100


def blobs(spark, n=240, dims=6):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, dims))
    x[:, 2] += 3 * y
    rows = [(str(i), int(y[i]), [float(v) for v in x[i]], int(i % 3), ("inner_train", "inner_calibration", "outer_test")[i % 3]) for i in range(n)]
    return spark.createDataFrame(rows, "id string, y int, vec array<double>, fold int, partition string")


def test_models_find_the_place_that_counts(spark):
    df = blobs(spark)
    assert models.important(df, 1) == [2]
    drops = {r.place: r.drop for r in models.permutation_importance(df, models.logistic(), [0, 2]).collect()}
    assert drops[2] > 0.2 > abs(drops[0])
    best, scores = models.tuned(df)
    assert best in (0.01, 0.1, 1.0, 10.0) and models._auroc(scores) > 0.9 and scores.count() == 80
    both = models.stacked(df.select("id", "y", "fold", F.slice("vec", 1, 2).alias("a"), F.slice("vec", 3, 4).alias("b")), "a", "b")
    assert both.count() == 240 and models._auroc(both) > 0.9
    even = models.out_of_fold(df, models.forest(5, 3), even=True)
    assert models._auroc(even) > 0.85


def test_fitted_pipelines_are_kept(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import array_to_vector

    rows = blobs(spark, 60).select(F.col("y").cast("double").alias("label"), array_to_vector("vec").alias("features"))
    model = Pipeline(stages=[models.logistic()]).fit(rows)
    models.save(model, str(tmp_path / "m"))
    again = models.load(str(tmp_path / "m"))
    assert [r.prediction for r in again.transform(rows).collect()] == [r.prediction for r in model.transform(rows).collect()]
    assert models.load(str(tmp_path / "nothing")) is None


def test_calibrator_is_chosen_by_the_number_of_rows(spark):
    rng = random.Random(7)
    rows = [(int(rng.random() < p), p) for p in [round(rng.random(), 2) for _ in range(300)]]
    df = spark.createDataFrame([*rows, (None, 0.5), (1, None)], "y int, p double")
    assert models.chosen_calibrator(df, [0.5, 1.0, 2.0]) in ("temperature", "sigmoid")
    assert models.chosen_calibrator(df, [1.0], few=10) == "isotonic"
    report = models.calibration_report(df.withColumn("fold", F.lit(0)).union(df.withColumn("fold", F.lit(1))), 2).collect()
    assert {(r.fold, r.n) for r in report} == {(0, 300), (1, 300)} and all(abs(r.after - r.before) < 0.02 for r in report)


def test_detector_marks_what_lies_outside(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, [float(v) for v in rng.normal(size=3) + (i % 2)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label int, vec array<double>")
    means, cov = domain.shrunk_covariance(df)
    far = spark.createDataFrame([(900, 0, [50.0, 0.0, 0.0]), (901, 0, [0.1, 0.1, 0.0])], df.schema)
    assert {r.id: r.outside for r in domain.detected(far, df, means, cov).collect()} == {900: True, 901: False}


def test_sides_fall_back_on_the_median(spark):
    df = spark.createDataFrame([(2000 + i % 10,) for i in range(100)] + [(None,)], "year int")
    count = lambda cut: {r.side: r["count"] for r in splits.temporal_sides(df, "year", cut).groupBy("side").count().collect()}
    assert count(2003) == {"before": 30, "from": 70, "unknown": 1}
    assert count(2050) == {"before": 40, "from": 60, "unknown": 1}


def test_pools_leave_marks_out(spark):
    df = spark.createDataFrame([("a", 0, [9.0, 9.0]), ("a", 1, [1.0, 2.0]), ("a", 2, [3.0, 0.0]), ("a", 3, None)], "k string, pos int, vec array<double>")
    rows = features.joined_pools(df, ["k"], 2, special=F.col("pos") == 0).orderBy("dim").collect()
    assert [r.value for r in rows] == [2.0, 1.0, 3.0, 2.0]


def test_settings_and_stamps(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"a": {"b": [1, "x"]}, "c": None, "d": True}))
    settings = config.read_config(str(path))
    assert config.flattened(settings) == [("a.b.0", "1"), ("a.b.1", "x"), ("c", None), ("d", "true")]
    assert config.config_table(spark, settings).count() == 4
    assert config.read_config(str(tmp_path / "none.json")) == {}
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    one, two = (config.stamp(d, "id", "t").first() for d in (df, df.orderBy(F.desc("id"))))
    assert one == two and one.rows == 2
    rows = config.with_provenance(df.withColumn("source", F.when(F.col("v") == 1, "own")), "given", "1", "2024-01-01").orderBy("id").collect()
    assert [(r.source, r.ingest_date) for r in rows] == [("own", "2024-01-01"), ("given", "2024-01-01")]


def test_pages_of_a_scan(spark, tmp_path):
    for category, page, rows in (("toxin", 1, [("a", "ACD"), ("b", "ACX")]), ("toxin", 2, [("c", "KLM")]), ("other", 1, [("d", "ACD")])):
        (tmp_path / category).mkdir(exist_ok=True)
        (tmp_path / category / f"{page}.json").write_text("\n".join(json.dumps({"id": i, "sequence": s}) for i, s in rows))
    got = {tuple(r) for r in config.read_pages(spark, str(tmp_path), {"toxin": 1}).collect()}
    assert got == {("a", "ACD", "toxin", 1, "1"), ("c", "KLM", "toxin", 1, "2")}
