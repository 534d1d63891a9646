"""Queries on scores and labels: metrics, calibration, conformal sets, thresholds, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.functions import features, scales, scoring
from residua.operators import conformal, drift, metrics
from residua.session import written
from residua.sources.tables import PEPTIDES_SQL, peptides, table

GRID = [round(0.001 + i * 0.998 / 999, 6) for i in range(1000)]
PREVALENCES = (0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.5)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, p, q, bin, cluster, len) of the labelled peptides; p toxicity, q allergenicity."""
    rows = scoring.scored(peptides(spark, sf_dir)).where("label is not null")
    bin_ = F.expr(features.length_bin_sql("screening", "len"))
    return rows.select("id", F.col("label").alias("y"), F.col("tox").alias("p"), F.col("alg").alias("q"), bin_.alias("bin"), F.coalesce("accession", F.lit("none")).alias("cluster"), "len")


PRED = f"""WITH {PEPTIDES_SQL}, {scoring.SCORED_SQL}, pred AS (
  SELECT id, label AS y, tox AS p, alg AS q, {features.length_bin_sql('screening', 'len')} AS bin, coalesce(accession, 'none') AS cluster, len FROM scored WHERE label IS NOT NULL)"""


def _r(text: str, digits: int = 4) -> str:
    return scales.rounded(text, digits)


def _ratio(top: str, bottom: str) -> str:
    return f"(CASE WHEN {bottom} > 0 THEN CAST({top} AS DOUBLE) / ({bottom}) ELSE 0e0 END)"


def q_confusion(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir), ["bin"], 0.3)


def q_losses(spark, sf_dir):
    return metrics.losses(predictions(spark, sf_dir), ["bin"])


def q_ranking(spark, sf_dir):
    return metrics.ranking(predictions(spark, sf_dir))


def q_ranking_by_bin(spark, sf_dir):
    return metrics.ranking(predictions(spark, sf_dir), ["bin"])


def q_ece(spark, sf_dir):
    return metrics.ece(predictions(spark, sf_dir))


def q_reliability(spark, sf_dir):
    return metrics.reliability(predictions(spark, sf_dir))


def q_adaptive(spark, sf_dir):
    rows = metrics.adaptive(predictions(spark, sf_dir))
    return rows.select("bin", "n", metrics._r(F.col("confidence")).alias("confidence"), metrics._r(F.col("accuracy")).alias("accuracy"), "low", "high")


def q_adaptive_ece(spark, sf_dir):
    return metrics.adaptive_ece(predictions(spark, sf_dir))


def q_top_precision(spark, sf_dir):
    return metrics.top_precision(predictions(spark, sf_dir), ["bin"])


def q_recall_at_precision(spark, sf_dir):
    return metrics.recall_at_precision(predictions(spark, sf_dir), [0.5, 0.6, 0.8])


def q_threshold_rates(spark, sf_dir):
    return metrics.threshold_rates(predictions(spark, sf_dir), GRID)


def q_constrained_threshold(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    cases = {"recall_90": (0.9, None), "fpr_02": (None, 0.02), "both": (0.98, 0.2), "none": (None, None)}
    out = None
    for name, (recall, fpr) in cases.items():
        one = metrics.constrained_threshold(rows, GRID, recall, fpr).select(F.lit(name).alias("rule"), "*")
        out = one if out is None else out.union(one)
    return out


def q_ppv_grid(spark, sf_dir):
    rates = metrics.confusion(predictions(spark, sf_dir), ["bin"], 0.3).select("bin", "sensitivity", "specificity")
    grid = F.explode(F.array(*[F.lit(p) for p in PREVALENCES]))
    rows = rates.select("*", grid.alias("prevalence"))
    return rows.withColumn("ppv", F.expr(metrics.ppv_at("sensitivity", "specificity", "prevalence")))


def q_bootstrap(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return metrics.bootstrap(rows, "cluster", "brier").select(F.lit("brier").alias("metric"), "*").union(metrics.bootstrap(rows, "cluster", "accuracy").select(F.lit("accuracy"), "*"))


def _halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calibration and test rows, by the digest of the id."""
    rows = written(rows, "scores")  # both halves read the scores, which are computed once
    half = F.conv(F.substring(F.md5("id"), 1, 2), 16, 10).cast("int") < 128
    return rows.where(half), rows.where(~half)


_HALF = "CAST('0x' || substr(md5(id), 1, 2) AS INT) < 128"


def q_conformal_quantiles(spark, sf_dir):
    cal, _ = _halves(predictions(spark, sf_dir))
    both = conformal.quantiles(cal).union(conformal.quantiles(cal, conditioned=False))
    return both.select(F.coalesce(F.col("y").cast("string"), F.lit("all")).alias("y"), "n", "k", "q")


def _with_sets(spark, sf_dir):
    cal, test = _halves(predictions(spark, sf_dir))
    q = conformal.quantiles(cal).agg(F.max(F.when(F.col("y") == 0, F.col("q"))).alias("q0"), F.max(F.when(F.col("y") == 1, F.col("q"))).alias("q1"))
    return conformal.sets(test.crossJoin(F.broadcast(q)), F.col("q0"), F.col("q1"))  # one row


def q_conformal_sets(spark, sf_dir):
    return _with_sets(spark, sf_dir).groupBy("status", "in_0", "in_1").agg(F.count("*").alias("n"))


def q_coverage(spark, sf_dir):
    return conformal.coverage(_with_sets(spark, sf_dir), ["y", "bin"])


def _eras(spark, sf_dir):
    """Events before and after the middle of the month, with a value each."""
    rows = table(spark, sf_dir, "events").where("value is not null").select(F.col("event_id").alias("id"), "value", F.to_date("ts").alias("day"))
    return rows.where("day < date'2024-01-16'"), rows.where("day >= date'2024-01-16'")


_ERAS = "WITH ev AS (SELECT event_id AS id, value, CAST(ts AS DATE) AS day FROM events WHERE value IS NOT NULL), base AS (SELECT * FROM ev WHERE day < DATE '2024-01-16'), now_ AS (SELECT * FROM ev WHERE day >= DATE '2024-01-16')"


def q_psi(spark, sf_dir):
    return drift.psi(*_eras(spark, sf_dir), "value")


def q_ks(spark, sf_dir):
    return drift.ks(*_eras(spark, sf_dir), "value")


def q_length_mix(spark, sf_dir):
    rows = peptides(spark, sf_dir)
    return drift.mix(rows, F.expr(features.length_bin_sql("screening", "len")))


def q_correlations(spark, sf_dir):
    return drift.correlations(predictions(spark, sf_dir), "p", "q")


def q_shadow(spark, sf_dir):
    rows = scoring.scored(peptides(spark, sf_dir))
    status = lambda p, cut: F.when(F.col(p) >= cut, "FLAGGED").otherwise("APPROVED")
    one = rows.select("id", F.expr(scoring.desirability_sql("cal_ant", "cal_tox", "cal_alg")).alias("score"), status("tox", 0.35).alias("status"))
    two = rows.select("id", F.expr(scoring.desirability_sql("ant", "tox", "alg")).alias("score"), status("tox", 0.33).alias("status"))
    return drift.shadow(one, two)


def q_length_distribution(spark, sf_dir):
    """Summary of the lengths per source: population deviation and exact percentiles."""
    rows = peptides(spark, sf_dir)
    r = lambda e: F.expr(scales.rounded(e, 4))
    return rows.groupBy("source").agg(
        F.count("*").alias("n"), F.min("len").alias("shortest"), F.max("len").alias("longest"), F.sum("len").alias("total"),
        r("sqrt(CAST(sum(len * len) AS DOUBLE) / count(*) - power(CAST(sum(len) AS DOUBLE) / count(*), 2e0))").alias("deviation"),
        F.expr("percentile(len, 0.25)").alias("p25"), F.expr("percentile(len, 0.5)").alias("median"), F.expr("percentile(len, 0.75)").alias("p75"),
    )


def q_class_balance(spark, sf_dir):
    rows = peptides(spark, sf_dir)
    counted = rows.cube("source", "label").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))
    return counted.select("source", F.col("label").cast("string").alias("label"), "n", "level")


def q_brier_by_score(spark, sf_dir):
    """Losses of raw and calibrated scores side by side."""
    rows = scoring.scored(peptides(spark, sf_dir)).where("label is not null")
    long = rows.select("id", F.col("label").alias("y"), F.explode(F.create_map(*[x for k in ("tox", "cal_tox", "alg", "cal_alg") for x in (F.lit(k), F.col(k))])).alias("score", "p"))
    return metrics.losses(long, ["score"])


def q_error_correlation(spark, sf_dir):
    rows = predictions(spark, sf_dir).select("id", F.abs(F.col("y") - F.col("p")).alias("e"), F.abs(F.col("y") - F.col("q")).alias("f"))
    return drift.correlations(rows, "e", "f")


def q_tradeoffs(spark, sf_dir):
    """Counts of candidates that pass one axis and fail another."""
    rows = scoring.scored(peptides(spark, sf_dir))
    return rows.agg(
        F.count("*").alias("n"), F.count_if((F.col("ant") >= 0.5) & (F.col("tox") >= 0.35)).alias("antigen_toxic"),
        F.count_if((F.col("ant") >= 0.5) & (F.col("alg") >= 0.35)).alias("antigen_allergen"), F.count_if((F.col("tox") >= 0.35) & (F.col("alg") >= 0.35)).alias("toxic_allergen"),
    )


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}

_CONF = """count(*) FILTER (y = 1 AND p >= 0.3) AS tp, count(*) FILTER (y = 0 AND p >= 0.3) AS fp, count(*) FILTER (y = 0 AND p < 0.3) AS tn, count(*) FILTER (y = 1 AND p < 0.3) AS fn"""
_SENS, _SPEC = _ratio("tp", "tp + fn"), _ratio("tn", "tn + fp")
_LOSS = f"count(*) AS n, {_r('avg((c - y) * (c - y))')} AS brier, {_r('avg(-(y * ln(c) + (1 - y) * ln(1 - c)))')} AS log_loss"
_CLIP = "greatest(1e-15, least(1 - 1e-15, p))"
_BIN = " + ".join(f"(CASE WHEN p >= {e!r}e0 THEN 1 ELSE 0 END)" for e in metrics.edges(10)[1:-1])
_RANK = """tie AS (SELECT {by} p, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM pred GROUP BY ALL),
st AS (SELECT *, sum(pos) OVER ({part} ORDER BY p DESC) AS cp, sum(n) OVER ({part} ORDER BY p DESC) AS cn FROM tie),
su AS (SELECT {by} sum(pos) AS positives, sum(n) AS samples, sum((n - pos) * ((cp - pos) * 2 + pos)) AS won, sum(pos * cp / cn) AS ap FROM st {group})
SELECT {by} positives::BIGINT AS positives, samples::BIGINT AS samples, """
_RANK += f"""{_r("CASE WHEN positives > 0 AND samples > positives THEN won / (positives * (samples - positives) * 2) ELSE 0.5e0 END")} AS auroc,
{_r("CASE WHEN positives > 0 AND samples > positives THEN ap / positives ELSE positives / samples END")} AS auprc FROM su"""
_GRID = f"grid AS (SELECT unnest([{', '.join(map(str, GRID))}])::DOUBLE AS threshold)"
_RATES = f"""{_GRID}, tt AS (SELECT threshold, count(*) FILTER (y = 1 AND p >= threshold) AS tp, count(*) FILTER (y = 0 AND p >= threshold) AS fp,
count(*) FILTER (y = 0 AND p < threshold) AS tn, count(*) FILTER (y = 1 AND p < threshold) AS fn FROM pred, grid GROUP BY threshold),
rates AS (SELECT threshold, {_r(_ratio('tp', 'tp + fn'))} AS recall, {_r(_ratio('fp', 'fp + tn'))} AS fpr, {_r(_ratio('tn', 'tn + fp'))} AS specificity, {_r(_ratio('tp', 'tp + fp'))} AS ppv FROM tt)"""
_NTILE = "cut AS (SELECT *, ntile(15) OVER (ORDER BY p, id) - 1 AS bin15 FROM pred), per AS (SELECT bin15::INT AS bin, count(*) AS n, avg(p) AS confidence, avg(y) AS accuracy, min(p) AS low, max(p) AS high FROM cut GROUP BY 1)"
_QUANT = f"""cal AS (SELECT y, CASE WHEN y = 1 THEN 1 - p ELSE p END AS s FROM pred WHERE {_HALF}),
z AS (SELECT y, count(*) AS n, ceil(round((count(*) + 1) * 0.95, 9))::BIGINT AS k FROM cal GROUP BY y),
o AS (SELECT y, s, row_number() OVER (PARTITION BY y ORDER BY s) AS r FROM cal),
q AS (SELECT z.y, z.n, z.k, coalesce(o.s, 1.0) AS q FROM z LEFT JOIN o ON o.y = z.y AND o.r = z.k)"""
_SETS = f"""{_QUANT}, lim AS (SELECT max(q) FILTER (y = 0) AS q0, max(q) FILTER (y = 1) AS q1 FROM q),
st AS (SELECT t.*, p <= q0 AS in_0, (1 - p) <= q1 AS in_1, (p <= q0)::INT + ((1 - p) <= q1)::INT AS set_size FROM pred t, lim WHERE NOT ({_HALF}))"""
_COV = f"""count(*) AS n, {_r('avg((CASE WHEN y = 1 THEN in_1 ELSE in_0 END)::INT)')} AS coverage, {_r('avg(set_size)')} AS mean_set_size,
{_r('avg((set_size = 2)::INT)')} AS uncertain, {_r('avg((set_size = 0)::INT)')} AS empty FROM st"""
_PSI = ", ".join(f"quantile_cont(value, {i / 10}) AS b{i}" for i in range(1, 10))
_BUCKET = " + ".join(f"(value >= b{i})::INT" for i in range(1, 10))


def _corr(source: str, x: str, y: str) -> str:
    return f"""rk AS (SELECT {x} AS x, {y} AS y, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rx,
rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS ry FROM {source})
SELECT {_r('corr(x, y)')} AS pearson, {_r('corr(rx, ry)')} AS spearman FROM rk"""


_BOOT = """cl AS (SELECT cluster, count(*) AS n, sum((p - y) * (p - y)) AS loss, count(*) FILTER ((p >= 0.5) = (y = 1)) AS ok, row_number() OVER (ORDER BY cluster) AS slot FROM pred GROUP BY cluster),
pick AS (SELECT d AS draw, CAST('0x' || substr(md5('1:' || d || ':' || i), 1, 8) AS BIGINT) % (SELECT count(*) FROM cl) + 1 AS slot
  FROM unnest(generate_series(0, 199)) AS a(d), unnest(generate_series(1, (SELECT count(*) FROM cl))) AS b(i)),
val AS (SELECT draw, sum(loss) / sum(n) AS brier, sum(ok)::DOUBLE / sum(n) AS accuracy FROM pick JOIN cl USING (slot) GROUP BY draw)"""

ORACLE = {
    "q_confusion": f"{PRED}, c AS (SELECT bin, {_CONF} FROM pred GROUP BY bin) SELECT bin, tp, fp, tn, fn, {_r(_SENS)} AS sensitivity, {_r(_SPEC)} AS specificity, {_r(_ratio('tp', 'tp + fp'))} AS ppv, {_r(_ratio('tn', 'tn + fn'))} AS npv, {_r(f'({_SENS} + {_SPEC}) / 2')} AS balanced_accuracy, {_r(_ratio('2 * tp', '2 * tp + fp + fn'))} AS f1, {_r(_ratio('tp * tn - fp * fn', 'sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))'))} AS mcc FROM c",
    "q_losses": f"{PRED} SELECT bin, {_LOSS} FROM (SELECT *, {_CLIP} AS c FROM pred) GROUP BY bin",
    "q_brier_by_score": f"{PRED} SELECT score, {_LOSS} FROM (SELECT score, y, {_CLIP} AS c FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS score, label AS y, {k} AS p FROM scored WHERE label IS NOT NULL" for k in ("tox", "cal_tox", "alg", "cal_alg")) + ")) GROUP BY score",
    "q_ranking": f"{PRED}, " + _RANK.format(by="", part="", group=""),
    "q_ranking_by_bin": f"{PRED}, " + _RANK.format(by="bin,", part="PARTITION BY bin", group="GROUP BY bin"),
    "q_ece": f"{PRED}, b AS (SELECT {_BIN} AS bin, count(*) AS n, avg(p) AS c, avg(y) AS a FROM pred GROUP BY 1) SELECT {_r('sum(n * abs(a - c)) / sum(n)')} AS ece FROM b",
    "q_reliability": f"{PRED}, b AS (SELECT {_BIN} AS bin, count(*) AS n, avg(p) AS c, avg(y) AS a FROM pred GROUP BY 1), e AS (SELECT unnest(generate_series(0, 9))::INT AS bin) SELECT e.bin, coalesce(n, 0) AS n, {_r('coalesce(c, (e.bin + 0.5e0) / 10)')} AS confidence, {_r('coalesce(a, (e.bin + 0.5e0) / 10)')} AS accuracy FROM e LEFT JOIN b USING (bin)",
    "q_adaptive": f"{PRED}, {_NTILE} SELECT bin, n, {_r('confidence')} AS confidence, {_r('accuracy')} AS accuracy, low, high FROM per",
    "q_adaptive_ece": f"{PRED}, {_NTILE} SELECT {_r('sum(n * abs(accuracy - confidence)) / sum(n)')} AS adaptive_ece FROM per",
    "q_top_precision": f"{PRED}, o AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY p DESC, id) AS r FROM pred), h AS (SELECT bin, avg(y) AS base, count(*) AS n, avg(y) FILTER (r <= 10) AS hit, (count(*) FILTER (r <= 10))::INT AS k FROM o GROUP BY bin) SELECT bin, n, k, {_r('hit')} AS precision_at_k, {_r('CASE WHEN base > 0 THEN hit / base ELSE 1e0 END', 2)} AS enrichment FROM h",
    "q_recall_at_precision": f"{PRED}, tie AS (SELECT p, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM pred GROUP BY p), st AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(n) OVER (ORDER BY p DESC) AS cn FROM tie) SELECT " + ", ".join(f"{_r(_ratio(f'coalesce(max(cp) FILTER (cp / cn >= {v / 100}), 0)', 'sum(pos)'))} AS recall_at_p{v}" for v in (50, 60, 80)) + " FROM st",
    "q_threshold_rates": f"{PRED}, {_RATES} SELECT * FROM rates",
    "q_constrained_threshold": f"""{PRED}, {_RATES}, pick AS (
SELECT 'recall_90' AS rule, *, CASE WHEN recall >= 0.9 THEN 0 ELSE 1 END AS a, CASE WHEN recall >= 0.9 THEN -threshold ELSE threshold END AS b, ['target_recall', 'fallback_lowest_threshold'] AS names FROM rates
UNION ALL SELECT 'fpr_02', *, CASE WHEN fpr <= 0.02 THEN 0 ELSE 1 END, CASE WHEN fpr <= 0.02 THEN threshold ELSE -threshold END, ['max_fpr', 'fallback_highest_threshold'] FROM rates
UNION ALL SELECT 'both', *, CASE WHEN recall >= 0.98 AND fpr <= 0.2 THEN 0 WHEN recall >= 0.98 THEN 1 ELSE 2 END, CASE WHEN recall >= 0.98 THEN -threshold ELSE threshold END, ['joint_constraint', 'prioritized_recall', 'fallback_lowest_threshold'] FROM rates
UNION ALL SELECT 'none', *, CASE WHEN threshold >= 0.5 THEN 0 ELSE 1 END, threshold, ['default_midpoint', 'default_midpoint'] FROM rates),
o AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY a, b) AS r FROM pick)
SELECT rule, threshold, names[a + 1] AS basis, recall, fpr, specificity, ppv FROM o WHERE r = 1""",
    "q_ppv_grid": f"{PRED}, c AS (SELECT bin, {_CONF} FROM pred GROUP BY bin), s AS (SELECT bin, {_r(_SENS)} AS sensitivity, {_r(_SPEC)} AS specificity FROM c), g AS (SELECT unnest([{', '.join(map(str, PREVALENCES))}])::DOUBLE AS prevalence) SELECT *, {metrics.ppv_at('sensitivity', 'specificity', 'prevalence')} AS ppv FROM s, g",
    "q_bootstrap": f"{PRED}, {_BOOT} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, {_r(f'avg({m})')} AS point, {_r(f'quantile_cont({m}, 0.025)')} AS low, {_r(f'quantile_cont({m}, 0.975)')} AS high, count(*) AS draws FROM val" for m in ("brier", "accuracy")),
    "q_conformal_quantiles": f"{PRED}, {_QUANT} SELECT y::VARCHAR AS y, n, k, q FROM q UNION ALL SELECT 'all', count(*), least(count(*), ceil(round((count(*) + 1) * 0.95, 9)))::BIGINT, (SELECT s FROM (SELECT s, row_number() OVER (ORDER BY s) AS r FROM cal) WHERE r = (SELECT least(count(*), ceil(round((count(*) + 1) * 0.95, 9))) FROM cal)) FROM cal",
    "q_conformal_sets": f"{PRED}, {_SETS} SELECT CASE set_size WHEN 1 THEN 'classified' WHEN 2 THEN 'uncertain' ELSE 'abstain' END AS status, in_0, in_1, count(*) AS n FROM st GROUP BY ALL",
    "q_coverage": f"{PRED}, {_SETS} SELECT 'all' AS over, NULL AS value, {_COV} UNION ALL SELECT 'y', y::VARCHAR, {_COV} GROUP BY y UNION ALL SELECT 'bin', bin, {_COV} GROUP BY bin".replace("AS over", 'AS "over"'),
    "q_psi": f"{_ERAS}, bd AS (SELECT {_PSI} FROM base), e AS (SELECT {_BUCKET} AS k, count(*)::DOUBLE AS n FROM base, bd GROUP BY 1), a AS (SELECT {_BUCKET} AS k, count(*)::DOUBLE AS n FROM now_, bd GROUP BY 1), s AS (SELECT unnest(generate_series(0, 9)) AS k), j AS (SELECT coalesce(e.n, 0) / (SELECT sum(n) FROM e) + 1e-4 AS x, coalesce(a.n, 0) / (SELECT sum(n) FROM a) + 1e-4 AS y FROM s LEFT JOIN e USING (k) LEFT JOIN a USING (k)) SELECT {_r('greatest(0e0, sum((y - x) * ln(y / x)))')} AS psi FROM j",
    "q_ks": f"{_ERAS}, u AS (SELECT value, 1 AS e, 0 AS a FROM base UNION ALL SELECT value, 0, 1 FROM now_), t AS (SELECT value, sum(e) AS e, sum(a) AS a FROM u GROUP BY value), c AS (SELECT sum(e) OVER (ORDER BY value)::DOUBLE AS ce, sum(a) OVER (ORDER BY value)::DOUBLE AS ca FROM t), n AS (SELECT sum(e)::DOUBLE AS te, sum(a)::DOUBLE AS ta FROM u), d AS (SELECT max(abs(ce / te - ca / ta)) AS d, max(te) AS te, max(ta) AS ta, sqrt(max(te) * max(ta) / (max(te) + max(ta))) AS root FROM c, n), l AS (SELECT *, (root + 0.12e0 + 0.11e0 / root) * d AS lam FROM d), p AS (SELECT *, CASE WHEN lam < 0.2 THEN 1e0 ELSE greatest(0e0, least(1e0, (SELECT sum(exp(-2e0 * k * k * lam * lam) * (CASE WHEN k % 2 = 1 THEN 2e0 ELSE -2e0 END)) FROM unnest(generate_series(1, 20)) AS u(k)))) END AS p FROM l) SELECT {_r('d')} AS statistic, te::BIGINT AS n_base, ta::BIGINT AS n_now, {_r('p', 6)} AS p_value FROM p",
    "q_length_mix": f"WITH {PEPTIDES_SQL}, b AS (SELECT {features.length_bin_sql('screening', 'len')} AS bin FROM pep) SELECT bin, count(*) AS n, {_r('count(*)::DOUBLE / (SELECT count(*) FROM b)')} AS fraction FROM b GROUP BY bin",
    "q_correlations": f"{PRED}, {_corr('pred', 'p', 'q')}",
    "q_error_correlation": f"{PRED}, er AS (SELECT abs(y - p) AS e, abs(y - q) AS f FROM pred), {_corr('er', 'e', 'f')}",
    "q_shadow": f"""WITH {PEPTIDES_SQL}, {scoring.SCORED_SQL}, b AS (SELECT id, {scoring.desirability_sql('cal_ant', 'cal_tox', 'cal_alg')} AS s, {scoring.desirability_sql('ant', 'tox', 'alg')} AS c, tox >= 0.35 AS t, tox >= 0.33 AS u FROM scored),
o AS (SELECT *, row_number() OVER (ORDER BY s DESC, id) AS rs, row_number() OVER (ORDER BY c DESC, id) AS rc, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS ms, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS mc FROM b),
g AS (SELECT count(*) AS n, count(*) FILTER (rs <= 5 AND rc <= 5) AS common, avg(abs(s - c)) AS md, max(abs(s - c)) AS xd, count(*) FILTER (t <> u) AS dis, corr(ms, mc) AS sp FROM o)
SELECT n AS batch_size, {_r('common::DOUBLE / (10 - common)')} AS top_overlap, {_r('sp')} AS spearman, {_r('md')} AS mean_delta, {_r('xd')} AS max_delta, dis AS disagreements, {_r('dis::DOUBLE / n')} AS disagreement_rate,
CASE WHEN dis::DOUBLE / n > 0.1 THEN 'ROLLED_BACK' ELSE 'HEALTHY' END AS canary_status FROM g""",
    "q_length_distribution": f"WITH {PEPTIDES_SQL} SELECT source, count(*) AS n, min(len)::INT AS shortest, max(len)::INT AS longest, sum(len)::BIGINT AS total, {_r('sqrt(CAST(sum(len * len) AS DOUBLE) / count(*) - power(CAST(sum(len) AS DOUBLE) / count(*), 2e0))')} AS deviation, quantile_cont(len, 0.25) AS p25, quantile_cont(len, 0.5) AS median, quantile_cont(len, 0.75) AS p75 FROM pep GROUP BY source",
    "q_class_balance": f"WITH {PEPTIDES_SQL} SELECT source, label::VARCHAR AS label, count(*) AS n, grouping_id(source, label)::INT AS level FROM pep GROUP BY CUBE (source, label)",
    "q_tradeoffs": f"WITH {PEPTIDES_SQL}, {scoring.SCORED_SQL} SELECT count(*) AS n, count(*) FILTER (ant >= 0.5 AND tox >= 0.35) AS antigen_toxic, count(*) FILTER (ant >= 0.5 AND alg >= 0.35) AS antigen_allergen, count(*) FILTER (tox >= 0.35 AND alg >= 0.35) AS toxic_allergen FROM scored",
}
