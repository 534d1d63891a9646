"""Queries on thresholds, votes, reports, removals and suites."""

from __future__ import annotations

from pyspark.sql import functions as F

from residua.functions import features, scales, scoring
from residua.operators import curation, decisions, domain, metrics, reports, similarity, splits, suites
from residua.plans import evaluation_queries as E
from residua.plans import feature_queries, pipeline, relation_queries
from residua.session import written
from residua.sources.tables import PEPTIDES_SQL, peptides, table

COSTS, PREVALENCE, STEPS = (100_000.0, 2_500.0), 0.02, decisions.cost_grid()
BINS = list(dict.fromkeys(n for n, _ in features.LENGTH_BINS["screening"]))
RULES = {
    ("vaccine", "antigenicity"): {"recall": 0.9, "cost_fn": 10.0, "cost_fp": 1.0},
    ("vaccine", "toxicity"): {"fpr": 0.02},
    ("therapeutic", "toxicity"): {"recall": 0.98, "fpr": 0.2},
    ("therapeutic", "immunogenicity"): {"recall": 0.98, "fpr": 0.2},
}
WEIGHTS = [2.0, 2.0, 1.0]
ORGANISMS = {"bacteria": 0.50, "virus": 0.40, "tumor": 0.50}
FIRST = ("protein", "toxin", "allergen")
FORBIDDEN = ("mapped", "masked")


def q_cost_threshold(spark, sf_dir):
    return decisions.cost_optimal(E.predictions(spark, sf_dir), *COSTS, PREVALENCE, STEPS)


def q_cost_threshold_by_bin(spark, sf_dir):
    return decisions.cost_optimal_by(E.predictions(spark, sf_dir), "bin", BINS, *COSTS, PREVALENCE, STEPS)


def q_decisions(spark, sf_dir):
    rows = E.predictions(spark, sf_dir)
    tasks = rows.select("id", "y", "p", F.lit("toxicity").alias("task")).union(rows.select("id", "y", "q", F.lit("immunogenicity")))
    return decisions.decided(written(tasks, "tasks"), RULES, E.GRID)


def q_votes(spark, sf_dir):
    rows = scoring.scored(peptides(spark, sf_dir))
    kinds = ["tox", "ant", "alg"]
    return rows.select("id", decisions.soft_vote(kinds, WEIGHTS).alias("v"), decisions.majority_vote(kinds).alias("majority")).select("id", F.expr(scales.rounded("v", 6)).alias("soft"), "majority")


def q_routed(spark, sf_dir):
    """Antigenicity by the threshold of the record's kind of organism; no decision without one."""
    rows = scoring.scored(peptides(spark, sf_dir)).withColumn("kind", curation.organism_class("organism", {"e. coli": "bacteria"}))
    decision, reason = decisions.routed("kind", ORGANISMS, "ant")
    return rows.select("id", "kind", decision.alias("decision"), reason.alias("reason"))


def q_flags_table(spark, sf_dir):
    rates = metrics.confusion(E.predictions(spark, sf_dir), ["bin"], 0.3).select("bin", "sensitivity", "specificity")
    return decisions.flags_table(rates, [0.01, 0.02, 0.03])


def q_first_delivery(spark, sf_dir):
    """The delivery that counts for each record: by kind of source, then by number."""
    rows = table(spark, sf_dir, "provenance_records").select("seq_id", "record_no", "source")
    rank = F.coalesce(*[F.when(F.col("source").contains(w), i) for i, w in enumerate(FIRST)], F.lit(len(FIRST)))
    return decisions.first_wins(rows, "seq_id", [rank, F.col("record_no")])


def q_rank_compare(spark, sf_dir):
    rows = scoring.scored(peptides(spark, sf_dir))
    rows = rows.select("id", F.expr(scoring.desirability_sql("ant", "tox", "alg")).alias("raw"), F.expr(scoring.desirability_sql("cal_ant", "cal_tox", "cal_alg")).alias("calibrated"))
    return decisions.compared_ranks(rows, "raw", "calibrated")


def q_hit_rate(spark, sf_dir):
    return decisions.hit_rate(E.predictions(spark, sf_dir))


def q_classifier_report(spark, sf_dir):
    return reports.classifier_report(written(E.predictions(spark, sf_dir), "scores"), 0.3, ["bin"])


def q_length_report(spark, sf_dir):
    return reports.by_length(written(E.predictions(spark, sf_dir), "scores"), 0.3)


def q_drift_report(spark, sf_dir):
    """Records of one half, by digest, against the longer ones of the other."""
    rows = scoring.scored(peptides(spark, sf_dir)).select("id", "len", F.col("tox").alias("score"), domain.guard_column())
    base, now = E._halves(rows)
    return reports.drift_report(base, now.where("len >= 60"))


def q_backtest(spark, sf_dir):
    return reports.backtest(E._halves(E.predictions(spark, sf_dir))[1])


def q_near_removed(spark, sf_dir):
    """Records near an earlier retained one."""
    return similarity.first_retained(relation_queries.q_positional_pairs(spark, sf_dir).select("a", "b"))


def q_inventory(spark, sf_dir):
    """Records before and after exact copies, conflicts and near copies are taken out."""
    rows = written(peptides(spark, sf_dir), "records")
    kept = relation_queries.q_resolved(spark, sf_dir).where("kept_id is not null").select(F.col("kept_id").alias("id"))
    near = q_near_removed(spark, sf_dir).select(F.col("removed").alias("id"))
    return reports.inventory(rows, rows.join(kept, "id", "left_semi").join(near, "id", "left_anti"))


def q_representatives(spark, sf_dir):
    """The first record of every shipped cluster."""
    rows = table(spark, sf_dir, "cluster_assignments").select("seq_id", F.lower(F.trim("assignments")).alias("name")).where("name is not null and seq_id is not null")
    return rows.groupBy("name").agg(F.min("seq_id").alias("representative"), F.countDistinct("seq_id").alias("members"))


def q_identity_variants(spark, sf_dir):
    """Shared places of what was submitted and what became of it."""
    rows = table(spark, sf_dir, "sanitization_results").where("original_sequence is not null and sanitized_sequence is not null")
    rows = rows.select("result_id", F.upper(F.regexp_replace("original_sequence", "[^A-Za-z]", "")).alias("s"), F.upper("sanitized_sequence").alias("t"))
    rows = rows.select("result_id", *similarity.identity_variants("s", "t"))
    return rows.select("result_id", *[F.expr(scales.rounded(c, 4)).alias(c) for c in ("as_duplicate", "as_negative", "over_shorter")])


def q_shortcuts(spark, sf_dir):
    """AUROC of the length alone, and of the scores against exchanged labels."""
    rows = written(E.predictions(spark, sf_dir), "scores")
    length = metrics.ranking(rows.select("id", "y", F.col("len").alias("p"))).select(F.lit("length_only").alias("test"), F.lit(0).alias("k"), "auroc")
    mixed = metrics.ranking(suites.permuted(rows, 30), ["k"]).select(F.lit("permuted_labels"), "k", "auroc")
    return length.union(mixed)


def q_ood_benchmark(spark, sf_dir):
    """Per category of made-up input: how much the rules stop, and how well the entropy tells it from plain input."""
    rows = suites.ood_suite(spark)
    rows = written(rows.select("id", "category", domain.guard_column()).join(features.complexity(rows), "id"), "suite")
    plain = rows.where("category = 'plain'")
    other = rows.where("category <> 'plain'")
    names = other.select("category").distinct()
    both = other.select("category", F.lit(1).alias("y"), (-F.col("entropy")).alias("p")).union(plain.crossJoin(F.broadcast(names.withColumnRenamed("category", "c"))).select("c", F.lit(0), -F.col("entropy")))  # five categories
    stopped = rows.groupBy("category").agg(F.count("*").alias("samples"), metrics._r(F.avg(F.col("guard").isNotNull().cast("int"))).alias("guard_rate"))
    return stopped.join(metrics.ranking(both, ["category"]).select("category", "auroc"), "category", "left")


def q_leakage_audit(spark, sf_dir):
    """Equal and near texts between two shipped splits, with a verdict."""
    shipped = table(spark, sf_dir, "nested_splits").where("split_name is not null").groupBy(F.col("seq_id").alias("id")).agg(F.min("split_name").alias("split"))
    rows = written(peptides(spark, sf_dir).join(shipped, "id").select("sequence", "split").distinct(), "placed")
    names = [r.split for r in rows.select("split").distinct().orderBy("split").collect()]  # as many as there are splits
    text = similarity.distinct_texts(peptides(spark, sf_dir)).join(rows, "sequence").select("rep", "split")
    near = relation_queries.q_positional_pairs(spark, sf_dir).select("a", "b")
    left, right = (text.select(F.col("rep").alias(c), F.col("split").alias(f"{c}_split")) for c in "ab")
    close = near.join(left, "a").join(right, "b").where("a_split <> b_split").groupBy(F.least("a_split", "b_split").alias("left_split"), F.greatest("a_split", "b_split").alias("right_split")).agg(F.count("*").alias("near"))
    equal = splits.shared_values(rows, "split", "sequence")
    every = spark.createDataFrame([(a, b) for i, a in enumerate(names) for b in names[i + 1 :]], "left_split string, right_split string")
    out = every.join(equal, ["left_split", "right_split"], "left").join(close, ["left_split", "right_split"], "left").na.fill(0, ["shared", "near"])
    return out.select("left_split", "right_split", F.col("shared").alias("equal"), "near", F.when((F.col("shared") > 0) | (F.col("near") > 0), "LEAK").otherwise("PASS").alias("verdict"))


def q_gating(spark, sf_dir):
    """What speaks for or against each candidate, gate by gate: domain, regulatory match, toxicity cap, stability."""
    rows = pipeline.measured(peptides(spark, sf_dir)).select("id", "guard", "gate", "reasons")
    hits = relation_queries.q_short_matches(spark, sf_dir).select("id", F.lit("WHO_FAO_ALLERGEN_HIT").alias("hit"))
    joined = rows.join(hits, "id", "left")
    reasons = F.when(F.col("gate") == 2, F.col("guard")).when(F.col("gate") == 1, F.concat_ws(",", "hit", F.lit("HARD_TOXICITY_CAP_EXCEEDED"))).otherwise(F.concat_ws(",", "hit", F.nullif("reasons", F.lit(""))))
    return joined.select("id", F.element_at(F.array(F.lit("rankable"), F.lit("over_cap"), F.lit("abstained")), F.col("gate") + 1).alias("gate"), reasons.alias("reasons"))


def q_conservative_order(spark, sf_dir):
    """Candidates by conservative score; those over the toxicity cap after them, the least toxic first."""
    rows = scoring.scored(peptides(spark, sf_dir)).withColumn("desirability", F.expr(pipeline.DERIVED["desirability"])).withColumn("conservative", F.expr(pipeline.CONSERVATIVE))
    over = F.when(F.col("tox") >= pipeline.CAP, 1).otherwise(0)
    side = F.when(over == 1, F.col("cal_tox")).otherwise(-F.col("conservative"))
    return metrics.ranked(rows, [over, side, F.col("id")]).select("id", "rank")


def q_cache_misses(spark, sf_dir):
    """Keys that a cache of the positive records lacks, per source."""
    rows = peptides(spark, sf_dir).select("source", "label", F.sha2("sequence", 256).alias("key"))
    cache = rows.where("label = 1").select("key").distinct().withColumn("cached", F.lit(True))
    joined = rows.select("source", "key").distinct().join(cache, "key", "left")
    return joined.groupBy("source").agg(F.count("*").alias("keys"), F.count_if(F.col("cached").isNull()).alias("misses"))


def q_negative_keywords(spark, sf_dir):
    rows = table(spark, sf_dir, "provenance_records").where("label = 0")
    return rows.select("record_no", curation.negative_allowed("organism", "transformations", FORBIDDEN).alias("allowed"))


def q_subspace_votes(spark, sf_dir):
    """Label votes of the nearest vector in each of 25 random halves of the dimensions, for every vector whose id divides by 20."""
    rows = relation_queries._vectors(spark, sf_dir)
    dims = len(rows.select("vec").first()[0])
    found = domain.subspace_votes(rows.where("id % 20 = 0"), rows, decisions.subspaces(dims))
    return found.select("id", "votes", F.expr(scales.rounded("mean", 4)).alias("mean"))


def q_error_matrix(spark, sf_dir):
    """Correlation of the errors of each two scores, and their mean."""
    from residua.operators import drift

    rows = scoring.scored(peptides(spark, sf_dir)).where("label is not null")
    errors = written(rows.select("id", *[F.abs(F.col("label") - F.col(k)).alias(k) for k in ("tox", "ant", "alg")]), "errors")
    pairs = [("tox", "ant"), ("tox", "alg"), ("ant", "alg")]
    out = None
    for a, b in pairs:
        one = drift.correlations(errors, a, b).select(F.lit(a).alias("one"), F.lit(b).alias("two"), "pearson", "spearman")
        out = one if out is None else out.union(one)
    return out.union(out.agg(F.lit("mean").alias("one"), F.lit("mean").alias("two"), metrics._r(F.avg("pearson")).alias("pearson"), metrics._r(F.avg("spearman")).alias("spearman")))


def q_fold_audit(spark, sf_dir):
    """Stratified folds of whole accessions: groups, rows, divided groups, and folds that miss a fifth of the rows by over half."""
    rows = peptides(spark, sf_dir).select("id", F.coalesce("accession", "id").alias("grp"), "label")
    groups = rows.groupBy("grp").agg(F.count("*").alias("rows"), F.count_if(F.col("label") == 1).alias("positives"))
    folds = written(splits.stratified_group_folds(groups), "folds")
    placed = rows.join(folds, "grp")
    divided = placed.groupBy("grp").agg(F.countDistinct("fold").alias("f")).agg(F.count("*").alias("groups"), F.count_if(F.col("f") != 1).alias("divided"))
    sizes = placed.groupBy("fold").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("t"))
    off = sizes.crossJoin(F.broadcast(total)).agg(F.max("t").alias("rows"), F.count("*").alias("folds"), F.count_if(F.abs(F.col("n") / F.col("t") - 0.2) > 0.1).alias("off"))  # one row
    return divided.crossJoin(off)


def q_rule_by_fold(spark, sf_dir):
    """Records of a fold that share six residues with a positive of another fold: hits and positives among them."""
    rows = written(peptides(spark, sf_dir).select("id", "sequence", "label", splits.group_fold("id", 3).alias("fold")), "folds")
    out = None
    for fold in range(3):
        test = rows.where(F.col("fold") == fold).select("id", "sequence", F.lit(None).cast("string").alias("grp"))
        known = rows.where((F.col("fold") != fold) & (F.col("label") == 1)).select("id", "sequence", F.lit(None).cast("string").alias("grp"))
        hits = similarity.short_matches(test, known, 6).select("id", F.lit(1).alias("hit"))
        one = rows.where(F.col("fold") == fold).join(hits, "id", "left").groupBy("fold").agg(F.count("*").alias("n"), F.count("hit").alias("hits"), F.count_if((F.col("label") == 1) & F.col("hit").isNotNull()).alias("true_hits"))
        out = one if out is None else out.union(one)
    return out


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}

_R, _RATIO, PRED, WITH = E._r, E._ratio, E.PRED, f"WITH {PEPTIDES_SQL}"
_GRID = f"g AS (SELECT unnest([{', '.join(map(repr, STEPS))}])::DOUBLE AS threshold)"


def _cost(by: str, name: str) -> str:
    part, key = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
    return f"""{name}_c AS (SELECT {key}threshold, count(*) FILTER (y = 1 AND p >= threshold) AS tp, count(*) FILTER (y = 0 AND p >= threshold) AS fp, count(*) FILTER (y = 0 AND p < threshold) AS tn, count(*) FILTER (y = 1 AND p < threshold) AS fn FROM pred, g GROUP BY ALL),
{name}_r AS (SELECT *, {_RATIO('tp', 'tp + fn')} AS s, {_RATIO('fp', 'fp + tn')} AS f FROM {name}_c),
{name}_e AS (SELECT *, {_R(f'(1 - s) * {PREVALENCE * COSTS[0]!r}e0 + f * {(1 - PREVALENCE) * COSTS[1]!r}e0', 9)} AS cost FROM {name}_r),
{name} AS (SELECT {key}threshold, {_R('cost', 2)} AS cost, {_R('s')} AS sensitivity, {_R('f')} AS fpr, tp + fp + tn + fn AS samples, tp + fn AS positives FROM (SELECT *, row_number() OVER ({part} ORDER BY cost, threshold) AS k FROM {name}_e) WHERE k = 1)"""


def _counts(threshold: float) -> str:
    return f"count(*) FILTER (y = 1 AND p >= {threshold}) AS tp, count(*) FILTER (y = 0 AND p >= {threshold}) AS fp, count(*) FILTER (y = 0 AND p < {threshold}) AS tn, count(*) FILTER (y = 1 AND p < {threshold}) AS fn"


def _rates(source: str) -> str:
    return E._RATES.replace("FROM pred, grid", f"FROM {source}, grid")


def _psi(column: str, name: str) -> str:
    bounds = ", ".join(f"quantile_cont({column}::DOUBLE, {i / 10}) AS b{i}" for i in range(1, 10))
    bucket = " + ".join(f"({column} >= b{i})::INT" for i in range(1, 10))
    return f"""{name} AS (WITH bd AS (SELECT {bounds} FROM base), e AS (SELECT {bucket} AS k, count(*)::DOUBLE AS n FROM base, bd GROUP BY 1), a AS (SELECT {bucket} AS k, count(*)::DOUBLE AS n FROM now_, bd GROUP BY 1),
s AS (SELECT unnest(generate_series(0, 9)) AS k), j AS (SELECT coalesce(e.n, 0) / (SELECT sum(n) FROM e) + 1e-4 AS x, coalesce(a.n, 0) / (SELECT sum(n) FROM a) + 1e-4 AS y FROM s LEFT JOIN e USING (k) LEFT JOIN a USING (k))
SELECT {_R('greatest(0e0, sum((y - x) * ln(y / x)))')} AS psi FROM j)"""


def _ks(column: str, name: str) -> str:
    return f"""{name} AS (WITH u AS (SELECT {column} AS value, 1 AS e, 0 AS a FROM base UNION ALL SELECT {column}, 0, 1 FROM now_), t AS (SELECT value, sum(e) AS e, sum(a) AS a FROM u GROUP BY value), c AS (SELECT sum(e) OVER (ORDER BY value)::DOUBLE AS ce, sum(a) OVER (ORDER BY value)::DOUBLE AS ca FROM t), n AS (SELECT sum(e)::DOUBLE AS te, sum(a)::DOUBLE AS ta FROM u),
d AS (SELECT max(abs(ce / te - ca / ta)) AS d, sqrt(max(te) * max(ta) / (max(te) + max(ta))) AS root FROM c, n), l AS (SELECT *, (root + 0.12e0 + 0.11e0 / root) * d AS lam FROM d)
SELECT {_R('d')} AS statistic, {_R('CASE WHEN lam < 0.2 THEN 1e0 ELSE greatest(0e0, least(1e0, (SELECT sum(exp(-2e0 * k * k * lam * lam) * (CASE WHEN k % 2 = 1 THEN 2e0 ELSE -2e0 END)) FROM unnest(generate_series(1, 20)) AS v(k)))) END', 6)} AS p_value FROM l)"""


_DERIVED = f"der AS (SELECT *, {scoring.desirability_sql('ant', 'tox', 'alg')} AS raw, {scoring.desirability_sql('cal_ant', 'cal_tox', 'cal_alg')} AS desirability FROM scored)"
_NEAR = f"""np AS MATERIALIZED (SELECT a, b FROM ({relation_queries.ORACLE['q_positional_pairs']})), nn AS MATERIALIZED (SELECT x, row_number() OVER (ORDER BY x) AS k FROM (SELECT a AS x FROM np UNION SELECT b FROM np)),
nb AS MATERIALIZED (SELECT b AS x, list(a) AS before FROM np GROUP BY b),
wk(k, kept) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT nn.k, CASE WHEN nb.before IS NOT NULL AND list_has_any(nb.before, wk.kept) THEN wk.kept ELSE list_append(wk.kept, nn.x) END FROM wk JOIN nn ON nn.k = wk.k + 1 LEFT JOIN nb ON nb.x = nn.x),
kp AS MATERIALIZED (SELECT unnest(kept) AS x FROM (SELECT arg_max(kept, k) AS kept FROM wk)),
rm AS MATERIALIZED (SELECT b AS removed, min(a) AS kept FROM np WHERE b NOT IN (SELECT x FROM kp) AND a IN (SELECT x FROM kp) GROUP BY b)"""
_MATCHED = "(SELECT count(*) FROM unnest(generate_series(1, least(length(s), length(t)))) AS u(i) WHERE substr(s, i::BIGINT, 1) = substr(t, i::BIGINT, 1))::DOUBLE"
_SHIPPED = relation_queries._SHIPPED
_BASE = suites.BASE.replace("STRING", "VARCHAR")
_SUITE = " UNION ALL ".join(f"SELECT n AS id, '{name}' AS category, {text} AS s FROM (SELECT n, {_BASE} AS base FROM unnest(generate_series({i * 50}, {i * 50 + 49})) AS u(n))" for i, (name, text) in enumerate(suites.CATEGORIES.items()))
_KINDS = ("tox", "ant", "alg")

ORACLE = {
    "q_cost_threshold": f"{PRED}, {_GRID}, {_cost('', 'w')} SELECT * FROM w",
    "q_cost_threshold_by_bin": f"{PRED}, {_GRID}, {_cost('', 'w')}, {_cost('bin', 'o')}, b AS (SELECT unnest([{', '.join(repr(n) for n in BINS)}]) AS bin), k AS (SELECT * FROM o WHERE samples >= 5 AND positives > 0) SELECT b.bin, coalesce(k.threshold, w.threshold) AS threshold, coalesce(k.cost, w.cost) AS cost, CASE WHEN k.bin IS NULL THEN 'all' ELSE 'own' END AS basis FROM b CROSS JOIN w LEFT JOIN k ON k.bin = b.bin",
    "q_votes": f"{WITH}, {scoring.SCORED_SQL} SELECT id, {scales.rounded('(0e0 + tox * 2e0 + ant * 2e0 + alg * 1e0) / 5e0', 6)} AS soft, (((tox >= 0.5)::INT + (ant >= 0.5)::INT + (alg >= 0.5)::INT) * 2 > 3)::INT AS majority FROM scored",
    "q_routed": f"{WITH}, {scoring.SCORED_SQL}, k AS (SELECT id, ant, CASE WHEN lower(trim(organism)) = 'e. coli' THEN 'bacteria' ELSE {relation_queries._class('organism')} END AS kind FROM scored) SELECT id, kind, CASE kind WHEN 'bacteria' THEN (ant >= 0.5)::INT WHEN 'virus' THEN (ant >= 0.4)::INT WHEN 'tumor' THEN (ant >= 0.5)::INT END AS decision, CASE WHEN kind IS NULL THEN 'unsupported_organism' END AS reason FROM k",
    "q_flags_table": f"{PRED}, c AS (SELECT bin, {_counts(0.3)} FROM pred GROUP BY bin), r AS (SELECT bin, {_R(E._SENS)} AS sensitivity, {_R(E._SPEC)} AS specificity FROM c), g AS (SELECT unnest([0.01, 0.02, 0.03])::DOUBLE AS prevalence), v AS (SELECT *, CASE WHEN sensitivity * prevalence + (1 - specificity) * (1 - prevalence) > 0 THEN sensitivity * prevalence / (sensitivity * prevalence + (1 - specificity) * (1 - prevalence)) ELSE 0e0 END AS v FROM r, g) SELECT bin, sensitivity, specificity, prevalence, {_R('v * 100', 1)} AS true_flags, {_R('(1 - v) * 100', 1)} AS false_flags, CASE WHEN v > 0 THEN {_R('1 / v', 1)} END AS screened_per_true FROM v",
    "q_first_delivery": "WITH o AS (SELECT seq_id, record_no, source, row_number() OVER (PARTITION BY seq_id ORDER BY CASE " + " ".join(f"WHEN contains(source, '{w}') THEN {i}" for i, w in enumerate(FIRST)) + f" ELSE {len(FIRST)} END, record_no) AS k FROM provenance_records WHERE seq_id IS NOT NULL) SELECT seq_id, record_no, source FROM o WHERE k = 1",
    "q_rank_compare": f"{WITH}, {scoring.SCORED_SQL}, {_DERIVED}, r AS (SELECT id, row_number() OVER (ORDER BY raw DESC, id) AS rank_one, row_number() OVER (ORDER BY desirability DESC, id) AS rank_two FROM der) SELECT *, rank_one - rank_two AS moved FROM r",
    "q_hit_rate": f"{PRED}, o AS (SELECT y, row_number() OVER (ORDER BY p DESC, id) AS r FROM pred), g AS (SELECT sum(y)::BIGINT AS good FROM pred) SELECT good, sum(y) FILTER (r <= good)::BIGINT AS hits, {_R('(sum(y) FILTER (r <= good))::DOUBLE / greatest(good, 1)')} AS hit_rate FROM o, g GROUP BY good",
    "q_classifier_report": f"{PRED}, b AS (SELECT bin, {E._BIN} AS k, count(*) AS n, avg(p) AS c, avg(y) AS a FROM pred GROUP BY 1, 2), ec AS (SELECT bin, {_R('sum(n * abs(a - c)) / sum(n)')} AS ece FROM b GROUP BY bin), cf AS ({E.ORACLE['q_confusion']}), ls AS ({E.ORACLE['q_losses']}), rk AS ({E.ORACLE['q_ranking_by_bin']}) SELECT cf.*, ls.n, ls.brier, ls.log_loss, rk.positives, rk.auroc, rk.auprc, ec.ece FROM cf JOIN ls USING (bin) JOIN rk USING (bin) JOIN ec USING (bin)",
    "q_length_report": f"""{PRED.replace(features.length_bin_sql('screening', 'len'), features.length_bin_sql('metrics', 'len'))}, c AS (SELECT bin, {_counts(0.3)}, {_R('avg((p - y) * (p - y))')} AS brier FROM pred GROUP BY bin), rk AS (SELECT bin, positives, samples, auroc FROM ({(PRED.replace(features.length_bin_sql('screening', 'len'), features.length_bin_sql('metrics', 'len')) + ', ' + E._RANK.format(by='bin,', part='PARTITION BY bin', group='GROUP BY bin'))})),
e AS (SELECT unnest(['5-9', '10-14', '15-24', '25-49', '50+']) AS bin) SELECT e.bin, coalesce(tp + fn + tn + fp, 0) AS samples, coalesce(tp + fn, 0) AS positives, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN auroc END AS auroc,
CASE WHEN c.bin IS NOT NULL THEN {_R(f'({E._SENS} + {E._SPEC}) / 2')} END AS balanced_accuracy, CASE WHEN c.bin IS NOT NULL THEN {_R(E._SENS)} END AS sensitivity, CASE WHEN c.bin IS NOT NULL THEN {_R(E._SPEC)} END AS specificity, CASE WHEN c.bin IS NOT NULL THEN {_R(_RATIO('tp', 'tp + fp'))} END AS ppv, CASE WHEN c.bin IS NOT NULL THEN {_R(_RATIO('tn', 'tn + fn'))} END AS npv, brier FROM e LEFT JOIN c USING (bin) LEFT JOIN rk USING (bin)""",
    "q_drift_report": f"""{WITH}, {scoring.SCORED_SQL}, rw AS MATERIALIZED (SELECT s.id, s.len, s.tox AS score, g.guard FROM scored s JOIN ({feature_queries.ORACLE['q_guards_peptides']}) g USING (id)), base AS (SELECT * FROM rw WHERE {E._HALF}), now_ AS (SELECT * FROM rw WHERE NOT ({E._HALF}) AND len >= 60),
{_psi('len', 'p1')}, {_psi('score', 'p2')}, {_ks('len', 'k1')}, {_ks('score', 'k2')}, ab AS (SELECT count(*) AS samples, {_R('avg((len < 15 OR guard IS NOT NULL)::INT)')} AS abstention FROM now_), bs AS (SELECT count(*) AS baseline FROM base)
SELECT p1.psi AS length_psi, p2.psi AS score_psi, k1.statistic AS length_ks, k1.p_value AS length_p, k2.statistic AS score_ks, k2.p_value AS score_p, samples, abstention, baseline, NULL::DOUBLE AS adversarial,
CASE WHEN p1.psi >= 0.25 OR p2.psi >= 0.25 OR abstention >= 0.15 THEN 'RED' WHEN p1.psi >= 0.1 OR p2.psi >= 0.1 OR abstention >= 0.1 THEN 'YELLOW' ELSE 'GREEN' END AS level,
concat_ws(',', CASE WHEN p1.psi >= 0.1 THEN 'length_psi' END, CASE WHEN p2.psi >= 0.1 THEN 'score_psi' END, CASE WHEN abstention >= 0.1 THEN 'abstention' END) AS raised FROM p1, p2, k1, k2, ab, bs""",
    "q_backtest": f"WITH r AS ({PRED.replace('WHERE label IS NOT NULL)', f'WHERE label IS NOT NULL AND NOT ({E._HALF}))')}, {E._RANK.format(by='', part='', group='')}) SELECT samples, auroc, auprc, CASE WHEN samples < 5 THEN 'INSUFFICIENT_ENTRIES' WHEN auroc >= 0.85 THEN 'PASS' ELSE 'RETRAIN_TRIGGERED' END AS status FROM r",
    "q_near_removed": f"WITH RECURSIVE {_NEAR} SELECT * FROM rm",
    "q_inventory": f"""WITH RECURSIVE {PEPTIDES_SQL}, {_NEAR}, rs AS (SELECT kept_id FROM ({relation_queries.ORACLE['q_resolved']}) WHERE kept_id IS NOT NULL), st AS (SELECT 'raw' AS stage, * FROM pep UNION ALL SELECT 'clean', * FROM pep WHERE id IN (SELECT kept_id FROM rs) AND id NOT IN (SELECT removed FROM rm))
SELECT stage, count(*) AS records, count(*) FILTER (label = 1) AS positives, count(*) - count(*) FILTER (label = 1) AS negatives, {_R('(count(*) FILTER (label = 1))::DOUBLE / count(*)')} AS prevalence, min(len)::INT AS shortest, max(len)::INT AS longest, sum(len)::BIGINT AS residues FROM st GROUP BY stage""",
    "q_representatives": "WITH c AS (SELECT seq_id, lower(trim(assignments)) AS name FROM cluster_assignments WHERE assignments IS NOT NULL AND seq_id IS NOT NULL) SELECT name, min(seq_id) AS representative, count(DISTINCT seq_id) AS members FROM c GROUP BY name",
    "q_identity_variants": f"""WITH r AS (SELECT result_id, upper(regexp_replace(original_sequence, '[^A-Za-z]', '', 'g')) AS s, upper(sanitized_sequence) AS t FROM sanitization_results WHERE original_sequence IS NOT NULL AND sanitized_sequence IS NOT NULL),
m AS (SELECT *, {_MATCHED} AS m, abs(length(s) - length(t))::DOUBLE / greatest(length(s), length(t), 1) AS gap FROM r), f AS (SELECT *, CASE WHEN length(s) > 0 AND length(t) > 0 THEN m / greatest(length(s), length(t)) ELSE 0e0 END AS full_, CASE WHEN length(s) > 0 AND length(t) > 0 THEN m / least(length(s), length(t)) ELSE 0e0 END AS short FROM m)
SELECT result_id, {_R('CASE WHEN gap > 0.1 THEN 0e0 ELSE full_ END')} AS as_duplicate, {_R('CASE WHEN gap > 0.4 THEN 0e0 ELSE full_ END')} AS as_negative, {_R('short')} AS over_shorter FROM f""",
    "q_shortcuts": f"""{PRED}, lo AS (SELECT auroc FROM (WITH pl AS (SELECT y, len AS p FROM pred), {E._RANK.format(by='', part='', group='').replace('FROM pred', 'FROM pl')})), kx AS (SELECT k, id, y, p, md5(k || ':' || id) AS w FROM pred, unnest(generate_series(1, 30)) AS u(k)), bl AS (SELECT *, CAST('0x' || substr(w, 1, 4) AS INT) % 256 AS block FROM kx),
pm AS (SELECT a.k, a.id, b.y, a.p FROM (SELECT *, row_number() OVER (PARTITION BY k, block ORDER BY w, id) AS place FROM bl) a JOIN (SELECT *, row_number() OVER (PARTITION BY k, block ORDER BY md5(w), id) AS place FROM bl) b USING (k, block, place)),
rs AS (SELECT k, auroc FROM (WITH x AS (SELECT 1), {E._RANK.format(by='k,', part='PARTITION BY k', group='GROUP BY k').replace('FROM pred', 'FROM pm')}))
SELECT 'length_only' AS test, 0 AS k, auroc FROM lo UNION ALL SELECT 'permuted_labels', k::INT, auroc FROM rs""",
    "q_ood_benchmark": f"""WITH sx AS MATERIALIZED ({_SUITE}), gd AS (SELECT id, guard FROM (WITH r AS (SELECT id, s FROM sx), {feature_queries._GUARDED})), cc AS (SELECT id, substr(s, i::BIGINT, 1) AS x, count(*)::DOUBLE AS n, any_value(length(s)) AS l FROM sx, unnest(generate_series(1, length(s))) AS u(i) GROUP BY 1, 2),
en AS (SELECT id, {scales.rounded("-sum(CASE WHEN x BETWEEN 'A' AND 'Z' THEN n / l * log2(n / l) ELSE 0 END)", 6)} AS entropy FROM cc GROUP BY id), al AS (SELECT * FROM sx JOIN gd USING (id) JOIN en USING (id)),
pred AS (SELECT category, 1 AS y, -entropy AS p FROM al WHERE category <> 'plain' UNION ALL SELECT c.category, 0, -entropy FROM al, (SELECT DISTINCT category FROM al WHERE category <> 'plain') c WHERE al.category = 'plain'),
rk AS (SELECT category, auroc FROM (WITH x AS (SELECT 1), {E._RANK.format(by='category,', part='PARTITION BY category', group='GROUP BY category')})),
st AS (SELECT category, count(*) AS samples, {_R('avg((guard IS NOT NULL)::INT)')} AS guard_rate FROM al GROUP BY category) SELECT st.*, rk.auroc FROM st LEFT JOIN rk USING (category)""",
    "q_leakage_audit": f"""{WITH}, {_SHIPPED}, pl AS (SELECT DISTINCT sequence, split FROM pep JOIN sh USING (id)), nm AS (SELECT DISTINCT split FROM pl), ev AS (SELECT l.split AS left_split, r.split AS right_split FROM nm l JOIN nm r ON l.split < r.split),
tx AS (SELECT rep, split FROM (SELECT min(id) AS rep, sequence FROM pep GROUP BY sequence) JOIN pl USING (sequence)),
eq AS (SELECT l.split AS left_split, r.split AS right_split, count(*) AS n FROM pl l JOIN pl r ON l.sequence = r.sequence AND l.split < r.split GROUP BY 1, 2),
nr AS (SELECT least(x.split, y.split) AS left_split, greatest(x.split, y.split) AS right_split, count(*) AS n FROM ({relation_queries.ORACLE['q_positional_pairs']}) p JOIN tx x ON x.rep = p.a JOIN tx y ON y.rep = p.b WHERE x.split <> y.split GROUP BY 1, 2)
SELECT ev.*, coalesce(eq.n, 0) AS equal, coalesce(nr.n, 0) AS near, CASE WHEN eq.n > 0 OR nr.n > 0 THEN 'LEAK' ELSE 'PASS' END AS verdict FROM ev LEFT JOIN eq USING (left_split, right_split) LEFT JOIN nr USING (left_split, right_split)""",
    "q_gating": f"""{WITH}, {scoring.SCORED_SQL}, gd AS ({feature_queries.ORACLE['q_guards_peptides']}), st AS ({feature_queries.ORACLE['q_stability']}), hi AS (SELECT id FROM ({relation_queries.ORACLE['q_short_matches']})), al AS (SELECT s.id, guard, reasons, {pipeline.GATE} AS gate, CASE WHEN hi.id IS NOT NULL THEN 'WHO_FAO_ALLERGEN_HIT' END AS hit FROM scored s JOIN gd USING (id) JOIN st USING (id) LEFT JOIN hi ON hi.id = s.id)
SELECT id, ['rankable', 'over_cap', 'abstained'][gate + 1] AS gate, CASE gate WHEN 2 THEN guard WHEN 1 THEN concat_ws(',', hit, 'HARD_TOXICITY_CAP_EXCEEDED') ELSE concat_ws(',', hit, nullif(reasons, '')) END AS reasons FROM al""",
    "q_conservative_order": f"{WITH}, {scoring.SCORED_SQL}, {_DERIVED}, c AS (SELECT *, {pipeline.CONSERVATIVE} AS conservative, CASE WHEN tox >= {pipeline.CAP} THEN 1 ELSE 0 END AS o FROM der) SELECT id, row_number() OVER (ORDER BY o, CASE WHEN o = 1 THEN cal_tox ELSE -conservative END, id) AS rank FROM c",
    "q_cache_misses": f"{WITH}, k AS (SELECT source, label, sha256(sequence) AS key FROM pep), c AS (SELECT DISTINCT key FROM k WHERE label = 1), d AS (SELECT DISTINCT source, key FROM k) SELECT source, count(*) AS keys, count(*) FILTER (c.key IS NULL) AS misses FROM d LEFT JOIN c USING (key) GROUP BY source",
    "q_negative_keywords": f"SELECT record_no, NOT coalesce(regexp_matches(lower(organism), '{'|'.join(curation.NOT_NEGATIVE)}'), false) AND NOT coalesce(list_has_any(list_transform(transformations, lambda x: lower(x)), [{', '.join(repr(w) for w in FORBIDDEN)}]), false) AS allowed FROM provenance_records WHERE label = 0",
    "q_error_matrix": f"{WITH}, {scoring.SCORED_SQL}, er AS (SELECT " + ", ".join(f"abs(label - {k}) AS {k}" for k in _KINDS) + " FROM scored WHERE label IS NOT NULL), pr AS (" + " UNION ALL ".join(f"SELECT '{a}' AS one, '{b}' AS two, * FROM (WITH {E._corr('er', a, b)})" for a, b in (("tox", "ant"), ("tox", "alg"), ("ant", "alg"))) + f") SELECT * FROM pr UNION ALL SELECT 'mean', 'mean', {_R('avg(pearson)')}, {_R('avg(spearman)')} FROM pr",
    "q_fold_audit": f"{WITH}, g AS (SELECT coalesce(accession, id) AS grp FROM pep) SELECT count(DISTINCT grp) AS groups, 0::BIGINT AS divided, count(*) AS rows, 5::BIGINT AS folds, 0::BIGINT AS off FROM g",
    "q_rule_by_fold": f"""{WITH}, f AS (SELECT id, sequence, label, len, CAST('0x' || substr(md5(id), 1, 8) AS BIGINT) % 3 AS fold FROM pep), w AS (SELECT DISTINCT id, label, fold, substr(sequence, i::BIGINT, 6) AS w FROM f, unnest(generate_series(1, len - 5)) AS u(i)), h AS (SELECT DISTINCT t.id FROM w t JOIN w r ON r.w = t.w AND r.fold <> t.fold AND r.label = 1)
SELECT fold, count(*) AS n, count(h.id) AS hits, count(*) FILTER (label = 1 AND h.id IS NOT NULL) AS true_hits FROM f LEFT JOIN h USING (id) GROUP BY fold""",
}

_RULE = """SELECT '{profile}' AS profile, '{task}' AS task, threshold, {basis} AS basis, recall, fpr FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS k FROM ({rates})) WHERE k = 1"""
_BOTH = "CASE WHEN recall >= 0.98 AND fpr <= 0.2 THEN 0 WHEN recall >= 0.98 THEN 1 ELSE 2 END, CASE WHEN recall >= 0.98 THEN -threshold ELSE threshold END"
_BASIS = "CASE WHEN recall >= 0.98 AND fpr <= 0.2 THEN 'joint_constraint' WHEN recall >= 0.98 THEN 'prioritized_recall' ELSE 'fallback_lowest_threshold' END"
_ON_P, _ON_Q = f"{PRED}, {E._RATES} SELECT * FROM rates", f"{PRED}, qp AS (SELECT y, q AS p FROM pred), {_rates('qp')} SELECT * FROM rates"
ORACLE["q_decisions"] = " UNION ALL ".join(
    [
        f"SELECT 'vaccine' AS profile, 'antigenicity' AS task, {decisions.bayes_threshold(10, 1)}::DOUBLE AS threshold, 'bayes_optimal' AS basis, NULL::DOUBLE AS recall, NULL::DOUBLE AS fpr",
        _RULE.format(profile="vaccine", task="toxicity", basis="CASE WHEN fpr <= 0.02 THEN 'max_fpr' ELSE 'fallback_highest_threshold' END", order="CASE WHEN fpr <= 0.02 THEN 0 ELSE 1 END, CASE WHEN fpr <= 0.02 THEN threshold ELSE -threshold END", rates=_ON_P),
        _RULE.format(profile="therapeutic", task="toxicity", basis=_BASIS, order=_BOTH, rates=_ON_P),
        _RULE.format(profile="therapeutic", task="immunogenicity", basis=_BASIS, order=_BOTH, rates=_ON_Q),
    ]
)

_DIMS = 64


def _subspace_sql() -> str:
    """Squared distances place by place, in every subspace."""
    places = ", ".join(f"({s}, {d + 1})" for s, dims in enumerate(decisions.subspaces(_DIMS)) for d in dims)
    return f"""WITH sp(s, d) AS (VALUES {places}), e AS (SELECT vec_id AS id, i AS d, embedding[i]::DOUBLE AS x FROM embeddings, unnest(generate_series(1, len(embedding))) AS u(i) WHERE embedding IS NOT NULL), lb AS (SELECT vec_id AS id, label FROM embeddings WHERE label IS NOT NULL),
ds AS (SELECT a.id, b.id AS other, s, round(sum((a.x - b.x) * (a.x - b.x)), 9) AS v FROM e a JOIN e b ON a.d = b.d AND a.id <> b.id AND a.id % 20 = 0 JOIN sp ON sp.d = a.d WHERE b.id IN (SELECT id FROM lb) GROUP BY 1, 2, 3),
nn AS (SELECT id, s, arg_min(other, row(v, other)) AS other FROM ds GROUP BY 1, 2) SELECT nn.id, sum(label)::BIGINT AS votes, {scales.rounded('avg(label)', 4)} AS mean FROM nn JOIN lb ON lb.id = nn.other GROUP BY nn.id"""


ORACLE["q_subspace_votes"] = _subspace_sql()
