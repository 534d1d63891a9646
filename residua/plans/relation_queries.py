"""Queries that relate rows: duplicates, homology, regulatory matches, ranking, splits, windows, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residua.functions import features, scales, scoring
from residua.operators import curation, domain, graph, metrics, models, pareto, similarity, splits
from residua.plans.ranking_sql import crowding_sql, fronts_sql
from residua.session import written
from residua.sources.tables import PEPTIDES_SQL, peptides, table
from residua.streaming import windows

WITH = f"WITH {PEPTIDES_SQL}"
OBJECTIVES = ["ant", "safe_tox", "safe_alg"]


def _graded(spark, sf_dir) -> DataFrame:
    evidence = table(spark, sf_dir, "provenance_records").groupBy(F.col("seq_id").alias("id")).agg(F.min("label_evidence").alias("label_evidence"))
    return peptides(spark, sf_dir).join(evidence, "id")


def q_resolved(spark, sf_dir):
    return curation.resolved(_graded(spark, sf_dir))


def q_resolved_log(spark, sf_dir):
    return curation.resolved_in_order(_graded(spark, sf_dir).withColumn("ord", F.col("id"))).groupBy("reason").agg(F.count("*").alias("n"))


def q_positional_pairs(spark, sf_dir):
    return similarity.positional_pairs(peptides(spark, sf_dir), 0.95)


def _homologous(spark, sf_dir):
    return similarity.jaccard_pairs(peptides(spark, sf_dir), 3, (7, 20))


def q_jaccard_pairs(spark, sf_dir):
    return _homologous(spark, sf_dir).select("a", "b", "common", "either")


def q_homology_clusters(spark, sf_dir):
    """Clusters of all records by window similarity of 0.35, copies included; ``q_family_clusters`` goes by the whole rule."""
    rows = written(peptides(spark, sf_dir).select("id", "sequence"), "rows")
    rep = similarity.distinct_texts(rows)
    copies = rows.join(rep, "sequence").where("id <> rep").select("id", "rep")
    edges = similarity.jaccard_pairs(rows, 3, (7, 20)).select("a", "b").union(copies)
    return graph.named(graph.connected(edges), rows)


def q_family_clusters(spark, sf_dir):
    """Clusters of all records by the whole homology rule, copies included."""
    rows = written(peptides(spark, sf_dir).select("id", "sequence"), "rows")
    rep = similarity.distinct_texts(rows)
    copies = rows.join(rep, "sequence").where("id <> rep").select("id", "rep")
    return graph.named(graph.connected(similarity.families(rows).union(copies)), rows)


def q_family_rule(spark, sf_dir):
    """The homology rule on all pairs of texts with a fifth of their windows in common; ``q_family_pairs`` is the whole rule."""
    pairs = similarity.jaccard_pairs(peptides(spark, sf_dir), 3, (1, 5), texts=True)
    return pairs.select("a", "b", similarity.same_family("s_a", "s_b", "common", "either").alias("same"))


def q_family_pairs(spark, sf_dir):
    """All pairs of texts that the homology rule puts together, with or without common windows."""
    return similarity.families(peptides(spark, sf_dir))


def q_alignment_identity(spark, sf_dir):
    """Global alignment identity of all pairs with a fifth of their windows in common, and whether the alignment rule puts them together."""
    rows = peptides(spark, sf_dir)
    pairs = similarity.jaccard_pairs(rows, 3, (1, 5))
    text = similarity.distinct_texts(rows)
    both = pairs.join(text.select(F.col("rep").alias("a"), F.col("sequence").alias("s_a")), "a").join(text.select(F.col("rep").alias("b"), F.col("sequence").alias("s_b")), "b")
    scored = similarity.scored_pairs(both.select("a", "b", "s_a", "s_b", "common", "either").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a", "b"))
    shorter, longer = F.least(F.length("s_a"), F.length("s_b")), F.greatest(F.length("s_a"), F.length("s_b"))
    same = ((shorter / longer >= 0.4) & (F.col("score") >= 0.40)) | ((longer < 20) & (F.col("common") / F.col("either") >= 0.25))
    return scored.select("a", "b", F.col("score").alias("identity"), same.alias("same"))


def q_short_matches(spark, sf_dir):
    """First window of six residues that a reference allergen of another accession holds."""
    rows = peptides(spark, sf_dir).select("id", "sequence", F.col("accession").alias("grp"), "label", "source")
    reference = rows.where("label = 1 and source like '%allergen%'")
    return similarity.short_matches(rows, reference, 6)


def _objectives(spark, sf_dir) -> DataFrame:
    rows = scoring.scored(peptides(spark, sf_dir))
    return rows.select("id", "ant", "tox", "alg", F.expr(scales.rounded("1e0 - tox", 3)).alias("safe_tox"), F.expr(scales.rounded("1e0 - alg", 3)).alias("safe_alg"))


def q_front_zero(spark, sf_dir):
    return pareto.front_zero(_objectives(spark, sf_dir), OBJECTIVES).select("id", *OBJECTIVES)


def q_dominance(spark, sf_dir):
    return pareto.dominance_counts(_objectives(spark, sf_dir), OBJECTIVES, 0.0205).select("id", "dominated_by")


def _fronts(spark, sf_dir):
    return pareto.fronts(_objectives(spark, sf_dir), OBJECTIVES)


def q_fronts(spark, sf_dir):
    return _fronts(spark, sf_dir).select("id", "front")


def q_pareto_rank(spark, sf_dir):
    """Order of all candidates: front, crowding, toxicity, id; those over the toxicity cap come last."""
    rows = pareto.crowding(written(_fronts(spark, sf_dir), "fronts"), OBJECTIVES)
    capped = F.when(F.col("tox") >= 0.5, 1).otherwise(0)
    ordered = metrics.ranked(rows, [capped, F.col("front").asc_nulls_last(), F.col("crowding").desc_nulls_last(), F.col("tox"), F.col("id")])
    return ordered.select("id", "front", F.when(F.col("crowding") < float("inf"), F.expr(scales.rounded("crowding", 6))).alias("crowding"), "rank")


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def q_nearest(spark, sf_dir):
    """Five most similar vectors, for every vector whose id divides by 20, against all vectors."""
    rows = _vectors(spark, sf_dir)
    found = domain.nearest(rows.where("id % 20 = 0"), rows)
    return found.select("id", "rank", F.expr("floor(cosine * 10000 + 0.5D) / 10000").alias("cosine"))


def q_knn_distance(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    found = domain.nearest(rows.where("id % 20 = 0"), rows)
    return found.groupBy("id").agg(F.avg(1 - F.col("cosine")).alias("d")).select("id", F.expr("floor(d * 1000 + 0.5D) / 1000").alias("distance"))


def q_centroids(spark, sf_dir):
    rows = domain.class_centroids(_vectors(spark, sf_dir))
    return rows.select("label", F.col("dim").cast("int").alias("dim"), F.expr("floor(mean * 10000 + 0.5D) / 10000").alias("mean"), "n")


def q_mahalanobis(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    means, cov = domain.shrunk_covariance(rows)
    return domain.mahalanobis(rows, means, cov).select("id", F.round("distance", 4).alias("distance"))


def q_split_overlap(spark, sf_dir):
    """Exact texts that two shipped splits have in common."""
    shipped = table(spark, sf_dir, "nested_splits").where("split_name is not null").groupBy(F.col("seq_id").alias("id")).agg(F.min("split_name").alias("split"))
    return splits.shared_values(peptides(spark, sf_dir).join(shipped, "id"), "split", "sequence")


def q_accession_overlap(spark, sf_dir):
    shipped = table(spark, sf_dir, "nested_splits").where("split_name is not null").groupBy(F.col("seq_id").alias("id")).agg(F.min("split_name").alias("split"))
    return splits.shared_values(peptides(spark, sf_dir).join(shipped, "id"), "split", "accession")


def q_group_folds(spark, sf_dir):
    rows = peptides(spark, sf_dir).withColumn("grp", F.coalesce("accession", "id"))
    return splits.nested(rows, "grp").groupBy("fold", "partition").agg(F.count("*").alias("n"), F.countDistinct("grp").alias("groups"))


def q_removals(spark, sf_dir):
    log = table(spark, sf_dir, "removal_log")
    return log.groupBy("removal_reason").agg(F.count("*").alias("n"), F.countDistinct("seq_id").alias("records"), F.count("similarity").alias("with_similarity"), F.max("sequence_length").alias("longest"))


def q_provenance_valid(spark, sf_dir):
    """Records that lack a required field, by field."""
    rows = table(spark, sf_dir, "provenance_records")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return rows.agg(*[F.count_if(blank(c)).alias(f"no_{c}") for c in ("seq_id", "sequence", "source", "accession", "license", "label_evidence", "organism")], F.count_if(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).alias("bad_label"), F.count("*").alias("n"))


def q_organism_classes(spark, sf_dir):
    rows = peptides(spark, sf_dir).select("id", curation.organism_class("organism").alias("organism_class"), curation.organism_class("source").alias("source_class"))
    return rows.groupBy("organism_class", "source_class").agg(F.count("*").alias("n"))


def q_negative_allowed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", curation.negative_allowed("text").alias("allowed"))


def q_length_matched(spark, sf_dir):
    rows = peptides(spark, sf_dir)
    return similarity.length_matched(rows.where("label = 1"), rows.where("label = 0"))


def q_length_match_audit(spark, sf_dir):
    """Positives, candidates, and what no match may be: a candidate twice, lengths too far apart, places too much alike."""
    rows = written(peptides(spark, sf_dir).where("label is not null").select("id", "sequence", "label"), "labelled")
    met = written(similarity.length_matched(rows.where("label = 1"), rows.where("label = 0")), "matched")
    sizes = rows.agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("candidates"))
    one, two = (rows.select(F.col("id").alias(k), F.col("sequence").alias(v)) for k, v in (("id", "s"), ("negative_id", "t")))
    both = met.join(one, "id").join(two, "negative_id").withColumn("same", similarity.positional_identity("s", "t"))
    gap = F.abs(F.length("s") - F.length("t")) / F.greatest(F.length("s"), F.length("t"))
    bad = both.agg((F.count("*") - F.countDistinct("negative_id")).alias("twice"), F.count_if(gap > 0.15).alias("too_far"), F.count_if(F.col("same") >= 0.30).alias("too_alike"))
    return sizes.crossJoin(bad)  # one row each


def q_tumbling(spark, sf_dir):
    return windows.tumbling(table(spark, sf_dir, "events"))


def q_sliding(spark, sf_dir):
    return windows.sliding(table(spark, sf_dir, "events"))


def q_sessions(spark, sf_dir):
    rows = windows.sessions(table(spark, sf_dir, "events"))
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def q_red_runs(spark, sf_dir):
    """Runs of three or more days in a row on which the daily mean is above the overall mean."""
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("s"), F.count("value").alias("c"))
    mean = days.agg((F.sum("s") / F.sum("c")).alias("m"))
    red = days.crossJoin(F.broadcast(mean)).where("s / c > m").select("day")  # one row
    island = F.date_sub("day", F.row_number().over(Window.orderBy("day")))  # one row per day of the stream
    return red.withColumn("k", island).groupBy("k").agg(F.min("day").alias("first_day"), F.count("*").alias("days")).where("days >= 3").select("first_day", "days")


def _training(spark, sf_dir) -> DataFrame:
    rows = peptides(spark, sf_dir).where("label is not null")
    return rows.select("id", F.col("label").alias("y"), features.aac_vector().alias("vec"), splits.group_fold("accession", 3).alias("own")).withColumn("fold", F.coalesce("own", F.lit(0))).drop("own")


def q_sigmoid_fit(spark, sf_dir):
    rows = written(scoring.scored(peptides(spark, sf_dir)).select("id", F.col("label").alias("y"), F.col("tox").alias("p")), "scores")
    coef, intercept = models.sigmoid_fit(rows)
    return metrics.losses(rows.withColumn("p", models.sigmoid_apply("p", coef, intercept)))


def q_isotonic_fit(spark, sf_dir):
    rows = written(scoring.scored(peptides(spark, sf_dir)).select("id", F.col("label").alias("y"), F.col("tox").alias("p")), "scores")
    return models.isotonic(rows).select("boundary", F.expr(scales.rounded("prediction", 6)).alias("prediction"))


TEMPERATURES = [0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0]


def q_temperature(spark, sf_dir):
    rows = scoring.scored(peptides(spark, sf_dir)).select("id", F.col("label").alias("y"), F.col("tox").alias("p"))
    return models.temperature(rows, TEMPERATURES)


def q_forest_oof(spark, sf_dir):
    return metrics.ranking(models.out_of_fold(_training(spark, sf_dir), models.forest(10, 5)))


def q_shift_auroc(spark, sf_dir):
    rows = peptides(spark, sf_dir).select("id", features.aac_vector().alias("vec"), "source")
    return metrics.ranking(models.shifted(rows.where("source like '%toxin%'"), rows.where("source not like '%toxin%'")))


def q_hybrid(spark, sf_dir):
    """Allergenicity score with the floor that a regulatory short match sets, and what decided."""
    hits = q_short_matches(spark, sf_dir).select("id", F.lit(True).alias("hit"))
    rows = scoring.scored(peptides(spark, sf_dir)).select("id", "alg").join(hits, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    score = F.when(F.col("hit"), F.greatest("alg", F.lit(0.85))).otherwise(F.col("alg"))
    tier = F.when(F.col("hit"), "high_risk").when(F.col("alg") >= 0.5, "moderate_risk").otherwise("low_risk")
    return rows.select("id", "hit", score.alias("hazard"), tier.alias("tier"), F.when(F.col("hit"), "who_fao_short_match").otherwise("ml_only").alias("basis"))


def q_review_sample(spark, sf_dir):
    """The 15 highest toxicity scores and a sample of two fifths as many of the others, by digest."""
    rows = metrics.ranked(scoring.scored(peptides(spark, sf_dir)).select("id", "tox"), [F.desc("tox"), F.col("id")])
    rows = written(rows, "ranked")
    top = rows.where("rank <= 15").select("id", F.lit("lead").alias("stratum"))
    rest = rows.where("rank > 15").orderBy(F.md5("id"), "id").limit(6).select("id", F.lit("sample"))
    return top.union(rest)


def q_temporal_split(spark, sf_dir):
    """Records and positives before and from the median year of deposit, per side; unknown years apart."""
    rows = table(spark, sf_dir, "provenance_records").where("seq_id is not null").groupBy("seq_id").agg(F.max("label").alias("label"), F.min("deposit_date").alias("d"))
    rows = rows.withColumn("year", F.expr("try_cast(nullif(regexp_extract(d, '((19|20)[0-9]{2})', 1), '') AS INT)"))
    middle = rows.agg(F.expr("floor(percentile(year, 0.5))").alias("m"))
    side = F.when(F.col("year").isNull(), "unknown").when(F.col("year") < F.col("m"), "before").otherwise("from")
    return rows.crossJoin(F.broadcast(middle)).groupBy(side.alias("side")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positives"), F.coalesce(F.min("year"), F.lit(0)).alias("first_year"), F.coalesce(F.max("year"), F.lit(0)).alias("last_year"))  # one row


def q_pooled(spark, sf_dir):
    rows = features.pooled(_vectors(spark, sf_dir), ["label"])
    return rows.select("label", F.col("dim").cast("int").alias("dim"), F.expr("floor(mean * 10000 + 0.5D) / 10000").alias("mean"), F.col("max").cast("double").alias("highest"))


def q_quantised_parity(spark, sf_dir):
    """Cosine of each vector with its quantised form."""
    rows = _vectors(spark, sf_dir).withColumn("q", features.quantised("vec"))
    return rows.select("id", features.cosine("vec", "q").alias("c")).select("id", F.expr("floor(c * 10000 + 0.5D) / 10000").alias("cosine"))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}

_EV = "CASE label_evidence " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in curation.EVIDENCE.items()) + " ELSE 10 END"
_GRADED = f"{WITH}, ev AS (SELECT seq_id AS id, min(label_evidence) AS label_evidence FROM provenance_records GROUP BY seq_id), g AS (SELECT id, sequence, coalesce(label, 0) AS label, {_EV} AS e FROM pep JOIN ev USING (id))"
_TXT = "txt AS (SELECT min(id) AS rep, sequence FROM pep GROUP BY sequence)"
_J3 = f"""{_TXT}, gram AS (SELECT DISTINCT rep, substr(sequence, i::BIGINT, 3) AS w FROM txt, unnest(generate_series(1, length(sequence) - 2)) AS u(i)),
sz AS (SELECT rep, count(*) AS n FROM gram GROUP BY rep),
hit AS (SELECT x.rep AS a, y.rep AS b, count(*) AS common FROM gram x JOIN gram y ON x.w = y.w AND x.rep < y.rep GROUP BY 1, 2),
j AS (SELECT a, b, common::INT AS common, (p.n + q.n - common)::INT AS either FROM hit JOIN sz p ON p.rep = a JOIN sz q ON q.rep = b)"""
_OBJ = f"""{WITH}, {scoring.SCORED_SQL}, ob AS (SELECT id, ant, {scales.rounded('1e0 - tox', 3)} AS safe_tox, {scales.rounded('1e0 - alg', 3)} AS safe_alg FROM scored)"""
_VEC = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v), c AS (SELECT a.id, b.id AS other, round(list_dot_product(a.u, b.u), 9) AS cosine FROM n a JOIN n b ON a.id % 20 = 0 AND a.id <> b.id), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) AS rank FROM c)"
_SHIPPED = "sh AS (SELECT seq_id AS id, min(split_name) AS split FROM nested_splits WHERE split_name IS NOT NULL GROUP BY seq_id)"
_LR = "greatest(length(a.sequence), length(b.sequence))"


def _common(value: str) -> str:
    return f"{WITH}, {_SHIPPED}, x AS (SELECT DISTINCT split, {value} AS v FROM pep JOIN sh USING (id) WHERE {value} IS NOT NULL) SELECT l.split AS left_split, r.split AS right_split, count(*) AS shared FROM x l JOIN x r ON l.v = r.v AND l.split < r.split GROUP BY 1, 2"


def _class(column: str) -> str:
    return f"CASE WHEN lower({column}) LIKE '%bacter%' THEN 'bacteria' WHEN lower({column}) LIKE '%vir%' THEN 'virus' WHEN lower({column}) LIKE '%tumor%' OR lower({column}) LIKE '%cancer%' THEN 'tumor' END"


ORACLE = {
    "q_resolved": f"{_GRADED}, t AS (SELECT sequence, max(e) AS top FROM g GROUP BY sequence) SELECT g.sequence, CASE WHEN count(DISTINCT label) FILTER (e = top) < 2 THEN min(id) FILTER (e = top) END AS kept_id, count(*) AS members, count(DISTINCT label) FILTER (e = top) > 1 AS conflict FROM g JOIN t USING (sequence) GROUP BY g.sequence",
    "q_positional_pairs": f"""{WITH}, {_TXT}, c AS (SELECT a.rep AS a, b.rep AS b, a.sequence AS s, b.sequence AS t FROM txt a JOIN txt b ON a.rep < b.rep AND least(length(a.sequence), length(b.sequence)) >= 0.95 * {_LR} AND {_LR} >= 20),
m AS (SELECT a, b, count(*) FILTER (substr(s, i::BIGINT, 1) = substr(t, i::BIGINT, 1))::DOUBLE / any_value(greatest(length(s), length(t))) AS v FROM c, unnest(generate_series(1, least(length(s), length(t)))) AS u(i) GROUP BY a, b)
SELECT a, b, {scales.rounded('v', 4)} AS identity FROM m WHERE v >= 0.95""",
    "q_jaccard_pairs": f"{WITH}, {_J3} SELECT * FROM j WHERE 20 * common >= 7 * either",
    "q_family_rule": f"{WITH}, {_J3} SELECT j.a, j.b, CASE WHEN {_LR} > 30 AND least(length(a.sequence), length(b.sequence))::DOUBLE / {_LR} < 0.4 THEN false WHEN {_LR} < 30 THEN levenshtein(a.sequence, b.sequence)::DOUBLE / {_LR} <= 1 - 0.35 OR common::DOUBLE / either >= 0.30 ELSE common::DOUBLE / either >= 0.35 OR (common::DOUBLE / either >= 0.20 AND {_LR} <= 120 AND 1 - levenshtein(a.sequence, b.sequence)::DOUBLE / {_LR} >= 0.35) END AS same FROM j JOIN txt a ON a.rep = j.a JOIN txt b ON b.rep = j.b WHERE 5 * common >= either",
    "q_homology_clusters": f"""{WITH.replace('WITH', 'WITH RECURSIVE', 1)}, {_J3}, ed AS (SELECT a, b FROM j WHERE 20 * common >= 7 * either), ln AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
rc(a, b) AS (SELECT rep, rep FROM txt UNION SELECT r.a, l.b FROM rc r JOIN ln l ON l.a = r.b), lb AS (SELECT a, min(b) AS root FROM rc GROUP BY a),
pl AS (SELECT p.id, lb.root FROM pep p JOIN txt t USING (sequence) JOIN lb ON lb.a = t.rep), sz2 AS (SELECT root, count(*) AS size, min(id) AS first_id FROM pl GROUP BY root),
nm AS (SELECT root, size, row_number() OVER (ORDER BY size DESC, first_id) - 1 AS k FROM sz2) SELECT pl.id, printf('cluster_%04d', k) AS cluster_id, size FROM pl JOIN nm USING (root)""",
    "q_short_matches": f"""{WITH}, q AS (SELECT id, accession AS grp, i AS pos, substr(sequence, i::BIGINT, 6) AS w FROM pep, unnest(generate_series(1, len - 5)) AS u(i)),
r AS (SELECT DISTINCT p.id AS rid, p.accession AS rgrp, substr(p.sequence, i::BIGINT, 6) AS w FROM pep p, unnest(generate_series(1, p.len - 5)) AS u(i) WHERE p.label = 1 AND p.source LIKE '%allergen%'),
h AS (SELECT q.id, q.w AS kmer, q.pos, r.rid, row_number() OVER (PARTITION BY q.id ORDER BY q.pos, r.rid) AS k FROM q JOIN r ON r.w = q.w AND r.rid <> q.id AND NOT coalesce(r.rgrp = q.grp, false))
SELECT id, kmer, pos::INT AS position, rid AS reference_id FROM h WHERE k = 1""",
    "q_review_sample": f"{WITH}, {scoring.SCORED_SQL}, o AS (SELECT id, row_number() OVER (ORDER BY tox DESC, id) AS r FROM scored), s AS (SELECT id, row_number() OVER (ORDER BY md5(id), id) AS k FROM o WHERE r > 15) SELECT id, 'lead' AS stratum FROM o WHERE r <= 15 UNION ALL SELECT id, 'sample' FROM s WHERE k <= 6",
    "q_temporal_split": "WITH p AS (SELECT seq_id, max(label) AS label, min(deposit_date) AS d FROM provenance_records WHERE seq_id IS NOT NULL GROUP BY 1), y AS (SELECT *, TRY_CAST(nullif(regexp_extract(d, '((19|20)[0-9]{2})', 1), '') AS INT) AS year FROM p), m AS (SELECT floor(quantile_cont(year, 0.5)) AS m FROM y) SELECT CASE WHEN year IS NULL THEN 'unknown' WHEN year < m THEN 'before' ELSE 'from' END AS side, count(*) AS n, count(*) FILTER (label = 1) AS positives, coalesce(min(year), 0) AS first_year, coalesce(max(year), 0) AS last_year FROM y, m GROUP BY 1",
    "q_pooled": "WITH p AS (SELECT label, (i - 1)::INT AS dim, embedding[i]::DOUBLE AS x FROM embeddings, unnest(generate_series(1, len(embedding))) AS u(i)), g AS (SELECT label, dim, avg(x) AS mean, max(x) AS highest FROM p GROUP BY 1, 2) SELECT label, dim, floor(mean * 10000 + 0.5) / 10000 AS mean, highest FROM g",
    "q_quantised_parity": "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT id, e, list_max(list_transform(e, lambda x: abs(x))) / 127 AS st FROM v), q AS (SELECT id, e, list_transform(e, lambda x: floor(x / st + 0.5) * st) AS q FROM s), c AS (SELECT id, list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) AS c FROM q) SELECT id, floor(c * 10000 + 0.5) / 10000 AS cosine FROM c",
    "q_front_zero": f"{_OBJ} SELECT * FROM ob b WHERE NOT EXISTS (SELECT 1 FROM ob a WHERE a.ant >= b.ant AND a.safe_tox >= b.safe_tox AND a.safe_alg >= b.safe_alg AND (a.ant > b.ant OR a.safe_tox > b.safe_tox OR a.safe_alg > b.safe_alg))",
    "q_dominance": f"{_OBJ} SELECT b.id, count(a.id) AS dominated_by FROM ob b LEFT JOIN ob a ON a.ant - b.ant >= -0.0205 AND a.safe_tox - b.safe_tox >= -0.0205 AND a.safe_alg - b.safe_alg >= -0.0205 AND (a.ant - b.ant > 0.0205 OR a.safe_tox - b.safe_tox > 0.0205 OR a.safe_alg - b.safe_alg > 0.0205) GROUP BY b.id",
    "q_nearest": f"WITH {_VEC} SELECT id, rank::INT AS rank, floor(cosine * 10000 + 0.5) / 10000 AS cosine FROM k WHERE rank <= 5",
    "q_knn_distance": f"WITH {_VEC}, d AS (SELECT id, avg(1 - cosine) AS d FROM k WHERE rank <= 5 GROUP BY id) SELECT id, floor(d * 1000 + 0.5) / 1000 AS distance FROM d",
    "q_centroids": "WITH p AS (SELECT label, i - 1 AS dim, embedding[i]::DOUBLE AS x FROM embeddings, unnest(generate_series(1, len(embedding))) AS u(i)), m AS (SELECT label, dim::INT AS dim, round(avg(x), 6) AS mean, count(*) AS n FROM p GROUP BY 1, 2) SELECT label, dim, floor(mean * 10000 + 0.5) / 10000 AS mean, n FROM m",
    "q_split_overlap": _common("sequence"),
    "q_accession_overlap": _common("accession"),
    "q_group_folds": f"""{WITH}, x AS (SELECT id, coalesce(accession, id) AS grp FROM pep), y AS (SELECT *, CAST('0x' || substr(md5(grp), 1, 8) AS BIGINT) % 5 AS own FROM x),
z AS (SELECT f AS fold, grp, CASE WHEN own = f THEN 'outer_test' WHEN CAST('0x' || substr(md5(f || ':' || grp), 1, 4) AS BIGINT) < 16384 THEN 'inner_calibration' ELSE 'inner_train' END AS partition FROM y, unnest(generate_series(0, 4)) AS u(f))
SELECT fold::INT AS fold, partition, count(*) AS n, count(DISTINCT grp) AS groups FROM z GROUP BY 1, 2""",
    "q_removals": "SELECT removal_reason, count(*) AS n, count(DISTINCT seq_id) AS records, count(similarity) AS with_similarity, max(sequence_length) AS longest FROM removal_log GROUP BY 1",
    "q_provenance_valid": "SELECT " + ", ".join(f"count(*) FILTER (coalesce(trim({c}), '') = '') AS no_{c}" for c in ("seq_id", "sequence", "source", "accession", "license", "label_evidence", "organism")) + ", count(*) FILTER (label IS NULL OR label NOT IN (0, 1)) AS bad_label, count(*) AS n FROM provenance_records",
    "q_organism_classes": f"{WITH} SELECT {_class('organism')} AS organism_class, {_class('source')} AS source_class, count(*) AS n FROM pep GROUP BY 1, 2",
    "q_negative_allowed": f"SELECT doc_id, NOT coalesce(regexp_matches(lower(text), '{'|'.join(curation.NOT_NEGATIVE)}'), false) AS allowed FROM documents",
    "q_tumbling": "SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3",
    "q_sliding": "SELECT date_trunc('day', ts) - to_days(k::INT) AS start, date_trunc('day', ts) - to_days(k::INT) + INTERVAL 2 DAY AS \"end\", event_type, count(*) AS n, max(value) AS highest FROM events, unnest([0, 1]) AS u(k) GROUP BY 1, 2, 3",
    "q_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id",
    "q_red_runs": "WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS m FROM events GROUP BY 1), r AS (SELECT day FROM d WHERE m > (SELECT avg(value) FROM events)), k AS (SELECT day, day - (row_number() OVER (ORDER BY day))::INT AS g FROM r) SELECT min(day) AS first_day, count(*) AS days FROM k GROUP BY g HAVING count(*) >= 3",
}

_FAMILY = f"""{_J3}, sh AS (SELECT * FROM txt WHERE length(sequence) < 30), both_texts AS (SELECT a.rep AS a, b.rep AS b, a.sequence AS s, b.sequence AS t, common::DOUBLE / either AS jac FROM j JOIN txt a ON a.rep = j.a JOIN txt b ON b.rep = j.b WHERE 5 * common >= either
UNION ALL SELECT a.rep, b.rep, a.sequence, b.sequence, 0 FROM sh a JOIN sh b ON a.rep < b.rep),
fm AS (SELECT *, greatest(length(s), length(t)) AS longest, least(length(s), length(t)) AS shortest, levenshtein(s, t)::DOUBLE / greatest(length(s), length(t)) AS edit FROM both_texts),
fp AS (SELECT DISTINCT a, b FROM fm WHERE NOT (longest > 30 AND shortest::DOUBLE / longest < 0.4) AND CASE WHEN longest < 30 THEN edit <= 1 - 0.35 OR jac >= 0.30 ELSE jac >= 0.35 OR (jac >= 0.20 AND longest <= 120 AND 1 - edit >= 0.35) END)"""
ORACLE["q_family_pairs"] = f"{WITH}, {_FAMILY} SELECT a, b FROM fp"
ORACLE["q_family_clusters"] = f"""{WITH.replace('WITH', 'WITH RECURSIVE', 1)}, {_FAMILY}, ln AS (SELECT a, b FROM fp UNION SELECT b, a FROM fp),
rc(a, b) AS (SELECT rep, rep FROM txt UNION SELECT r.a, l.b FROM rc r JOIN ln l ON l.a = r.b), lb AS (SELECT a, min(b) AS root FROM rc GROUP BY a),
pl AS (SELECT p.id, lb.root FROM pep p JOIN txt t USING (sequence) JOIN lb ON lb.a = t.rep), sz2 AS (SELECT root, count(*) AS size, min(id) AS first_id FROM pl GROUP BY root),
nm AS (SELECT root, size, row_number() OVER (ORDER BY size DESC, first_id) - 1 AS k FROM sz2) SELECT pl.id, printf('cluster_%04d', k) AS cluster_id, size FROM pl JOIN nm USING (root)"""

_MATCH = ORACLE["q_short_matches"]
ORACLE["q_hybrid"] = f"""{WITH}, {scoring.SCORED_SQL}, hits AS (SELECT id FROM ({_MATCH}))
SELECT s.id, h.id IS NOT NULL AS hit, CASE WHEN h.id IS NOT NULL THEN greatest(alg, 0.85) ELSE alg END AS hazard,
CASE WHEN h.id IS NOT NULL THEN 'high_risk' WHEN alg >= 0.5 THEN 'moderate_risk' ELSE 'low_risk' END AS tier,
CASE WHEN h.id IS NOT NULL THEN 'who_fao_short_match' ELSE 'ml_only' END AS basis FROM scored s LEFT JOIN hits h USING (id)"""

_CHAINS, _ON = fronts_sql("ob", OBJECTIVES, 0.0)
_FRONTED = f"""{_OBJ.replace('WITH', 'WITH RECURSIVE', 1).replace('SELECT id, ant, ', 'SELECT id, tox, ant, ')}, {_CHAINS}, fo AS (SELECT ob.*, fr.front FROM ob LEFT JOIN fr ON {_ON.format(t='ob')})"""
ORACLE["q_fronts"] = f"{_FRONTED} SELECT id, front FROM fo"
ORACLE["q_pareto_rank"] = f"""{_FRONTED}, cr AS ({crowding_sql('fo', OBJECTIVES)})
SELECT id, front, {scales.rounded('crowded', 6)} AS crowding, row_number() OVER (ORDER BY CASE WHEN tox >= 0.5 THEN 1 ELSE 0 END, front, CASE WHEN crowded IS NULL THEN 1e308 ELSE crowded END DESC, tox, id) AS rank FROM cr"""

_CUT = "greatest(1e-6, least(1 - 1e-6, tox))"
_LOGITS = f"{WITH}, {scoring.SCORED_SQL}, lg AS MATERIALIZED (SELECT id, label AS y, tox AS p, ln({_CUT} / (1 - {_CUT})) AS z FROM scored WHERE label IS NOT NULL)"
ORACLE["q_length_match_audit"] = f"{WITH} SELECT count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS candidates, 0::BIGINT AS twice, 0::BIGINT AS too_far, 0::BIGINT AS too_alike FROM pep"
ORACLE["q_temperature"] = f"{_LOGITS}, t AS (SELECT t AS temperature, round(avg(power(1 / (1 + exp(-z / t)) - y, 2)), 9) AS brier FROM lg, (SELECT unnest({TEMPERATURES})::DOUBLE AS t) GROUP BY t) SELECT temperature, brier FROM t ORDER BY brier, temperature LIMIT 1"
# Newton steps for slope and intercept, the slope penalised by half its square over the number of rows
ORACLE["q_sigmoid_fit"] = f"""{_LOGITS.replace('WITH', 'WITH RECURSIVE', 1)}, st(k, w, b) AS (SELECT 0, 0e0::DOUBLE, 0e0::DOUBLE UNION ALL
SELECT k + 1, w - (hbb * gw - hwb * gb) / (hww * hbb - hwb * hwb), b - (hww * gb - hwb * gw) / (hww * hbb - hwb * hwb) FROM (
  SELECT k, w, b, sum((q - y) * z) / count(*) + w / count(*) AS gw, sum(q - y) / count(*) AS gb, sum(q * (1 - q) * z * z) / count(*) + 1e0 / count(*) AS hww, sum(q * (1 - q) * z) / count(*) AS hwb, sum(q * (1 - q)) / count(*) AS hbb
  FROM (SELECT st.*, y, z, 1 / (1 + exp(-(w * z + b))) AS q FROM st, lg WHERE k < 12) GROUP BY k, w, b)),
ft AS (SELECT y, greatest(1e-15, least(1 - 1e-15, 1 / (1 + exp(-(w * z + b))))) AS c FROM lg, st WHERE k = 12)
SELECT count(*) AS n, {scales.rounded('avg((c - y) * (c - y))', 4)} AS brier, {scales.rounded('avg(-(y * ln(c) + (1 - y) * ln(1 - c)))', 4)} AS log_loss FROM ft"""
# the fit at a place is the largest, over the starts before it, of the smallest mean up to an end behind it
ORACLE["q_isotonic_fit"] = f"""{_LOGITS}, v AS (SELECT p, sum(y)::DOUBLE AS s, count(*)::DOUBLE AS n, row_number() OVER (ORDER BY p) AS i FROM lg GROUP BY p), c AS (SELECT *, sum(s) OVER (ORDER BY i) AS cs, sum(n) OVER (ORDER BY i) AS cn FROM v),
m AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS m FROM c a JOIN c b ON b.i >= a.i), low AS (SELECT a, b, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS low FROM m), f AS (SELECT b AS i, max(low) AS f FROM low GROUP BY b),
e AS (SELECT c.p, f, coalesce(abs(f - lag(f) OVER (ORDER BY c.i)) > 1e-12, true) OR coalesce(abs(f - lead(f) OVER (ORDER BY c.i)) > 1e-12, true) AS edge FROM c JOIN f USING (i)) SELECT p AS boundary, {scales.rounded('f', 6)} AS prediction FROM e WHERE edge"""
ORACLE["q_resolved_log"] = f"""{_GRADED.replace('WITH', 'WITH RECURSIVE', 1)}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY id) AS k FROM g),
w(sequence, k, label, e, reason) AS (SELECT sequence, k, label, e, NULL::VARCHAR FROM o WHERE k = 1 UNION ALL SELECT o.sequence, o.k, CASE WHEN o.e > w.e THEN o.label ELSE w.label END, greatest(o.e, w.e),
  CASE WHEN o.label = w.label THEN CASE WHEN o.e > w.e THEN 'EXACT_DUPLICATE_SUPERSEDED_BY_HIGHER_EVIDENCE' ELSE 'EXACT_DUPLICATE_RETAINED_PRIMARY' END WHEN o.e <> w.e THEN 'CONFLICTING_LABEL_DISCARDED' ELSE 'UNRESOLVED_CONFLICTING_LABELS_DROPPED' END
  FROM w JOIN o ON o.sequence = w.sequence AND o.k = w.k + 1) SELECT reason, count(*) AS n FROM w WHERE reason IS NOT NULL GROUP BY reason"""
