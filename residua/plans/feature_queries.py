"""Queries on cleaning, features and scores of single sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.functions import features, scales, scoring
from residua.operators import curation, domain, epitopes
from residua.sources.tables import PEPTIDES_SQL, peptides, table

WITH = f"WITH {PEPTIDES_SQL}"
POSITIONS = "unnest(generate_series(1, len)) AS u(i)"


def _on_peptides(operator):
    return lambda spark, sf_dir: operator(peptides(spark, sf_dir))


def q_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peptides(spark, sf_dir).select("id", "sequence", "label", "source")


def q_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(peptides(spark, sf_dir)).select("id", *scoring.RAW, *scoring.CALIBRATED)


PRIORS = {"ant": (0.45, 0.02), "tox": (0.277, 0.01), "alg": (0.25, 0.01)}


def q_prior_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.scored(peptides(spark, sf_dir))
    return rows.select("id", *[F.expr(scoring.prior_shift_sql(f"cal_{k}", *p)).alias(f"deployed_{k}") for k, p in PRIORS.items()])


DESIRABILITY = {
    "vaccine": scoring.desirability_sql("cal_ant", "cal_tox", "cal_alg"),
    "therapeutic": scoring.desirability_sql("cal_ant", "cal_tox", "cal_alg", True),
    "derringer_vaccine": scoring.derringer_sql("cal_ant", "cal_tox", "cal_alg"),
    "derringer_therapeutic": scoring.derringer_sql("cal_ant", "cal_tox", "cal_alg", True),
}


def q_desirability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.scored(peptides(spark, sf_dir))
    return rows.select("id", *[F.expr(t).alias(n) for n, t in DESIRABILITY.items()])


def q_charge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = peptides(spark, sf_dir)
    return rows.select("id", *[F.expr(scales.rounded(features.charge_sql(ph), 4)).alias(n) for n, ph in (("charge_7_0", "7.0"), ("charge_7_4", "7.4"))])


def q_length_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = peptides(spark, sf_dir)
    return rows.select("id", *[F.expr(features.length_bin_sql(s, "len")).alias(f"bin_{s}") for s in features.LENGTH_BINS])


def q_sanitized_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curation.sanitized(table(spark, sf_dir, "sanitization_results"), "result_id", "original_sequence")
    return rows.select("result_id", "sanitized_sequence", "original_length", "sanitized_length", "altered_count", "altered_fraction", "is_flagged", "is_dropped", F.size("alterations").alias("changes"))


def q_alterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curation.sanitized(table(spark, sf_dir, "sanitization_results"), "result_id", "original_sequence")
    return rows.select("result_id", F.explode("alterations").alias("a")).groupBy("result_id", "a.action", "a.original").agg(F.count("*").alias("n"), F.min("a.position").alias("first_position")).withColumnRenamed("action", "act")


def q_parser_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "provenance_records").where("sequence is not null")
    return rows.select("record_no", curation.parsed("sequence").alias("sequence"))


def q_model_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "provenance_records").where("sequence is not null")
    clean = rows.select("record_no", curation.for_model("sequence").alias("sequence"))
    return clean.select("*", F.expr(scales.count_sql("X")).cast("int").alias("unknown"))


def q_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "provenance_records").where("sequence is not null")
    return domain.guards(rows.select(F.col("record_no").alias("id"), F.trim("sequence").alias("sequence"))).select("id", "guard")


def q_guards_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.guards(peptides(spark, sf_dir))


def q_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sanitization_results").where("original_sequence is not null")
    return rows.select("result_id", domain.modified("original_sequence").alias("modified"))


def q_embedding_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache key of an embedding: hash of the sequence's hash with model, revision and pooling."""
    return peptides(spark, sf_dir).select("id", F.sha2(F.concat(F.sha2("sequence", 256), F.lit("_esm2_t6_8m_r1_int8_mean")), 256).alias("cache_key"))


def q_kmer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.kmer_frequency(peptides(spark, sf_dir), 2)
    return rows.groupBy("kmer").agg(F.sum("n").alias("n"), F.count("*").alias("sequences"), F.max("frequency").alias("highest"))


def q_acc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 125 terms of every record."""
    names = F.array(*[F.lit(n) for n in features.acc_names()])
    rows = features.acc(peptides(spark, sf_dir)).select("id", F.explode(F.arrays_zip(names.alias("term"), F.col("terms").alias("v"))).alias("x"))
    return rows.select("id", "x.term", F.expr(scales.rounded("x.v", 6)).alias("value"))


def q_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.stability(peptides(spark, sf_dir)).select("id", "reasons", "aggregation", "charge_7_4", "instability")


QUERIES = {
    "q_peptides": q_peptides,
    "q_aac": _on_peptides(features.aac),
    "q_pcp": _on_peptides(features.pcp),
    "q_physical": _on_peptides(features.physical),
    "q_autocorrelation": _on_peptides(features.autocorrelation),
    "q_complexity": _on_peptides(features.complexity),
    "q_isoelectric": _on_peptides(features.isoelectric),
    "q_instability": _on_peptides(domain.instability_index),
    "q_epitopes": _on_peptides(epitopes.regions),
    "q_dipeptides": _on_peptides(lambda df: features.kmer_frequency(df, 2)),
    "q_kmer_totals": q_kmer_totals,
    "q_acc": q_acc,
    "q_charge": q_charge,
    "q_stability": q_stability,
    "q_length_bins": q_length_bins,
    "q_scores": q_scores,
    "q_prior_shift": q_prior_shift,
    "q_desirability": q_desirability,
    "q_sanitized_submissions": q_sanitized_submissions,
    "q_alterations": q_alterations,
    "q_parser_clean": q_parser_clean,
    "q_model_clean": q_model_clean,
    "q_guards": q_guards,
    "q_guards_peptides": q_guards_peptides,
    "q_modified": q_modified,
    "q_embedding_keys": q_embedding_keys,
}


def _values(scale: dict, default: int = 0) -> str:
    """A DuckDB CASE that looks a residue's integer value up."""
    return "CASE substr(sequence, i::BIGINT, 1) " + " ".join(f"WHEN '{r}' THEN {v}" for r, v in scale.items()) + f" ELSE {default} END"


_KD = f"pos AS (SELECT id, len, i, {_values(scales.HYDROPATHY)} AS v FROM pep, {POSITIONS})"
_LAGS = ", ".join(
    f"coalesce((SELECT floor((sum(a.v * b.v)::DOUBLE / (100 * any_value(a.len - {k}))) * 1000e0 + 0.5e0) / 1000e0 FROM pos a JOIN pos b ON b.id = a.id AND b.i = a.i + {k} WHERE a.id = p.id), 0.0) AS ACR_lag_{k}" for k in (1, 2, 3)
)
_COUNTS = "cnt AS (SELECT id, len, substr(sequence, i::BIGINT, 1) AS c, count(*) AS n FROM pep, unnest(generate_series(1, len)) AS u(i) GROUP BY ALL)"
_SAN = """trimmed AS (SELECT result_id, regexp_replace(original_sequence, '^\\s+|\\s+$', '', 'g') AS s FROM sanitization_results WHERE original_sequence IS NOT NULL),
ch AS (SELECT result_id, i - 1 AS position, substr(s, i::BIGINT, 1) AS original, upper(substr(s, i::BIGINT, 1)) AS up FROM trimmed, unnest(generate_series(1, length(s))) AS u(i)),
act AS (SELECT *, CASE WHEN up IN ('A','C','D','E','F','G','H','I','K','L','M','N','P','Q','R','S','T','V','W','Y') THEN CASE WHEN up <> original THEN 'case_converted' END
  WHEN up IN ('B','Z','J','U','O') THEN 'mapped' ELSE 'stripped' END AS action,
  CASE WHEN up IN ('A','C','D','E','F','G','H','I','K','L','M','N','P','Q','R','S','T','V','W','Y') THEN up ELSE translate(up, 'BZJUO', 'NQLCK') END AS kept FROM ch)"""
_MOD = "regexp_matches(original_sequence, '" + "|".join(domain.MODIFICATIONS).replace("'", "''") + "', 'i')"
_Z = "CASE substr(sequence, i::BIGINT, 1) " + " ".join(f"WHEN '{r}' THEN [{', '.join(map(str, v))}]" for r, v in scales.Z_COMPOSITION.items()) + " END"


_WEIGHTS = "CASE substr(sequence, i::BIGINT, 2) " + " ".join(f"WHEN '{p}' THEN {round(w * 100)}" for p, w in domain.instability_weights().items()) + " ELSE 100 END"
_KT = f"""kt AS (SELECT id, sequence, len, i, {_values(scales.ANTIGENIC, 1000)} AS v FROM pep, {POSITIONS}),
win AS (SELECT id, sequence, i AS s, sum(v) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS t, len FROM kt),
hot AS (SELECT * FROM win WHERE s <= len - 6 AND t >= 7000),
isl AS (SELECT *, s - row_number() OVER (PARTITION BY id ORDER BY s) AS k FROM hot)"""

_LOW, _HIGH = features.PI_RANGE
_GUARDED = f"""c AS (SELECT id, upper(substr(s, i::BIGINT, 1)) AS x, count(*) AS n FROM r, unnest(generate_series(1, length(s))) AS u(i) GROUP BY 1, 2),
k AS (SELECT c.id, -sum(n::DOUBLE / length(s) * log2(n::DOUBLE / length(s))) AS h, max(n)::DOUBLE / any_value(length(s)) AS t FROM c JOIN r USING (id) GROUP BY c.id)
SELECT r.id, CASE WHEN regexp_matches(s, '{"|".join(domain.MODIFICATIONS)}', 'i') THEN 'annotated_chemical_modification_in_sequence'
WHEN length(s) < 5 THEN 'length_under_minimum_5' WHEN length(s) > 1000 THEN 'length_over_maximum_1000'
WHEN regexp_matches(upper(s), '[^ACDEFGHIKLMNPQRSTVWY]') THEN 'non_canonical_residue_detected'
WHEN h < 1.5 THEN 'extreme_low_complexity_entropy_' || printf('%.2f', h) || '_bits' WHEN t > 0.5 THEN 'extreme_skewed_composition_max_aa_' || printf('%.2f', t) END AS guard
FROM r LEFT JOIN k USING (id)"""

ORACLE = {
    "q_peptides": WITH + " SELECT id, sequence, label, source FROM pep",
    "q_aac": WITH + " SELECT id, " + ", ".join(f"floor((CAST(len(regexp_replace(sequence, '[^{r}]', '', 'g')) AS DOUBLE) * 100.0 / len) * 1000e0 + 0.5e0) / 1000e0 AS aac_{r}" for r in scales.RESIDUES) + " FROM pep",
    "q_pcp": WITH
    + " SELECT id, "
    + ", ".join(f"floor((CAST(length(regexp_replace(sequence, '[^{g}]', '', 'g')) AS DOUBLE) / len) * 1000e0 + 0.5e0) / 1000e0 AS {n}" if g else f"0.0::DOUBLE AS {n}" for n, g in scales.GROUPS.items())
    + ", "
    + ", ".join(f"{scales.mean_sql({r: v[i] for r, v in scales.Z_COMPOSITION.items()}, 100, 3)} AS PCP_Z{i + 1}" for i in range(5))
    + " FROM pep",
    "q_physical": f"{WITH}, {_COUNTS.replace('GROUP BY ALL', 'GROUP BY ALL')}, val AS (SELECT id, len, n, c, "
    + "CASE c " + " ".join(f"WHEN '{r}' THEN {v}" for r, v in scales.MASS.items()) + " END AS m, "
    + "CASE c " + " ".join(f"WHEN '{r}' THEN {v}" for r, v in scales.HYDROPATHY.items()) + " END AS k, "
    + "CASE c " + " ".join(f"WHEN '{r}' THEN {v}" for r, v in scales.AGGREGATION.items()) + " END AS g FROM cnt) "
    + f"SELECT id, floor(((sum(m * n) - {scales.WATER} * (len - 1))::DOUBLE / 10000.0) * 100e0 + 0.5e0) / 100e0 AS mol_weight, floor((sum(k * n)::DOUBLE / (10 * len)) * 1000e0 + 0.5e0) / 1000e0 AS gravy, "
    + ", ".join(f"floor((coalesce(sum(n) FILTER (strpos('{g}', c) > 0), 0)::DOUBLE / len) * 1000e0 + 0.5e0) / 1000e0 AS {n}" for n, g in (("aromaticity", "FWY"), ("helix", scales.HELIX), ("turn", scales.TURN), ("sheet", scales.SHEET)))
    + ", floor((sum(g * n)::DOUBLE / (10 * len)) * 1000e0 + 0.5e0) / 1000e0 AS aggregation FROM val GROUP BY id, len",
    "q_autocorrelation": f"""{WITH}, {_KD}, lagged AS (SELECT id, len, v, lead(v, 1) OVER w AS a, lead(v, 2) OVER w AS b, lead(v, 3) OVER w AS c FROM pos WINDOW w AS (PARTITION BY id ORDER BY i))
SELECT id, floor((sum(v * a)::DOUBLE / (100 * (len - 1))) * 1000e0 + 0.5e0) / 1000e0 AS ACR_lag_1, floor((sum(v * b)::DOUBLE / (100 * (len - 2))) * 1000e0 + 0.5e0) / 1000e0 AS ACR_lag_2,
floor((sum(v * c)::DOUBLE / (100 * (len - 3))) * 1000e0 + 0.5e0) / 1000e0 AS ACR_lag_3 FROM lagged GROUP BY id, len""",
    "q_complexity": f"{WITH}, {_COUNTS} SELECT id, floor((-sum(n::DOUBLE / len * log2(n::DOUBLE / len))) * 1000000e0 + 0.5e0) / 1000000e0 AS entropy, floor((max(n)::DOUBLE / len) * 1000000e0 + 0.5e0) / 1000000e0 AS max_fraction FROM cnt GROUP BY id, len",
    "q_instability": f"{WITH} SELECT id, floor((sum({_WEIGHTS})::DOUBLE / (10 * any_value(len))) * 100e0 + 0.5e0) / 100e0 AS instability FROM pep, unnest(generate_series(1, len - 1)) AS u(i) GROUP BY id",
    "q_epitopes": f"""{WITH}, {_KT} SELECT id, min(s)::INT AS start, (max(s) + 6)::INT AS "end", (max(s) + 7 - min(s))::INT AS length,
substr(any_value(sequence), min(s)::BIGINT, (max(s) + 7 - min(s))::BIGINT) AS region, floor((sum(t)::DOUBLE / (7000 * count(*))) * 1000e0 + 0.5e0) / 1000e0 AS mean_score FROM isl GROUP BY id, k""",
    "q_dipeptides": f"{WITH} SELECT id, substr(sequence, i::BIGINT, 2) AS kmer, count(*) AS n, floor((count(*)::DOUBLE / (any_value(len) - 1)) * 1000000e0 + 0.5e0) / 1000000e0 AS frequency FROM pep, unnest(generate_series(1, len - 1)) AS u(i) GROUP BY 1, 2",
    "q_kmer_totals": f"{WITH}, f AS (SELECT id, substr(sequence, i::BIGINT, 2) AS kmer, count(*) AS n, floor((count(*)::DOUBLE / (any_value(len) - 1)) * 1000000e0 + 0.5e0) / 1000000e0 AS frequency FROM pep, unnest(generate_series(1, len - 1)) AS u(i) GROUP BY 1, 2) SELECT kmer, sum(n)::BIGINT AS n, count(*) AS sequences, max(frequency) AS highest FROM f GROUP BY kmer",
    "q_acc": f"""{WITH}, z AS MATERIALIZED (SELECT id, len, i, {_Z} AS z FROM pep, {POSITIONS}),
tot AS (SELECT id, {', '.join(f'sum(z[{j}])::BIGINT AS s{j}' for j in range(1, 6))} FROM z GROUP BY id),
lag AS (SELECT a.id, a.len AS n, l, {', '.join(f'sum(a.z[{j}])::BIGINT AS f{j}, sum(b.z[{j}])::BIGINT AS g{j}' for j in range(1, 6))}, {', '.join(f'sum(a.z[{j}] * b.z[{k}])::BIGINT AS p{j}{k}' for j in range(1, 6) for k in range(1, 6))}
  FROM unnest(generate_series(1, 5)) AS u(l) JOIN z a ON true JOIN z b ON b.id = a.id AND b.i = a.i + l GROUP BY 1, 2, 3),
term AS ({' UNION ALL '.join(f"SELECT id, '{f'AC_{j}' if j == k else f'CC_{j}_{k}'}_' || l AS term, (n * n * p{j}{k} - n * (f{j} * s{k} + s{j} * g{k}) + (n - l) * s{j} * s{k})::DOUBLE / (n * n * (n - l) * 10000) AS v FROM lag JOIN tot USING (id)" for j in range(1, 6) for k in range(1, 6))}),
every AS (SELECT id, unnest([{', '.join(repr(n) for n in features.acc_names())}]) AS term FROM pep)
SELECT e.id, e.term, {scales.rounded('coalesce(v, 0e0)', 6)} AS value FROM every e LEFT JOIN term USING (id, term)""",
    "q_charge": WITH + " SELECT id, " + ", ".join(f"floor(({features.charge_sql(ph)}) * 10000e0 + 0.5e0) / 10000e0 AS {n}" for n, ph in (("charge_7_0", "7.0"), ("charge_7_4", "7.4"))) + " FROM pep",
    "q_length_bins": WITH + " SELECT id, " + ", ".join(f"{features.length_bin_sql(s, 'len')} AS bin_{s}" for s in features.LENGTH_BINS) + " FROM pep",
    "q_scores": f"{WITH}, {scoring.SCORED_SQL} SELECT id, {', '.join([*scoring.RAW, *scoring.CALIBRATED])} FROM scored",
    "q_prior_shift": f"{WITH}, {scoring.SCORED_SQL} SELECT id, " + ", ".join(f"{scoring.prior_shift_sql(f'cal_{k}', *p)} AS deployed_{k}" for k, p in PRIORS.items()) + " FROM scored",
    "q_desirability": f"{WITH}, {scoring.SCORED_SQL} SELECT id, " + ", ".join(f"{t} AS {n}" for n, t in DESIRABILITY.items()) + " FROM scored",
    "q_sanitized_submissions": f"""WITH {_SAN}, agg AS (SELECT result_id, string_agg(kept, '' ORDER BY position) FILTER (action IS NULL OR action <> 'stripped') AS s,
count(*) AS n, count(*) FILTER (action IN ('mapped', 'stripped')) AS altered, count(action) AS changes FROM act GROUP BY result_id)
SELECT t.result_id, coalesce(a.s, '') AS sanitized_sequence, length(t.s)::INT AS original_length, length(coalesce(a.s, ''))::INT AS sanitized_length,
coalesce(a.altered, 0)::INT AS altered_count, coalesce(floor((a.altered::DOUBLE / a.n) * 10000e0 + 0.5e0) / 10000e0, 0.0) AS altered_fraction, coalesce(a.altered::DOUBLE / a.n > 0.05, false) AS is_flagged,
length(coalesce(a.s, '')) < 4 AS is_dropped, coalesce(a.changes, 0)::INT AS changes FROM trimmed t LEFT JOIN agg a USING (result_id)""",
    "q_alterations": f"WITH {_SAN} SELECT result_id, action AS act, original, count(*) AS n, min(position)::INT AS first_position FROM act WHERE action IS NOT NULL GROUP BY 1, 2, 3",
    "q_parser_clean": "SELECT record_no, regexp_replace(translate(upper(regexp_replace(sequence, '\\s+', '', 'g')), 'BZUXJO', 'DECALK'), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS sequence FROM provenance_records WHERE sequence IS NOT NULL",
    "q_model_clean": "WITH c AS (SELECT record_no, regexp_replace(translate(upper(regexp_replace(sequence, '^\\s+|\\s+$', '', 'g')), 'UOBZJ', 'CKNEL'), '[^ACDEFGHIKLMNPQRSTVWY]', 'X', 'g') AS sequence FROM provenance_records WHERE sequence IS NOT NULL) SELECT record_no, sequence, length(regexp_replace(sequence, '[^X]', '', 'g'))::INT AS unknown FROM c",
    "q_guards": f"WITH r AS (SELECT record_no AS id, regexp_replace(sequence, '^ +| +$', '', 'g') AS s FROM provenance_records WHERE sequence IS NOT NULL), {_GUARDED}",
    "q_guards_peptides": f"{WITH}, r AS (SELECT id, sequence AS s FROM pep), {_GUARDED}",
    "q_modified": "SELECT result_id, " + _MOD + " AS modified FROM sanitization_results WHERE original_sequence IS NOT NULL",
    "q_embedding_keys": f"{WITH} SELECT id, sha256(sha256(sequence) || '_esm2_t6_8m_r1_int8_mean') AS cache_key FROM pep",
}
ORACLE["q_isoelectric"] = f"""{WITH.replace('WITH', 'WITH RECURSIVE', 1)}, step(id, sequence, k, lo, hi, ph) AS (SELECT id, sequence, 0, {_LOW}::DOUBLE, {_HIGH}::DOUBLE, {features.PI_FIRST}::DOUBLE FROM pep
UNION ALL SELECT id, sequence, k + 1, CASE WHEN c > 0 THEN ph ELSE lo END, CASE WHEN c > 0 THEN hi ELSE ph END, CASE WHEN c > 0 THEN (ph + hi) / 2 ELSE (lo + ph) / 2 END FROM (SELECT *, {features.charge_sql('ph')} AS c FROM step WHERE k < {features.PI_STEPS}))
SELECT id, floor(ph * 100e0 + 0.5e0) / 100e0 AS isoelectric_point FROM step WHERE k = {features.PI_STEPS}"""
ORACLE["q_stability"] = f"""{WITH}, ph AS ({ORACLE['q_physical']}), ins AS ({ORACLE['q_instability']}), ch AS (SELECT id, len, {scales.rounded(features.charge_sql('7.4'), 2)} AS charge_7_4 FROM pep)
SELECT id, concat_ws(',', CASE WHEN len < 20 THEN 'advisory_short_peptide' END, CASE WHEN instability >= 40 THEN CASE WHEN len < 20 THEN 'unstable_advisory' ELSE 'unstable' END END,
CASE WHEN aggregation > 0.2 OR (sheet >= 0.35 AND gravy > 0) THEN 'aggregation_prone' END, CASE WHEN abs(charge_7_4) > 6 THEN 'extreme_net_charge' END) AS reasons, aggregation, charge_7_4, instability
FROM ch JOIN ph USING (id) JOIN ins USING (id)"""
