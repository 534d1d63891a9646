"""The screening pipeline: features, scores, prediction sets, reasons and rank of every candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.functions import features, scales, scoring
from residua.operators import domain, epitopes, metrics, pareto
from residua.plans import feature_queries
from residua.plans.ranking_sql import crowding_sql, fronts_sql
from residua.session import written
from residua.sources.tables import PEPTIDES_SQL, peptides

OBJECTIVES = ["o_ant", "o_tox", "o_alg"]
#: Deployment prevalence, margin of dominance, toxicity from which a candidate is not ranked with the others.
PREVALENCE, MARGIN, CAP = 0.02, 0.02, 0.5
#: Values from which a raw score alone, or a calibrated one, counts as positive.
POSITIVE = {"ant": (0.50, 0.50), "tox": (0.60, 0.60), "alg": (0.65, 0.50)}
KINDS = ("ant", "tox", "alg")

# Expressions of both engines on the scores of a row.
DERIVED = {
    **{f"prior_{k}": scoring.prior_shift_sql(f"cal_{k}", scoring.PRIORS[k], PREVALENCE, digits=4) for k in KINDS},
    **{f"set_{k}": scoring.set_sql(f"cal_{k}", k) for k in KINDS},
    **{f"is_{k}": f"({k} >= {POSITIVE[k][0]} OR cal_{k} >= {POSITIVE[k][1]})" for k in KINDS},
    "desirability": scoring.desirability_sql("cal_ant", "cal_tox", "cal_alg"),
    "derringer": scoring.derringer_sql("cal_ant", "cal_tox", "cal_alg"),
}
CONSERVATIVE = scales.rounded("greatest(0e0, desirability - 0.10e0 * (cal_tox + cal_alg))", 4)
# Abstained candidates come last, those over the cap before them.
GATE = f"CASE WHEN guard IS NOT NULL THEN 2 WHEN tox >= {CAP} THEN 1 ELSE 0 END"
PLACES = {"o_ant": "ant", "o_tox": scales.rounded("1e0 - tox", 3), "o_alg": scales.rounded("1e0 - alg", 3)}

MEASURES = [
    "id", "len", *(c for k in KINDS for c in (k, f"cal_{k}", f"prior_{k}", f"set_{k}", f"is_{k}")), "desirability", "conservative", "derringer",
    "mol_weight", "gravy", "instability", "is_stable", "advisory", "isoelectric_point", "charge_7_0", "charge_7_4", "aggregation", "aromaticity", "helix", "sheet", "turn",
    "epitopes", "guard", "reasons",
]
FLAT = [*MEASURES, "front", "crowding", "rank"]


def measured(df: DataFrame) -> DataFrame:
    """Every measurement of each row of (id, sequence, len), in one chain of projections: nothing is joined or shuffled."""
    charges = [F.expr(scales.rounded(features.charge_sql(ph), 2)).alias(n) for n, ph in (("charge_7_0", "7.0"), ("charge_7_4", "7.4"))]
    rows = scoring.scored(df).select("*", *features.physical_columns(), domain.instability_column(), *charges, features.isoelectric_column(), epitopes.count_column(), domain.guard_column())
    rows = rows.select("*", *[F.expr(text).alias(name) for name, text in DERIVED.items()], domain.stability_reasons(), (F.col("len") < 20).alias("advisory"), (F.col("instability") < 40).alias("is_stable"))
    return rows.withColumn("conservative", F.expr(CONSERVATIVE)).withColumn("gate", F.expr(GATE))


def profiles(df: DataFrame, margin: float = MARGIN) -> DataFrame:
    """One row for each (id, sequence, len): ``FLAT`` and the gate (0 ranked, 1 over the toxicity cap, 2 abstained).

    Fronts and crowding are those of the ranked candidates. Candidates in or
    behind a cycle of dominance, which a margin makes possible, have no front and
    follow the others. Ties go to the lower toxicity, then to the smaller id.
    """
    rows = written(measured(df), "profiles")
    # only what the ranking needs goes through its shuffles
    slim = rows.select("id", "gate", "tox", *[F.expr(f"CASE WHEN gate = 0 THEN {text} END").alias(name) for name, text in PLACES.items()])
    order = [F.col("gate"), F.col("front").asc_nulls_last(), F.col("crowding").desc_nulls_last(), F.col("tox"), F.col("id")]
    ranked = metrics.ranked(pareto.crowding(pareto.fronts(slim, OBJECTIVES, margin), OBJECTIVES), order)
    crowding = F.when(F.col("crowding") < float("inf"), F.expr(scales.rounded("crowding", 4))).alias("crowding")
    return rows.join(ranked.select("id", "front", crowding, "rank"), "id")


def flat(profile: DataFrame) -> DataFrame:
    """Plain columns; no reason is ``PASS``, the crowding of a front's ends is null."""
    return profile.select(*FLAT).withColumn("reasons", F.when(F.col("reasons") == "", "PASS").otherwise(F.col("reasons")))


def contract(profile: DataFrame) -> DataFrame:
    """(id, document): a JSON document per candidate."""

    def score(k: str) -> F.Column:
        return F.struct(F.col(f"cal_{k}").alias("p_cal"), F.col(f"prior_{k}").alias("p_prior_adj"), F.split(f"set_{k}", ",").alias("pred_set"), F.when(F.col(f"is_{k}"), scoring.CLASSES[k][1]).otherwise(scoring.CLASSES[k][0]).alias("decision"))

    flags = F.filter(F.split("reasons", ","), lambda r: r != "")
    body = F.struct(
        "sequence", F.when(F.col("guard").isNull(), "ok").otherwise("abstain").alias("status"), score("ant").alias("antigenicity"), score("tox").alias("toxicity"), score("alg").alias("allergenicity"),
        F.struct(flags.alias("flags"), "advisory").alias("stability"), F.struct((F.col("front") + 1).alias("front"), "crowding").alias("pareto"),
    )
    return profile.select("id", F.to_json(body).alias("document"))


DOCUMENT = (
    "sequence string, status string, " + ", ".join(f"{n} struct<p_cal: double, p_prior_adj: double, pred_set: array<string>, decision: string>" for n in ("antigenicity", "toxicity", "allergenicity"))
    + ", stability struct<flags: array<string>, advisory: boolean>, pareto struct<front: int, crowding: double>"
)


def read_contract(documents: DataFrame) -> DataFrame:
    """(id, the fields of ``DOCUMENT``) of documents (id, document); what is not JSON gives null fields."""
    return documents.select("id", F.from_json("document", DOCUMENT).alias("d")).select("id", "d.*")


def q_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(profiles(peptides(spark, sf_dir)))


def q_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents built and read again."""
    rows = read_contract(contract(profiles(peptides(spark, sf_dir))))
    return rows.select(
        "id", "status", *[F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in ("antigenicity", "toxicity", "allergenicity") for c in ("p_cal", "p_prior_adj", "decision")],
        F.array_join("toxicity.pred_set", ",").alias("toxicity_set"), F.array_join("stability.flags", ",").alias("flags"), "stability.advisory", "pareto.front", "pareto.crowding",
    )


def q_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = peptides(spark, sf_dir)
    return domain.guards(rows).groupBy(F.coalesce("guard", F.lit("none")).alias("guard")).agg(F.count("*").alias("n"))


QUERIES = {"q_profile": q_profile, "q_contract": q_contract, "q_guarded": q_guarded}

_PART = {name: f"({feature_queries.ORACLE[name]})" for name in ("q_physical", "q_instability", "q_epitopes", "q_isoelectric", "q_guards_peptides", "q_stability")}
_FRONTS, _ON = fronts_sql("ob", OBJECTIVES, MARGIN)
_PROFILE = f"""WITH RECURSIVE {PEPTIDES_SQL}, {scoring.SCORED_SQL}, der AS (SELECT *, {', '.join(f'{t} AS {n}' for n, t in DERIVED.items())},
  {scales.rounded(features.charge_sql('7.0'), 2)} AS charge_7_0 FROM scored),
allv AS (SELECT d.*, {CONSERVATIVE} AS conservative, ph.* EXCLUDE (id), st.instability, st.instability < 40 AS is_stable, d.len < 20 AS advisory, st.charge_7_4, st.reasons, pi.isoelectric_point, coalesce(ep.n, 0)::INT AS epitopes, gd.guard
  FROM der d JOIN {_PART['q_physical']} ph USING (id) JOIN {_PART['q_stability']} st USING (id) JOIN {_PART['q_isoelectric']} pi USING (id)
  JOIN {_PART['q_guards_peptides']} gd USING (id) LEFT JOIN (SELECT id, count(*) AS n FROM {_PART['q_epitopes']} GROUP BY id) ep USING (id)),
gt AS (SELECT *, {GATE} AS gate FROM allv),
ob AS MATERIALIZED (SELECT *, {', '.join(f'CASE WHEN gate = 0 THEN {t} END AS {n}' for n, t in PLACES.items())} FROM gt),
{_FRONTS},
fo AS (SELECT ob.*, fr.front FROM ob LEFT JOIN fr ON {_ON.format(t='ob')}),
cr AS ({crowding_sql('fo', OBJECTIVES)}),
rk AS (SELECT *, {scales.rounded('crowded', 4)} AS crowding, row_number() OVER (ORDER BY gate, front NULLS LAST, CASE WHEN front IS NOT NULL AND crowded IS NULL THEN 1e308 ELSE crowded END DESC NULLS LAST, tox, id) AS rank FROM cr)
"""
ORACLE = {
    "q_profile": _PROFILE + f"SELECT {', '.join('len::INT AS len' if c == 'len' else c for c in FLAT if c != 'reasons')}, CASE WHEN reasons = '' THEN 'PASS' ELSE reasons END AS reasons FROM rk",
    "q_contract": _PROFILE
    + "SELECT id, CASE WHEN guard IS NULL THEN 'ok' ELSE 'abstain' END AS status, "
    + ", ".join(f"cal_{k} AS {n}_p_cal, prior_{k} AS {n}_p_prior_adj, CASE WHEN is_{k} THEN '{scoring.CLASSES[k][1]}' ELSE '{scoring.CLASSES[k][0]}' END AS {n}_decision" for k, n in (("ant", "antigenicity"), ("tox", "toxicity"), ("alg", "allergenicity")))
    + ", set_tox AS toxicity_set, reasons AS flags, advisory, front + 1 AS front, crowding FROM rk",
    "q_guarded": f"SELECT coalesce(guard, 'none') AS guard, count(*) AS n FROM {_PART['q_guards_peptides']} GROUP BY 1",
}
