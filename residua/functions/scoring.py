"""Scores, calibration and desirability as SQL expressions of either engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.functions import scales as S
from residua.functions.scales import rounded

# Slope and intercept of the shipped sigmoid calibration.
PLATT = {"tox": (1.4001763451931555, -2.497765406942125), "alg": (0.09520445692849948, -1.4169102751378913), "ant": (0.03273866291900334, -1.4198298656126072)}


def share(letters: str) -> str:
    return f"CAST({S.count_sql(letters)} AS DOUBLE) / nullif(length(sequence), 0)"


TOXICITY = rounded(f"least(0.98e0, greatest(0.02e0, {share('KR')} * 0.4e0 + {share('ILVFW')} * 0.3e0 + least(1e0, {share('C')} * 3e0) * 0.3e0))", 3)
ANTIGENICITY = rounded(
    f"least(0.99e0, greatest(0.01e0, {S.fraction_sql(S.GROUPS['PCP_SA_EX'])} * 0.45e0 + {S.fraction_sql(S.GROUPS['PCP_PO'])} * 0.35e0"
    f" + (1e0 - {S.fraction_sql(S.GROUPS['PCP_HX'])}) * 0.20e0))",
    3,
)
ALLERGENICITY = rounded(
    f"least(0.99e0, greatest(0.01e0, {S.fraction_sql(S.GROUPS['PCP_SA_EX'])} * 0.4e0 + {S.fraction_sql(S.GROUPS['PCP_PO'])} * 0.3e0"
    f" + {S.fraction_sql(S.GROUPS['PCP_PC'])} * 0.3e0))",
    3,
)


def clipped(p: str, eps: str = "1e-6") -> str:
    return f"greatest({eps}, least(1e0 - {eps}, {p}))"


def platt_sql(p: str, coef: float, intercept: float, digits: int = 4) -> str:
    c = clipped(p)
    return rounded(f"1e0 / (1e0 + exp(-({coef!r}e0 * ln({c} / (1e0 - {c})) + ({intercept!r}e0))))", digits)


def prior_shift_sql(p: str, source: float, target: float, eps: str = "1e-7", digits: int = 6) -> str:
    """Odds times the ratio of the target's and the source's prior odds."""
    c = clipped(p, eps)
    factor = (target / (1 - target)) * ((1 - source) / source)
    odds = f"({c} / (1e0 - {c}) * {factor!r}e0)"
    return rounded(f"least(1e0, greatest(0e0, {odds} / (1e0 + {odds})))", digits)


def rising(p: str, low: float, high: float) -> str:
    return f"least(1e0, greatest(0e0, ({p} - {low!r}e0) / {high - low!r}e0))"


def falling(p: str, low: float, high: float) -> str:
    return f"least(1e0, greatest(0e0, ({high!r}e0 - {p}) / {high - low!r}e0))"


def desirability_sql(ant: str, tox: str, alg: str, therapeutic: bool = False) -> str:
    first = f"(1e0 - {ant})" if therapeutic else ant
    return rounded(f"least(1e0, greatest(0e0, {first} * (1e0 - {tox}) * (1e0 - {alg})))", 4)


def derringer_sql(ant: str, tox: str, alg: str, therapeutic: bool = False) -> str:
    """Geometric mean of three desirabilities; 0 where one of them is 0."""
    a = falling(ant, 0.1, 0.5) if therapeutic else rising(ant, 0.2, 0.8)
    t, g = falling(tox, 0.1, 0.6), falling(alg, 0.1, 0.6)
    return f"CASE WHEN {a} <= 0 OR {t} <= 0 OR {g} <= 0 THEN 0e0 ELSE {rounded(f'exp((ln({a}) + ln({t}) + ln({g})) / 3e0)', 4)} END"


# Priors of the training data, and quantiles of the shipped prediction sets for classes 0 and 1.
PRIORS = {"ant": 0.45, "tox": 0.277, "alg": 0.25}
QUANTILES = {"ant": (0.88, 0.95), "tox": (0.93, 0.99), "alg": (0.92, 0.98)}
#: Names of the classes 0 and 1.
CLASSES = {"ant": ("Non-Antigen", "Antigen"), "tox": ("Non-Toxic", "Toxic"), "alg": ("Non-Allergen", "Allergen")}


def set_sql(p: str, kind: str) -> str:
    """Names of the classes in the prediction set of a probability, joined by a comma."""
    (q0, q1), (no, yes) = QUANTILES[kind], CLASSES[kind]
    return f"concat_ws(',', CASE WHEN {p} <= {q0!r}e0 THEN '{no}' END, CASE WHEN 1e0 - {p} <= {q1!r}e0 THEN '{yes}' END)"


RAW = {"tox": TOXICITY, "ant": ANTIGENICITY, "alg": ALLERGENICITY}
CALIBRATED = {f"cal_{k}": platt_sql(k, *PLATT[k]) for k in ("tox", "ant", "alg")}


def scored(peptides: DataFrame, model: dict[str, Column] | None = None) -> DataFrame:
    """Adds the raw scores tox, ant, alg and their calibrated values.

    ``model`` gives columns with scores of a fitted model; the closed-form score
    stands in where the column is null.
    """
    model = model or {}
    out = peptides
    for name, text in RAW.items():
        plain = F.expr(text)
        out = out.withColumn(name, F.coalesce(model[name], plain) if name in model else plain)
    return out.select("*", *[F.expr(text).alias(name) for name, text in CALIBRATED.items()])


SCORED_SQL = (
    "raw_scored AS (SELECT *, " + ", ".join(f"{text} AS {name}" for name, text in RAW.items()) + " FROM pep),\n"
    "scored AS (SELECT *, " + ", ".join(f"{text} AS {name}" for name, text in CALIBRATED.items()) + " FROM raw_scored)"
)
