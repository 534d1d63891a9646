"""Models fitted with Spark ML: calibrators, forests, validation against another sample."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.session import written


def logit(p: str, eps: float = 1e-6) -> Column:
    c = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p)))
    return F.ln(c / (1 - c))


def balanced(df: DataFrame, label: str = "y") -> DataFrame:
    """Adds ``weight``: n / (2 n of the class)."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_t"))
    return df.join(F.broadcast(sizes.crossJoin(total)), label).withColumn("weight", F.col("_t") / (F.col("_n") * 2)).drop("_n", "_t")  # two rows


def sigmoid_fit(df: DataFrame, c: float = 1.0) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of y on the logit of p, penalised as 1 / (c n)."""
    rows = df.where("y is not null and p is not null").select(F.col("y").cast("double").alias("label"), array_to_vector(F.array(logit("p"))).alias("features"))
    n = max(rows.count(), 1)
    model = LogisticRegression(regParam=1 / (c * n), standardization=False, maxIter=100, tol=1e-9).fit(rows)
    return float(model.coefficients[0]), float(model.intercept)


def sigmoid_apply(p: str, coef: float, intercept: float) -> Column:
    return 1 / (1 + F.exp(-(logit(p) * coef + intercept)))


def isotonic(df: DataFrame) -> DataFrame:
    """(boundary, prediction) of the isotonic fit of y on p."""
    rows = df.where("y is not null and p is not null").groupBy("p").agg(F.avg("y").alias("label"), F.count("*").cast("double").alias("weight"))
    model = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="weight").fit(rows)
    return df.sparkSession.createDataFrame(list(zip([float(b) for b in model.boundaries], [float(p) for p in model.predictions])), "boundary double, prediction double")


def temperature(df: DataFrame, grid: list[float]) -> DataFrame:
    """(temperature, brier) of the grid value with the smallest Brier score; ties to the smaller temperature.

    All temperatures are scored in one aggregation.
    """
    z = logit("p")
    rows = df.where("y is not null and p is not null")
    scores = rows.agg(*[F.avg(F.pow(1 / (1 + F.exp(-z / t)) - F.col("y"), F.lit(2.0))).alias(f"t{i}") for i, t in enumerate(grid)])
    pairs = F.array(*[F.struct(F.round(F.col(f"t{i}"), 9).alias("brier"), F.lit(t).alias("temperature")) for i, t in enumerate(grid)])
    return scores.select(F.array_min(pairs).alias("b")).select("b.temperature", "b.brier")


def out_of_fold(df: DataFrame, estimator, folds: int = 3, features: str = "vec", even: bool = False) -> DataFrame:
    """(id, y, p) with each row scored by a model that never saw its fold; ``df`` has id, y, fold and a vector.

    ``even`` weighs the classes of each training part alike.
    """
    rows = written(df.select("id", F.col("y").cast("double").alias("label"), "fold", array_to_vector(features).alias("raw")), "folds")
    parts = []
    for fold in range(folds):
        train = rows.where(F.col("fold") != fold)
        if even:
            train, estimator = balanced(train, "label"), estimator.copy().setWeightCol("weight")
        pipeline = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True), estimator])
        model = pipeline.fit(train)
        parts.append(model.transform(rows.where(F.col("fold") == fold)).select("id", F.col("label").cast("int").alias("y"), vector_to_array("probability")[1].alias("p")))
    return reduce(DataFrame.union, parts)


def forest(trees: int = 30, depth: int = 6) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=1)


def boosted(rounds: int = 10, depth: int = 4) -> GBTClassifier:
    return GBTClassifier(maxIter=rounds, maxDepth=depth, seed=1)


def logistic(c: float = 0.5, n: int = 1000) -> LogisticRegression:
    return LogisticRegression(regParam=1 / (c * n), standardization=False, maxIter=100)


def shifted(base: DataFrame, now: DataFrame, folds: int = 3) -> DataFrame:
    """Out-of-fold scores of telling two samples (id, vec) apart; AUROC near 0.5 means no shift."""
    both = base.select("id", "vec", F.lit(0).alias("y")).union(now.select("id", "vec", F.lit(1)))
    fold = F.conv(F.substring(F.md5(F.concat_ws(":", "y", "id")), 1, 4), 16, 10).cast("long") % folds
    return out_of_fold(both.withColumn("fold", fold), logistic(), folds)


def perceptron(inputs: int, hidden: tuple[int, ...] = (64, 32)) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(layers=[inputs, *hidden, 2], maxIter=60, seed=1)


def _auroc(scored: DataFrame) -> float:
    from residua.operators.metrics import ranking

    return float(ranking(scored).first().auroc or 0.5)


def tuned(df: DataFrame, grid: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0), features: str = "vec") -> tuple[float, DataFrame]:
    """Penalty with the best AUROC on ``inner_calibration``, and scores (id, y, p) of ``outer_test`` after a fit on all other rows.

    ``df`` has id, y, partition and a vector. Equal values go to the smaller
    penalty constant.
    """
    rows = written(df.select("id", F.col("y").cast("double").alias("label"), "partition", array_to_vector(features).alias("raw")), "partitions")
    inner, held, test = (rows.where(F.col("partition") == p) for p in ("inner_train", "inner_calibration", "outer_test"))

    def fitted(train: DataFrame, c: float) -> PipelineModel:
        return Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True), logistic(c, max(1, train.count()))]).fit(train)

    def scores(model: PipelineModel, some: DataFrame) -> DataFrame:
        return model.transform(some).select("id", F.col("label").cast("int").alias("y"), vector_to_array("probability")[1].alias("p"))

    best = max(grid, key=lambda c: (_auroc(scores(fitted(inner, c), held)), -c))
    return best, scores(fitted(inner.union(held), best), test)


def stacked(df: DataFrame, one: str, two: str, folds: int = 3) -> DataFrame:
    """(id, y, p) of a logistic model over the out-of-fold scores of two logistic models, itself out of fold."""
    first, second = (out_of_fold(df.select("id", "y", "fold", F.col(c).alias("vec")), logistic(), folds) for c in (one, two))
    both = first.select("id", F.col("p").alias("p1")).join(second.select("id", F.col("p").alias("p2")), "id")
    meta = df.select("id", "y", "fold").join(both, "id").select("id", "y", "fold", F.array("p1", "p2").alias("vec"))
    return out_of_fold(meta, logistic(), folds)


def important(df: DataFrame, k: int = 50, features: str = "vec") -> list[int]:
    """Places of the k features that a forest on (y, vector) uses most, ties to the smaller place."""
    rows = df.where("y is not null").select(F.col("y").cast("double").alias("label"), array_to_vector(features).alias("features"))
    weights = forest().fit(rows).featureImportances.toArray()
    return sorted(sorted(range(len(weights)), key=lambda i: (-weights[i], i))[:k])


def chosen(vector: str, places: list[int]) -> Column:
    return F.array(*[F.col(vector)[i] for i in places])


def permutation_importance(df: DataFrame, estimator, places: list[int], folds: int = 3, blocks: int = 64) -> DataFrame:
    """(place, drop): how far the AUROC on held-out rows falls when the values of a place are exchanged between rows.

    ``df`` has id, y, fold and vec. Models are fitted once for each fold; values
    are exchanged within blocks of rows cut by digest.
    """
    rows = written(df.select("id", "y", "fold", "vec"), "rows")
    models = []
    for fold in range(folds):
        train = rows.where(F.col("fold") != fold).select(F.col("y").cast("double").alias("label"), array_to_vector("vec").alias("raw"))
        models.append(Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True), estimator]).fit(train))

    def scored(some: DataFrame) -> float:
        parts = [m.transform(some.where(F.col("fold") == f).select("id", "y", array_to_vector("vec").alias("raw"))).select("id", "y", vector_to_array("probability")[1].alias("p")) for f, m in enumerate(models)]
        return _auroc(reduce(DataFrame.union, parts))

    whole = scored(rows)
    out = []
    for place in places:
        word = F.md5(F.concat_ws(":", F.lit(place), F.col("id")))
        spread = rows.withColumn("block", F.conv(F.substring(word, 1, 4), 16, 10).cast("int") % blocks)
        here = spread.withColumn("at", F.row_number().over(Window.partitionBy("fold", "block").orderBy(word, "id")))
        there = spread.select("fold", "block", F.col("vec")[place].alias("other"), F.row_number().over(Window.partitionBy("fold", "block").orderBy(F.md5(word), "id")).alias("at"))
        mixed = here.join(there, ["fold", "block", "at"]).withColumn("vec", F.transform("vec", lambda x, i: F.when(i == place, F.col("other")).otherwise(x)))
        out.append((place, round(whole - scored(mixed), 4)))
    return df.sparkSession.createDataFrame(out, "place int, drop double")


def chosen_calibrator(df: DataFrame, grid: list[float], few: int = 1000) -> str:
    """Name of the calibrator for (y, p): with few rows sigmoid or temperature, else isotonic or sigmoid, by Brier score.

    Equal scores go to temperature and isotonic. All are judged on the rows they were fitted on.
    """
    rows = written(df.where("y is not null and p is not null").select("y", "p"), "scores")
    loss = lambda p: rows.agg(F.avg(F.pow(p - F.col("y"), F.lit(2.0)))).first()[0]
    coef, intercept = sigmoid_fit(rows)
    sigmoid = loss(sigmoid_apply("p", coef, intercept))
    if rows.count() < few:
        return "temperature" if temperature(rows, grid).first().brier <= sigmoid else "sigmoid"
    steps = isotonic(rows).select(F.sort_array(F.collect_list(F.struct("boundary", "prediction"))).alias("steps"))
    # one row of steps, as many as the fit has
    last = F.expr("element_at(filter(steps, s -> s.boundary <= p), -1).prediction")
    fitted = rows.crossJoin(F.broadcast(steps)).agg(F.avg(F.pow(last - F.col("y"), F.lit(2.0)))).first()[0]
    return "isotonic" if fitted <= sigmoid else "sigmoid"


def calibration_report(df: DataFrame, folds: int = 3) -> DataFrame:
    """(fold, n, before, after): Brier scores of rows (y, p, fold) before and after a sigmoid fitted on the other folds."""
    rows = written(df.where("y is not null and p is not null").select("y", "p", "fold"), "scores")
    out = []
    for fold in range(folds):
        coef, intercept = sigmoid_fit(rows.where(F.col("fold") != fold))
        out.append(rows.where(F.col("fold") == fold).withColumn("q", sigmoid_apply("p", coef, intercept)))
    square = lambda c: F.floor(F.avg(F.pow(F.col(c) - F.col("y"), F.lit(2.0))) * 10_000 + 0.5) / 10_000
    return reduce(DataFrame.union, out).groupBy("fold").agg(F.count("*").alias("n"), square("p").alias("before"), square("q").alias("after"))


def save(model: PipelineModel, path: str) -> None:
    """Write a fitted pipeline, over what was there."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel | None:
    """The fitted pipeline at ``path``; None where there is none that can be read."""
    try:
        return PipelineModel.load(path)
    except Exception:  # the caller falls back on the closed-form scores
        return None
