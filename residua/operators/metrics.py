"""Metrics of binary classifiers as aggregations and windows.

A table of predictions has y (0 or 1), p (probability) and any grouping columns;
``by`` names the columns that divide it, and rows with a null y or p count
nowhere. Everything but the ranking metrics is one aggregation. The ranking
metrics first combine equal probabilities, so that their windows run over
distinct values; without ``by`` those running sums go through range partitions
(``running``), never through a single task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.functions.scales import rounded
from residua.session import written


def _r(column: Column, digits: int = 4) -> Column:
    return F.floor(column * float(10**digits) + 0.5).cast("double") / float(10**digits)


def ratio(top: Column, bottom: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(bottom > 0, top.cast("double") / bottom).otherwise(F.lit(0.0))


def valid(df: DataFrame) -> DataFrame:
    return df.where("y is not null and p is not null")


def confusion(df: DataFrame, by: list[str] = [], threshold: float | Column = 0.5) -> DataFrame:  # noqa: B006
    """Counts and derived rates at a threshold."""
    hit = F.col("p") >= threshold
    counts = valid(df).groupBy(*by).agg(
        F.count_if((F.col("y") == 1) & hit).alias("tp"), F.count_if((F.col("y") == 0) & hit).alias("fp"),
        F.count_if((F.col("y") == 0) & ~hit).alias("tn"), F.count_if((F.col("y") == 1) & ~hit).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    sens, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return counts.select(
        *by, "tp", "fp", "tn", "fn", _r(sens).alias("sensitivity"), _r(spec).alias("specificity"), _r(ratio(tp, tp + fp)).alias("ppv"), _r(ratio(tn, tn + fn)).alias("npv"),
        _r((sens + spec) / 2).alias("balanced_accuracy"), _r(ratio(tp * 2, tp * 2 + fp + fn)).alias("f1"),
        _r(ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))).alias("mcc"),
    )


def losses(df: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Brier score and log loss, probabilities clipped at 1e-15."""
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("p")))
    y = F.col("y").cast("double")
    return valid(df).groupBy(*by).agg(F.count("*").alias("n"), _r(F.avg((p - y) * (p - y))).alias("brier"), _r(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p)))).alias("log_loss"))


def in_slots(df: DataFrame, order: list[Column], slots: int = 0) -> DataFrame:
    """Rows in range partitions with their number as ``_slot``.

    They are written once, since bounds are sampled and partitions merged anew
    each time a plan runs, and numbers must agree wherever they are read.
    """
    slots = slots or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(slots, *order).withColumn("_slot", F.spark_partition_id()), "slots")


def running(df: DataFrame, order: Column | list[Column], sums: dict[str, str], by: list[str] = [], slots: int = 0) -> DataFrame:  # noqa: B006
    """Adds ``sums`` (new column: summed column) as running sums in the order, within ``by``.

    Without ``by`` the rows are range-partitioned; each partition sums up, the
    totals of the partitions, one row each, are summed in turn and added.
    """
    if by:
        w = Window.partitionBy(*by).orderBy(*(order if isinstance(order, list) else [order])).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    orders = order if isinstance(order, list) else [order]
    spread = in_slots(df, orders, slots)
    w = Window.partitionBy("_slot").orderBy(*orders).rowsBetween(Window.unboundedPreceding, 0)
    totals = spread.groupBy("_slot").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as slots
    totals = totals.select("_slot", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    out = spread.withColumns({n: F.sum(c).over(w) for n, c in sums.items()}).join(F.broadcast(totals), "_slot")
    return out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_slot", *[f"_{n}" for n in sums])


def ranking(df: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """ROC-AUC by mean ranks, and average precision; 0.5 and the prevalence where one class is missing."""
    ties = valid(df).groupBy(*by, "p").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.count("*").alias("n"))
    steps = running(ties, F.col("p").desc(), {"cum_pos": "pos", "cum_n": "n"}, by)
    neg, above = F.col("n") - F.col("pos"), F.col("cum_pos") - F.col("pos")
    sums = steps.groupBy(*by).agg(
        F.sum("pos").alias("positives"), F.sum("n").alias("samples"),
        # each negative loses to the positives above it and half to its ties
        F.sum(neg * (above * 2 + F.col("pos"))).alias("won2"),
        F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")).alias("ap"),
    )
    pos, neg = F.col("positives").cast("double"), (F.col("samples") - F.col("positives")).cast("double")
    return sums.select(
        *by, "positives", "samples",
        _r(F.when((pos > 0) & (neg > 0), F.col("won2") / (pos * neg * 2)).otherwise(0.5)).alias("auroc"),
        _r(F.when((pos > 0) & (neg > 0), F.col("ap") / pos).otherwise(ratio(pos, F.col("samples")))).alias("auprc"),
    )


def edges(bins: int) -> list[float]:
    return [i * (1.0 / bins) for i in range(bins + 1)]


def width_bin(p: Column, bins: int = 10) -> Column:
    """Number of the equal-width bin, the last one closed; bounds are multiples of the width as doubles."""
    cuts = edges(bins)[1:-1]
    return reduce(lambda a, b: a + b, [F.when(p >= c, 1).otherwise(0) for c in cuts])


def reliability(df: DataFrame, by: list[str] = [], bins: int = 10) -> DataFrame:  # noqa: B006
    """(bin, n, confidence, accuracy) of equal-width bins; empty bins have their midpoint for both."""
    counted = valid(df).groupBy(*by, width_bin(F.col("p"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("c"), F.avg("y").alias("a"))
    every = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    every = every.crossJoin(F.broadcast(df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))))  # a fixed number of bins
    middle = (F.col("bin") + 0.5) / bins
    joined = every.join(counted, [*by, "bin"], "left")
    return joined.select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"), _r(F.coalesce("c", middle)).alias("confidence"), _r(F.coalesce("a", middle)).alias("accuracy"))


def ece(df: DataFrame, by: list[str] = [], bins: int = 10) -> DataFrame:  # noqa: B006
    """Expected calibration error over equal-width bins."""
    per = valid(df).groupBy(*by, width_bin(F.col("p"), bins).alias("_bin")).agg(F.count("*").alias("n"), F.avg("p").alias("c"), F.avg("y").alias("a"))
    return per.groupBy(*by).agg(_r(F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias("ece"))


def ranked(df: DataFrame, order: list[Column], by: list[str] = [], name: str = "rank", slots: int = 0) -> DataFrame:  # noqa: B006
    """Adds the row's number in the order, without bringing all rows to one task."""
    if by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    spread = in_slots(df, order, slots)
    counts = spread.groupBy("_slot").count()
    before = counts.select("_slot", F.coalesce(F.sum("count").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = spread.withColumn(name, F.row_number().over(Window.partitionBy("_slot").orderBy(*order)).cast("long")).join(F.broadcast(before), "_slot")
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_slot", "_before")


def chunked(df: DataFrame, bins: int, order: list[Column], name: str = "bin") -> DataFrame:
    """Adds the number (from 0) of the equal-count bin; the first bins take the remainder, as ``ntile`` does."""
    n = df.count()
    size, extra = divmod(n, bins)
    position = F.col("_rank") - 1
    inside = F.when(position < extra * (size + 1), F.floor(position / (size + 1))).otherwise(extra + F.floor((position - extra * (size + 1)) / max(size, 1)))
    return ranked(df, order, name="_rank").withColumn(name, inside.cast("int")).drop("_rank")


def adaptive(df: DataFrame, bins: int = 15) -> DataFrame:
    """(bin, n, confidence, accuracy, low, high) of equal-count bins, ties by id."""
    cut = chunked(valid(df), bins, [F.col("p"), F.col("id")])
    return cut.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("confidence"), F.avg("y").alias("accuracy"), F.min("p").alias("low"), F.max("p").alias("high"))


def adaptive_ece(df: DataFrame, bins: int = 15) -> DataFrame:
    per = adaptive(df, bins)
    return per.agg(_r(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("adaptive_ece"))


def top_precision(df: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """Precision among the k highest probabilities of each group, and its ratio to the prevalence."""
    w = Window.partitionBy(*by).orderBy(F.col("p").desc(), "id")
    ranked_ = valid(df).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)  # a limit that Spark pushes below the shuffle
    hits = ranked_.groupBy(*by).agg(F.avg("y").alias("hit"), F.count("*").cast("int").alias("k"))
    base = valid(df).groupBy(*by).agg(F.avg("y").alias("base"), F.count("*").alias("n"))
    return base.join(hits, by).select(*by, "n", "k", _r(F.col("hit")).alias("precision_at_k"), _r(F.when(F.col("base") > 0, F.col("hit") / F.col("base")).otherwise(1.0), 2).alias("enrichment"))


def recall_at_precision(df: DataFrame, levels: list[float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """Largest recall at which precision is still at a level; equal probabilities count together."""
    ties = valid(df).groupBy(*by, "p").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.count("*").alias("n"))
    steps = running(ties, F.col("p").desc(), {"cum_pos": "pos", "cum_n": "n"}, by)
    best = steps.groupBy(*by).agg(
        F.sum("pos").alias("positives"),
        *[F.max(F.when(F.col("cum_pos") / F.col("cum_n") >= v, F.col("cum_pos"))).alias(f"b{i}") for i, v in enumerate(levels)],
    )
    return best.select(*by, *[_r(ratio(F.coalesce(f"b{i}", F.lit(0)), F.col("positives"))).alias(f"recall_at_p{round(v * 100)}") for i, v in enumerate(levels)])


def threshold_table(df: DataFrame, grid: list[float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by..., threshold, tp, fp, fn, tn) for every threshold of a fixed grid.

    Each prediction falls between two thresholds; only the counts between them
    are summed up, so that the grid never multiplies the predictions. ``by``
    columns must not be null.
    """
    spark = df.sparkSession
    cuts = F.array(*[F.lit(g) for g in grid])
    # thresholds p reaches: binary search by the array's own order
    reached = F.size(F.filter(cuts, lambda g: g <= F.col("p")))
    counts = valid(df).groupBy(*by, "p").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.count("*").alias("n")).withColumn("reached", reached)
    steps = counts.groupBy(*by, "reached").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    table = spark.createDataFrame([(i + 1, float(g)) for i, g in enumerate(grid)], "step int, threshold double")
    totals = steps.groupBy(*by).agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("all_pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("all_n"))
    # both sides have at most as many rows as the grid, for each group
    steps = steps.select(*[F.col(c).alias(f"_{c}") for c in by], "reached", "pos", "n")
    met = F.col("reached") >= F.col("step")
    for c in by:
        met &= F.col(c) == F.col(f"_{c}")
    joined = totals.crossJoin(F.broadcast(table)).join(steps, met, "left").groupBy(*by, "threshold", "all_pos", "all_n").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("called"))
    return joined.select(*by, "threshold", "tp", (F.col("called") - F.col("tp")).alias("fp"), (F.col("all_pos") - F.col("tp")).alias("fn"), (F.col("all_n") - F.col("all_pos") - F.col("called") + F.col("tp")).alias("tn"))


def threshold_rates(df: DataFrame, grid: list[float]) -> DataFrame:
    t = threshold_table(df, grid)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return t.select("threshold", _r(ratio(tp, tp + fn)).alias("recall"), _r(ratio(fp, fp + tn)).alias("fpr"), _r(ratio(tn, tn + fp)).alias("specificity"), _r(ratio(tp, tp + fp)).alias("ppv"))


def constrained_threshold(df: DataFrame, grid: list[float], recall: float | None = None, fpr: float | None = None) -> DataFrame:
    """The threshold that meets the constraints, with the rule by which it was chosen.

    Recall asks for the highest threshold, FPR alone for the lowest; where both
    cannot be met, recall goes first; where nothing can, an end of the grid is taken.
    """
    rates = threshold_rates(df, grid)
    meets_recall, meets_fpr = F.col("recall") >= (recall or 0.0), F.col("fpr") <= (1.0 if fpr is None else fpr)
    if recall is not None and fpr is not None:
        priority, side = F.when(meets_recall & meets_fpr, 0).when(meets_recall, 1).otherwise(2), F.when(meets_recall, -F.col("threshold")).otherwise(F.col("threshold"))
        basis = ("joint_constraint", "prioritized_recall", "fallback_lowest_threshold")
    elif recall is not None:
        priority, side = F.when(meets_recall, 0).otherwise(1), F.when(meets_recall, -F.col("threshold")).otherwise(F.col("threshold"))
        basis = ("target_recall", "fallback_lowest_threshold")
    elif fpr is not None:
        priority, side = F.when(meets_fpr, 0).otherwise(1), F.when(meets_fpr, F.col("threshold")).otherwise(-F.col("threshold"))
        basis = ("max_fpr", "fallback_highest_threshold")
    else:
        priority, side = F.when(F.col("threshold") >= 0.5, 0).otherwise(1), F.col("threshold")
        basis = ("default_midpoint", "default_midpoint")
    best = rates.withColumn("k", F.struct(priority.alias("a"), side.alias("b"))).agg(F.min_by(F.struct("threshold", "recall", "fpr", "specificity", "ppv", F.col("k.a").alias("a")), "k").alias("r"))
    return best.select("r.threshold", F.element_at(F.array(*[F.lit(b) for b in basis]), F.col("r.a") + 1).alias("basis"), "r.recall", "r.fpr", "r.specificity", "r.ppv")


def bootstrap(df: DataFrame, cluster: str, metric: str = "brier", draws: int = 200, seed: int = 1) -> DataFrame:
    """(point, low, high, draws) of a metric over resampled clusters.

    A draw takes as many clusters as there are, with repetition, by a hash of
    draw and slot; how often each cluster is drawn is counted per draw before the
    clusters' sums are joined, so that predictions are read once. The point is
    the mean over the draws.
    """
    y, p = F.col("y").cast("double"), F.col("p")
    sums = valid(df).groupBy(cluster).agg(F.count("*").alias("n"), F.sum((p - y) * (p - y)).alias("loss"), F.count_if((p >= 0.5) == (y == 1)).alias("right"))
    sums = ranked(sums, [F.col(cluster)], name="slot")
    n = sums.count()
    if not n:
        return df.sparkSession.createDataFrame([], "point double, low double, high double, draws long")
    picks = df.sparkSession.range(draws * n).select((F.expr(f"id div {n}")).alias("draw"), (F.col("id") % n + 1).alias("i"))
    word = F.md5(F.concat_ws(":", F.lit(seed), "draw", "i"))
    picked = picks.select("draw", (F.conv(F.substring(word, 1, 8), 16, 10).cast("long") % n + 1).alias("slot")).groupBy("draw", "slot").agg(F.count("*").alias("times"))
    value = {"brier": F.sum(F.col("times") * F.col("loss")), "accuracy": F.sum(F.col("times") * F.col("right"))}[metric] / F.sum(F.col("times") * F.col("n"))
    per = picked.join(sums, "slot").groupBy("draw").agg(value.alias("v"))
    return per.agg(_r(F.avg("v")).alias("point"), _r(F.expr("percentile(v, 0.025)")).alias("low"), _r(F.expr("percentile(v, 0.975)")).alias("high"), F.count("*").alias("draws"))


def ppv_at(sensitivity: str, specificity: str, prevalence: str) -> str:
    """PPV at a prevalence as SQL; 0 where nothing is called."""
    bottom = f"({sensitivity} * {prevalence} + (1e0 - {specificity}) * (1e0 - {prevalence}))"
    return f"CASE WHEN {bottom} > 0 THEN {rounded(f'{sensitivity} * {prevalence} / {bottom}', 4)} ELSE 0e0 END"
