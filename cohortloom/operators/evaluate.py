"""Evaluation tables from predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .ranking import quantiles, running


def confusion(calls: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return calls.groupBy(*keys, "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def class_counts(calls: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn, tn and support per class, over all actual and predicted classes.

    Only the confusion table, classes by classes, is regrouped.
    """
    cm = confusion(calls, keys)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = F.explode(F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("as_actual"),
                 F.lit(0).cast("long").alias("as_predicted"), hit.cast("long").alias("hit")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("as_actual"),
                 F.col("n").alias("as_predicted"), F.lit(0).cast("long").alias("hit"))))
    per_class = cm.select(*keys, sides.alias("s")).groupBy(*keys, F.col("s.class").alias("class")).agg(
        F.sum("s.hit").alias("tp"), F.sum("s.as_actual").alias("support"),
        F.sum("s.as_predicted").alias("called"))
    if keys:
        totals = cm.groupBy(*keys).agg(F.sum("n").alias("total"))
        both = per_class.join(totals, list(keys))
    else:
        both = per_class.withColumn("total", cm.agg(F.sum("n").alias("n")).scalar())
    return both.select(
        *keys, "class", "tp", (F.col("called") - F.col("tp")).alias("fp"),
        (F.col("support") - F.col("tp")).alias("fn"),
        (F.col("total") - F.col("called") - F.col("support") + F.col("tp")).alias("tn"),
        "support")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_metrics(calls: DataFrame) -> DataFrame:
    """Sensitivity, specificity, Youden index and balanced accuracy per class."""
    c = F.col
    sens, spec = _ratio(c("tp"), c("tp") + c("fn")), _ratio(c("tn"), c("tn") + c("fp"))
    return class_counts(calls).select(
        "class", "tp", "fp", "fn", "tn", sens.alias("sensitivity"), spec.alias("specificity"),
        (sens + spec - 1).alias("youden_index"), sens.alias("balanced_accuracy"))


def class_report(calls: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class, then accuracy, macro and weighted rows."""
    c = F.col
    precision, recall = _ratio(c("tp"), c("tp") + c("fp")), _ratio(c("tp"), c("support"))
    per_class = class_counts(calls).select(
        "class", precision.alias("precision"), recall.alias("recall"),
        _ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1_score"), "support", "tp")
    total = F.sum("support")
    weighted = lambda m: _ratio(F.sum(F.col(m) * F.col("support")), total)
    accuracy = _ratio(F.sum("tp"), total)
    summary = per_class.agg(F.array(
        F.struct(F.lit("accuracy").alias("class"), accuracy.alias("precision"),
                 accuracy.alias("recall"), accuracy.alias("f1_score"), total.alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                 F.avg("recall").alias("recall"), F.avg("f1_score").alias("f1_score"),
                 total.alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), weighted("precision").alias("precision"),
                 weighted("recall").alias("recall"), weighted("f1_score").alias("f1_score"),
                 total.alias("support"))).alias("rows")).select(F.inline("rows"))
    return per_class.drop("tp").unionByName(summary)


def share_above(values: DataFrame, column: str, threshold: float,
                keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of values strictly above a threshold; 0 for no values."""
    share = F.coalesce(F.avg((F.col(column) > threshold).cast("double")), F.lit(0.0))
    return values.groupBy(*keys).agg(share.alias("share"))


def _steps(scores: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Positives and negatives at each distinct score.

    Written once: borders, totals and running sums all read the steps.
    """
    hit = F.col("actual") == F.col("class")
    return cut(scores.filter(F.col("score").isNotNull()).groupBy(*keys, "score").agg(
        F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg")))


def _sweep(steps: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """True and false positives at each distinct score, highest first."""
    return running(steps, list(keys), "score", ("pos", "neg"))


def roc_points(scores: DataFrame, keys: tuple[str, ...] = ("class",)) -> DataFrame:
    """Exact one-vs-rest ROC points, with the start point, for every class.

    ``scores`` holds (class, actual, score): each sample's score for each class,
    set against the indicator of that same class.
    """
    found = _steps(scores, keys)
    steps = _sweep(found, keys)
    rate = lambda c: F.try_divide(F.col(f"cum_{c}"), F.col(f"total_{c}"))
    points = steps.select(*keys, F.col("score").alias("threshold"),
                          rate("neg").alias("fpr"), rate("pos").alias("tpr"))
    start = found.select(*keys).distinct().select(
        *keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def roc_auc(scores: DataFrame, keys: tuple[str, ...] = ("class",)) -> DataFrame:
    """Trapezoid area under each curve.

    A step adds its negatives times the mean of the positives before and after.
    """
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2))
    return _sweep(_steps(scores, keys), keys).groupBy(*keys).agg(
        F.try_divide(area, F.max("total_pos") * F.max("total_neg")).alias("auc"))


def binary_scores(scored: DataFrame, keys: tuple[str, ...] = ("split",),
                  threshold: float = 0.5) -> DataFrame:
    """Accuracy, ROC-AUC and Brier score of (label 0/1, probability) per group."""
    keys = tuple(keys)
    called = (F.col("probability") >= threshold).cast("int")
    flat = scored.groupBy(*keys).agg(
        F.avg((called == F.col("label")).cast("double")).alias("accuracy"),
        F.avg(F.pow(F.col("probability") - F.col("label"), F.lit(2))).alias("brier_score"))
    areas = roc_auc(scored.select(*keys, F.lit(1).alias("class"), F.col("label").alias("actual"),
                                  F.col("probability").alias("score")), keys)
    return flat.join(areas.withColumnRenamed("auc", "roc_auc"), list(keys), "left")


def correct_calls(calls: DataFrame, bins: int = 10) -> DataFrame:
    """How sure the correct calls of each class are: counts per probability bin.

    A probability of exactly 1 falls in the last bin.
    """
    bin_no = F.least(F.floor(F.col("probability") * bins) + 1, F.lit(bins))
    return calls.filter(F.col("actual") == F.col("predicted")).groupBy(
        F.col("predicted").alias("class"), bin_no.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("probability").alias("lowest"),
        F.max("probability").alias("highest"))


def correct_call_quartiles(calls: DataFrame) -> DataFrame:
    """Five-number summary of the correct calls' probability per class, exact."""
    right = calls.filter(F.col("actual") == F.col("predicted")).select(
        F.col("predicted").alias("class"), "probability")
    each = quantiles(right, ["class"], "probability", [0.0, 0.25, 0.5, 0.75, 1.0])
    parts = F.sort_array(F.collect_list(F.struct("share", "value")))
    return each.groupBy("class").agg(F.max("n").alias("n"), parts.alias("q")).select(
        "class", "n", F.col("q.value").alias("quartiles"))
