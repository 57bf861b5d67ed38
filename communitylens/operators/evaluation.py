"""Classifier evaluation from predictions, or from their stored histogram, without collecting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from communitylens.functions.labels import guarded_ratio
from communitylens.operators.ordered import with_part
from communitylens.session import cut_lineage


def confusion(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: tn, fp, fn, tp."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    return predictions.agg(
        F.count(F.when((y == 0) & (p == 0), 1)).alias("tn"),
        F.count(F.when((y == 0) & (p == 1), 1)).alias("fp"),
        F.count(F.when((y == 1) & (p == 0), 1)).alias("fn"),
        F.count(F.when((y == 1) & (p == 1), 1)).alias("tp"),
    )


def confusion_matrix(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows true_0 and true_1 with columns pred_0 and pred_1."""
    counts = confusion(predictions, label, prediction)
    return counts.select(F.inline(F.array(
        F.struct(F.lit("true_0").alias("truth"), F.col("tn").alias("pred_0"), F.col("fp").alias("pred_1")),
        F.struct(F.lit("true_1").alias("truth"), F.col("fn").alias("pred_0"), F.col("tp").alias("pred_1")),
    )))


def classification(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall and f1 from tn, fp, fn, tp; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        guarded_ratio(tn + tp, tn + fp + fn + tp).alias("accuracy"),
        guarded_ratio(tp, tp + fp).alias("precision"),
        guarded_ratio(tp, tp + fn).alias("recall"),
        guarded_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def histogram(predictions: DataFrame, label: str = "label", score: str = "prob", digits: int | None = None) -> DataFrame:
    """(threshold, positives, negatives, _bin) per distinct score; bins hold about equally many distinct scores.

    Stored, so that the bins' bounds and every measure read the counts and not the predictions. All
    measures of one table can share it: they take it in place of the predictions.
    """
    if "_bin" in predictions.columns:
        return predictions
    y = F.col(label).cast("int")
    value = F.col(score) if digits is None else F.round(score, digits)
    distinct = cut_lineage(predictions.groupBy(value.cast("double").alias("threshold")).agg(
        F.count(F.when(y == 1, 1)).alias("positives"), F.count(F.when(y == 0, 1)).alias("negatives")))
    return with_part(distinct, "threshold", "_bin")


def auc(predictions: DataFrame, label: str = "label", score: str = "prob") -> DataFrame:
    """Area under the ROC curve, ties averaged; null when a class is missing.

    For each positive, the negatives scored below it plus half of those tied. Counts
    run inside 256 bins between quantiles of the distinct scores, whatever their scale, and are
    shifted by bin totals, so no task orders all scores.
    """
    pos, neg = F.col("positives"), F.col("negatives")
    lower = Window.partitionBy("_bin").orderBy("threshold").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        histogram(predictions, label, score)
        .withColumn("_below", F.coalesce(F.sum("negatives").over(lower), F.lit(0)))
        .groupBy("_bin")
        .agg(
            F.sum(pos).cast("double").alias("_pos"), F.sum(neg).cast("double").alias("_neg"),
            F.sum(pos * (F.col("_below") + neg / 2)).alias("_pairs"),
        )
    )
    lower_bins = Window.partitionBy().orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    shifted = bins.withColumn("_shift", F.coalesce(F.sum("_neg").over(lower_bins), F.lit(0.0)))
    return shifted.agg(
        F.try_divide(
            F.sum(F.col("_pairs") + F.col("_pos") * F.col("_shift")), F.sum("_pos") * F.sum("_neg")
        ).alias("auc")
    )


def _cumulative(predictions: DataFrame, label: str, score: str, digits: int | None) -> DataFrame:
    """(threshold, positives, negatives, tp, fp, all_pos, all_neg): counts at or above each distinct score."""
    counts = histogram(predictions, label, score, digits)
    # At most one row per bin: a bounded table, and the only one ordered as a whole.
    higher_bins = Window.partitionBy().orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    shifts = (
        counts.groupBy("_bin").agg(F.sum("positives").alias("_p"), F.sum("negatives").alias("_n"))
        .select(
            "_bin",
            F.coalesce(F.sum("_p").over(higher_bins), F.lit(0)).alias("_shift_p"),
            F.coalesce(F.sum("_n").over(higher_bins), F.lit(0)).alias("_shift_n"),
            F.sum("_p").over(everything).alias("all_pos"),
            F.sum("_n").over(everything).alias("all_neg"),
        )
    )
    within_bin = (
        Window.partitionBy("_bin").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        counts.withColumns({
            "_tp": F.sum("positives").over(within_bin), "_fp": F.sum("negatives").over(within_bin),
        })
        .join(shifts, "_bin")
        .select(
            "threshold", "positives", "negatives",
            (F.col("_tp") + F.col("_shift_p")).alias("tp"), (F.col("_fp") + F.col("_shift_n")).alias("fp"),
            "all_pos", "all_neg",
        )
    )


def roc_curve(predictions: DataFrame, label: str = "label", score: str = "prob", digits: int | None = None) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score; ``digits`` rounds scores for a shorter curve.

    The point (0, 0) above the largest score is implied.
    """
    c = _cumulative(predictions, label, score, digits)
    return c.select("threshold", guarded_ratio("fp", "all_neg").alias("fpr"), guarded_ratio("tp", "all_pos").alias("tpr"))


def _precision(tp: Column, fp: Column) -> Column:
    return F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(1.0))


def pr_curve(predictions: DataFrame, label: str = "label", score: str = "prob", digits: int | None = None) -> DataFrame:
    """(threshold, precision, recall) for every distinct score; the point (recall 0, precision 1) is implied."""
    c = _cumulative(predictions, label, score, digits)
    return c.select(
        "threshold", _precision(F.col("tp"), F.col("fp")).alias("precision"),
        guarded_ratio("tp", "all_pos").alias("recall"),
    )


def average_precision_area(predictions: DataFrame, label: str = "label", score: str = "prob") -> DataFrame:
    """Area under the precision-recall curve by trapezoids.

    A threshold's own counts give the point before it, so no neighbour is looked up.
    """
    c = _cumulative(predictions, label, score, None)
    tp, fp = F.col("tp"), F.col("fp")
    before = _precision(tp - F.col("positives"), fp - F.col("negatives"))
    step = guarded_ratio("positives", "all_pos")
    return c.agg(F.sum(step * (_precision(tp, fp) + before) / 2).alias("aupr"))
