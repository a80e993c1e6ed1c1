"""Metrics of scored tables (label, scores, y_pred)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cells(label: str, predicted: str) -> dict[str, Column]:
    y, p = F.col(label), F.col(predicted)
    return {
        "tn": F.count_if((y == 0) & (p == 0)),
        "fp": F.count_if((y == 0) & (p == 1)),
        "fn": F.count_if((y == 1) & (p == 0)),
        "tp": F.count_if((y == 1) & (p == 1)),
    }


def confusion(df: DataFrame, label: str = "y", predicted: str = "y_pred") -> DataFrame:
    """One row: tn, fp, fn, tp."""
    return df.agg(*[cell.alias(n) for n, cell in _cells(label, predicted).items()])


def accuracy(df: DataFrame, label: str = "y", predicted: str = "y_pred") -> DataFrame:
    """One row: share of rows predicted right, and the share predicted wrong."""
    right = F.avg((F.col(label) == F.col(predicted)).cast("double"))
    return df.agg(right.alias("accuracy")).withColumn("error", 1 - F.col("accuracy"))


def recall_precision(
    df: DataFrame, by: Sequence[str] = (), label: str = "y", predicted: str = "y_pred"
) -> DataFrame:
    """Recall and precision per group; 0 where nothing is there to find or was found."""
    cells = _cells(label, predicted)
    counted = df.groupBy(*by).agg(*[cell.alias(n) for n, cell in cells.items()])
    hit = F.col("tp")
    return counted.select(
        *by,
        F.coalesce(F.try_divide(hit, hit + F.col("fn")), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(hit, hit + F.col("fp")), F.lit(0.0)).alias("precision"),
    )


# Ranges of scores per group whose counts are added up in order.
RANGES = 4096


def roc_auc(df: DataFrame, by: Sequence[str] = (), label: str = "y", score: str = "scores") -> DataFrame:
    """(by, roc_auc): area under the ROC curve over all distinct scores of each group, all groups at once.

    It is the share of pairs of a positive and a negative row that the score puts in order, equal
    scores counting half. Rows are counted per score; scores are dealt to ranges of equal width, so a score
    needs the negatives of lower ranges, a table of at most ``RANGES`` rows per group, and those of
    lower scores in its own range. No sort holds a whole group. A group of one class has no area: null.
    """
    s = F.col(score).cast("double")
    scored = df.filter(s.isNotNull() & F.col(label).isNotNull()).select(*by, s.alias("_s"), label)
    counts = scored.groupBy(*by, "_s").agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg")
    )
    ends = counts.agg(F.min("_s").alias("_low"), F.max("_s").alias("_high"))
    share = F.try_divide(F.col("_s") - F.col("_low"), F.col("_high") - F.col("_low"))
    dealt = counts.join(F.broadcast(ends)).withColumn(  # one row
        "_range", F.coalesce(F.least(F.floor(share * RANGES), F.lit(RANGES - 1)), F.lit(0))
    )
    upto = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy(*by, "_range").agg(F.sum("_neg").alias("_all")).select(
        *[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)],
        F.col("_range").alias("_of"),
        F.coalesce(F.sum("_all").over(upto), F.lit(0)).alias("_before"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"_by_{i}")) for i, c in enumerate(by)]
    inside = Window.partitionBy(*by, "_range").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_before") + F.coalesce(F.sum("_neg").over(inside), F.lit(0))
    ordered = dealt.join(ranges, [F.col("_range") == F.col("_of"), *same]).withColumn("_below", below)
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    in_order = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2))
    return ordered.groupBy(*by).agg(F.try_divide(in_order, pairs).alias("roc_auc"))


def fold_metrics(df: DataFrame, fold: str = "fold", label: str = "y") -> DataFrame:
    """(fold, recall, precision, roc_auc) per fold, and their means in a row of fold -1: one lazy plan,
    whatever the number of folds."""
    measures = ("recall", "precision", "roc_auc")
    areas = roc_auc(df, [fold], label).withColumnRenamed(fold, "_fold")
    rates = recall_precision(df, [fold], label)
    each = rates.join(areas, F.col(fold).eqNullSafe(F.col("_fold")), "left")
    each = each.select(F.col(fold).cast("int").alias(fold), *measures)
    means = each.agg(F.lit(-1).alias(fold), *[F.avg(m).alias(m) for m in measures])
    return each.unionByName(means.filter(F.col("recall").isNotNull()))
