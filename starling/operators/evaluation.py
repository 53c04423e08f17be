"""Confusion matrix, precision and recall of a probability column against a 0/1 label."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from starling.functions import safe_ratio


def confusion_counts(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row ``tn, fp, fn, tp``; a score equal to the threshold counts as predicted bad."""
    bad, flagged = F.col(label) == 1, F.col(score) >= threshold
    return df.agg(F.count_if(~bad & ~flagged).alias("tn"), F.count_if(~bad & flagged).alias("fp"),
                  F.count_if(bad & ~flagged).alias("fn"), F.count_if(bad & flagged).alias("tp"))


def confusion_matrix(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """The same as four rows (actual, predicted, n); empty cells are 0."""
    cells = F.array(*[F.struct(F.lit(actual).alias("actual"), F.lit(predicted).alias("predicted"),
                               F.col(cell).alias("n"))
                      for cell, actual, predicted in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])
    return confusion_counts(df, label, score, threshold).select(F.inline(cells))


def precision_recall(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """The counts with precision and recall, each 0 where nothing was flagged or nothing was bad."""
    tp = F.col("tp")
    return confusion_counts(df, label, score, threshold).withColumns({
        "precision": F.coalesce(safe_ratio(tp, tp + F.col("fp")), F.lit(0.0)),
        "recall": F.coalesce(safe_ratio(tp, tp + F.col("fn")), F.lit(0.0))})
