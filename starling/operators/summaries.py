"""Summaries of a bounded size that add up: kept per month, file or day, merged when asked for, each with a stated error.

The exact figures in ``ordered`` stay the default; these serve tables that are read too often, or are too large, to be
read again for every report.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from starling.functions import safe_ratio
from starling.operators.lookups import look_up
from starling.operators.ordered import SPREAD

#: Most bins of a score histogram, and the size parameter of a quantile sketch.
BINS, SKETCH_SIZE = 10_000, 1024
# Fixed values of the published analysis of the sketch: its rank error at 99 % confidence is 2.296 / size ** 0.9723.
ERROR_FACTOR, ERROR_POWER = 2.296, 0.9723


# ---------------------------------------------------------------- scores of two classes

def score_histogram(df: DataFrame, label: str, score: str, by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """Rows of either class (``pos``, ``neg``) per group and equal bin of a score from 0 to 1, the last bin with both its
    ends. Scores beyond count in the end bins; rows without a score or label take no part. Empty bins are absent."""
    if not 1 <= bins <= BINS:
        raise ValueError(f"from 1 to {BINS} bins")
    place = F.greatest(F.lit(0), F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))).cast("int")
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    bad = F.col(label).cast("long")
    return known.groupBy(*by, place.alias("bin")).agg(F.sum(bad).alias("pos"), F.sum(1 - bad).alias("neg"))


def merge_histograms(parts: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """One histogram of several over the same bins; of a table that holds several, the one of ``by`` alone."""
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(*by, "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def binned_auc(histogram: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group the chance that a bad row scores above a good one, pairs of one bin counting half, and ``error_bound``: the
    exact figure differs by no more, as only pairs within a bin can. NULL with one class."""
    below = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)    # over a row per bin
    lower = histogram.withColumn("lower", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return (lower.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.sum(F.col("pos") * (F.col("lower") + F.col("neg") / 2)).alias("wins"),
        F.sum(F.col("pos").cast("double") * F.col("neg") / 2).alias("unsure"))
        .select(*by, "n_pos", "n_neg", safe_ratio(F.col("wins"), pairs).alias("auc"),
                safe_ratio(F.col("unsure"), pairs).alias("error_bound")))


def binned_roc(histogram: DataFrame, by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """Points of the curve at the lower end of every bin that holds a row, from (0, 0) with a NULL threshold to (1, 1): those
    of the exact curve at these thresholds."""
    group = Window.partitionBy(*by)
    from_above = group.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    points = histogram.select(
        *by, (F.col("bin") / bins).alias("threshold"),
        safe_ratio(F.sum("neg").over(from_above).cast("double"), F.sum("neg").over(group)).alias("fpr"),
        safe_ratio(F.sum("pos").over(from_above).cast("double"), F.sum("pos").over(group)).alias("tpr"))
    start = histogram.select(*by).distinct() if by else histogram.sparkSession.range(1).select()
    return points.unionByName(start.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
                                           F.lit(0.0).alias("tpr")))


# ---------------------------------------------------------------- quantiles

def rank_error(size: int = SKETCH_SIZE) -> float:
    """By how much of all rows the rank of a quantile from a sketch is off, at most, in 99 of 100 cases."""
    return ERROR_FACTOR / size ** ERROR_POWER


def quantile_sketches(df: DataFrame, by: Sequence[str], value: str, size: int = SKETCH_SIZE) -> DataFrame:
    """One mergeable ``sketch`` of the values of each group, in one pass: tasks send sketches, not values. NULL and NaN
    take no part."""
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return known.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sketches of several parts or finer groups merged into one for each ``by``."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def quartiles(sketches: DataFrame) -> DataFrame:
    """``n``, ``q1``, ``median`` and ``q3`` in place of the sketch, each within ``rank_error`` of its rank."""
    def at(share: float) -> Column:
        return F.kll_sketch_get_quantile_double("sketch", F.lit(share))
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], F.kll_sketch_get_n_double("sketch").alias("n"),
                           at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))


def five_numbers_from(sketches: DataFrame, df: DataFrame, by: str, value: str) -> DataFrame:
    """Box-plot figures per group with quartiles from merged sketches. Whiskers and outliers are counted exactly for these
    quartiles, in one more pass that sorts nothing and spreads a hot group over tasks."""
    boxes = quartiles(sketches).withColumnRenamed(by, "_group")
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    known = df.select(by, value).where(F.col(by).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return (look_up(known, boxes, by, "_group", spread_by=value, salts=SPREAD).groupBy(by, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("_low"), F.max(F.when(inside, F.col(value))).alias("_high"),
        F.count_if(~inside).alias("n_outliers"))
        .select(by, "n", "q1", "median", "q3", F.least("_low", "q1").alias("low_whisker"),
                F.greatest("_high", "q3").alias("high_whisker"), "n_outliers"))
