"""Frequent levels of columns, and everything else under one name."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from starling.operators.rates import highest


def level_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per combination of the columns: one pass from which each column's top levels can be taken."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def top_levels(counts: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent non-null values of a counted column; equal counts are ordered by value."""
    totals = counts.where(F.col(column).isNotNull()).groupBy(column).agg(F.sum("n").alias("n"))
    return highest(totals, "n", column, n)


def group_rare(df: DataFrame, counts: DataFrame, column: str, n: int, other: str, out: str) -> DataFrame:
    """Adds ``out``: the value if it is among the ``n`` most frequent, else ``other`` (NULL included).

    The frequent values are at most ``n`` rows, so Spark broadcasts them and the rows stay where they are.
    """
    keep = top_levels(counts, column, n).select(F.col(column).alias("_level"))
    return (df.join(keep, F.col(column) == F.col("_level"), "left")
            .withColumn(out, F.coalesce(F.col("_level"), F.lit(other))).drop("_level"))
