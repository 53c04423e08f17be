"""Grouped rates with minimum support, overall figures, value counts, histograms and table profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from starling.functions import clip, flag, percent
from starling.operators.lookups import look_up
from starling.operators.membership import in_list
from starling.session import settled

BAD = "is_bad_review"


def keep_listed(df: DataFrame, **chosen: Sequence | DataFrame) -> DataFrame:
    """Rows whose columns hold one of the chosen values, given as a list of any length or as a table. An empty list filters
    nothing; an empty table keeps nothing."""
    for column, values in chosen.items():
        if isinstance(values, DataFrame) or values:
            df = in_list(df, column, values)
    return df


def grouped_rates(df: DataFrame, key: str, min_orders: int = 0, **extra: Column) -> DataFrame:
    """Bad-review rate and order count per non-null ``key``, for groups of at least ``min_orders``.

    The NULL group is dropped after the counting: as a condition on rows, a computed key would be worked out
    again in the scan's filter.
    """
    columns = [F.avg(BAD).alias("bad_rate"), F.count(BAD).alias("n_orders"), F.count(key).alias("_keyed")]
    columns += [measure.alias(name) for name, measure in extra.items()]
    return (df.groupBy(key).agg(*columns)
            .where((F.col("n_orders") >= min_orders) & (F.col("_keyed") > 0)).drop("_keyed")
            .withColumn("bad_rate_pct", percent(F.col("bad_rate"))))


def overall_figures(df: DataFrame) -> DataFrame:
    """One row; zero orders give NULL means."""
    return df.agg(F.count(F.lit(1)).alias("n_orders"), F.avg("review_score").alias("avg_review"),
                  percent(F.avg(BAD)).alias("bad_rate_pct"),
                  F.avg("delivery_time_days").alias("avg_delivery"),
                  F.avg("delivery_delay_days").alias("avg_delay"))


def highest(df: DataFrame, by: str, name: str, n: int) -> DataFrame:
    """The ``n`` rows with the largest ``by``; equal values are ordered by ``name``."""
    return df.orderBy(F.desc(by), F.asc(name)).limit(n)


def lowest(df: DataFrame, by: str, name: str, n: int) -> DataFrame:
    return df.orderBy(F.asc(by), F.asc(name)).limit(n)


def ascending(top: DataFrame, by: str, name: str) -> DataFrame:
    """A finished ranking turned round, as a bar chart that grows upwards wants it."""
    return top.orderBy(F.asc(by), F.asc(name))


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows per non-null value. Values are counted rather than rows, so the NULL group comes out as 0."""
    return df.groupBy(column).agg(F.count(column).alias(name)).where(F.col(name) > 0)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def share(condition: Column) -> Column:
    """Part of all rows that meet the condition; a row where it is NULL does not meet it."""
    return F.avg(F.coalesce(flag(condition), F.lit(0)))


def histogram(df: DataFrame, value: str, split: str, low: float, high: float, bins: int,
              own_range: bool = False) -> DataFrame:
    """Rows per class and equal-width bin of ``value`` clipped to ``[low, high]``; the top edge falls in the
    last bin. ``own_range`` spans each class's bins over its own clipped range instead. Empty bins are absent."""
    clipped = df.select(F.col(split), clip(F.col(value), low, high).cast("double").alias("_v")).dropna()
    if own_range:
        # Read twice, for the ranges and for the bins, so counted per value and settled first.
        counts = settled(clipped.groupBy(split, "_v").agg(F.count(F.lit(1)).alias("_n")))
        ends = (counts.groupBy(F.col(split).alias("_class"))
                .agg(F.min("_v").alias("_low"), F.max("_v").alias("_high")))
        # A class with a single value gets a range of width one around it.
        flat = F.col("_low") == F.col("_high")
        counts = (look_up(counts, ends, split, "_class", spread_by="_v", salts=16)
                  .withColumns({"_low": F.when(flat, F.col("_low") - 0.5).otherwise(F.col("_low")),
                                "_high": F.when(flat, F.col("_high") + 0.5).otherwise(F.col("_high"))}))
    else:
        counts = clipped.withColumns({"_low": F.lit(float(low)), "_high": F.lit(float(high)), "_n": F.lit(1)})
    place = F.least(F.width_bucket("_v", "_low", "_high", F.lit(bins)), F.lit(bins).cast("long")).cast("int")
    start = F.col("_low") + (F.col("bin") - 1) * (F.col("_high") - F.col("_low")) / bins
    return (counts.withColumn("bin", place).withColumn("bin_start", start)
            .groupBy(split, "bin").agg(F.min("bin_start").alias("bin_start"), F.sum("_n").alias("n")))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """The columns rounded for display, halves away from zero."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table."""
    sizes = [df.agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, sizes)


def preview(df: DataFrame, columns: Sequence[str], key: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows by ``key``."""
    return df.select(*columns).orderBy(key).limit(n)
