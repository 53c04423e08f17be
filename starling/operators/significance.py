"""Is the bad-review rate of late orders higher than that of the others by more than chance?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from starling.functions import percent, safe_ratio, significance_text

BAD, DELAY = "is_bad_review", "delivery_delay_days"
#: Coefficients of a published Chebyshev fit to erfc, exact to 1.2e-7 of its value everywhere.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223,
        0.17087277)


def two_sided_p(z: Column) -> Column:
    """Chance of a standard normal value at least as far from 0 as ``z``."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + x / 2)
    series = F.lit(ERFC[-1])
    for coefficient in reversed(ERFC[:-1]):
        series = F.lit(coefficient) + t * series
    return t * F.exp(-x * x + series)


def late_effect(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pooled two-proportion z in one pass, over all rows or per group. Late is a delay above 0, on time is 0 or
    below, NULL is neither. z is NULL where a side is empty or all outcomes are equal."""
    sides = {"ontime": F.col(DELAY) <= 0, "late": F.col(DELAY) > 0}
    counts = []
    for side, rows in sides.items():
        counts += [F.count_if(rows).alias(f"n_{side}"),
                   F.coalesce(F.sum(F.when(rows, F.col(BAD))), F.lit(0)).cast("long").alias(f"bad_{side}")]
    pooled = safe_ratio(F.col("bad_ontime") + F.col("bad_late"), F.col("n_ontime") + F.col("n_late"))
    spread = (F.try_divide(F.lit(1.0), F.col("n_ontime").cast("double"))
              + F.try_divide(F.lit(1.0), F.col("n_late").cast("double")))
    gap = F.col("rate_late") - F.col("rate_ontime")
    return (df.groupBy(*by).agg(*counts)
            .withColumns({f"rate_{side}": safe_ratio(F.col(f"bad_{side}"), F.col(f"n_{side}")) for side in sides})
            .withColumns({"difference_pp": percent(gap), "pooled_rate": pooled})
            .withColumn("z", F.try_divide(gap, F.sqrt(
                F.col("pooled_rate") * (1 - F.col("pooled_rate")) * spread))))


def late_effect_p(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Two-sided p of the same test, and z squared, which for a 2x2 table is the chi-square statistic. One empty side or
    one outcome give NULL. The four counts are all it needs."""
    tested = late_effect(df, by).withColumns({"chi2": F.col("z") * F.col("z"), "p_value": two_sided_p(F.col("z"))})
    return tested.select(*by, "chi2", "p_value", significance_text(F.col("p_value")).alias("verdict"))
