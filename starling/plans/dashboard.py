"""The reports on the order mart. Thresholds are parameters; defaults fit about a hundred thousand orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from starling.functions import month_of, name_of, percent, safe_ratio
from starling.operators.lookups import fill_groups
from starling.operators.rates import (
    BAD, distinct_values, grouped_rates, highest, histogram, keep_listed, lowest, overall_figures,
    share, value_counts,
)
from starling.plans.master import DELAY_NAMES

CATEGORY, STATE = "product_category_name_english", "seller_state"


def filtered(master: DataFrame, categories: Sequence[str] = (), states: Sequence[str] = ()) -> DataFrame:
    """The chosen categories and states; an empty choice means all. Applies to the key figures and the
    grouped reports, not to the model, the significance test or the texts."""
    return keep_listed(master, **{CATEGORY: categories, STATE: states})


def category_options(master: DataFrame) -> DataFrame:
    return distinct_values(master, CATEGORY)


def state_options(master: DataFrame) -> DataFrame:
    return distinct_values(master, STATE)


def key_figures(master: DataFrame) -> DataFrame:
    return overall_figures(master)


def rate_by_delivery(master: DataFrame, names: Sequence[str] = DELAY_NAMES) -> DataFrame:
    """Bins in their own order; bins without orders are absent. Bins are grouped by number and named after."""
    position = "delivery_bucket_ord"
    return (grouped_rates(master, position).withColumn("delivery_bucket", name_of(F.col(position), names))
            .orderBy(position))


def _avg_delivery() -> Column:
    return F.avg("delivery_time_days")


def category_rates(master: DataFrame, min_orders: int = 500) -> DataFrame:
    return grouped_rates(master, CATEGORY, min_orders, avg_delivery=_avg_delivery())


def worst_categories(master: DataFrame, min_orders: int = 500, n: int = 15) -> DataFrame:
    return highest(category_rates(master, min_orders), "bad_rate", CATEGORY, n)


def best_categories(master: DataFrame, min_orders: int = 500, n: int = 5) -> DataFrame:
    return lowest(category_rates(master, min_orders), "bad_rate", CATEGORY, n)


def elevated_categories(master: DataFrame, min_orders: int = 500, n: int = 15, factor: float = 1.5) -> DataFrame:
    """The worst categories beside the overall rate; flagged where theirs is above ``factor`` times it.

    The overall rate is summed from the category counts, so the orders are read once. The window without keys
    sees one row per category, not orders.
    """
    per_category = master.groupBy(CATEGORY).agg(
        F.avg(BAD).alias("bad_rate"), F.count(BAD).alias("n_orders"), _avg_delivery().alias("avg_delivery"),
        F.sum(BAD).alias("_bad"))
    everything = Window.partitionBy()
    ranked = (per_category
              .withColumn("overall_rate", safe_ratio(F.sum("_bad").over(everything),
                                                     F.sum("n_orders").over(everything)))
              .where(F.col(CATEGORY).isNotNull() & (F.col("n_orders") >= min_orders))
              .withColumn("bad_rate_pct", percent(F.col("bad_rate"))).drop("_bad"))
    return (highest(ranked, "bad_rate", CATEGORY, n)
            .withColumn("is_elevated", F.col("bad_rate") > F.col("overall_rate") * factor))


def monthly_trend(master: DataFrame, min_orders: int = 100) -> DataFrame:
    return (grouped_rates(master.withColumn("month", month_of("order_purchase_timestamp")), "month", min_orders,
                          avg_review=F.avg("review_score"))
            .orderBy("month"))


def state_rates(master: DataFrame, min_orders: int = 100) -> DataFrame:
    return grouped_rates(master, STATE, min_orders, avg_delivery=_avg_delivery())


def state_summary(master: DataFrame, min_orders: int = 500) -> DataFrame:
    """State rates with the worst first."""
    return state_rates(master, min_orders).orderBy(F.desc("bad_rate"), F.asc(STATE))


def state_map(master: DataFrame, regions: DataFrame, min_orders: int = 100) -> DataFrame:
    """Every region; NULL measures for those with too few orders."""
    return fill_groups(regions, state_rates(master, min_orders), STATE)


def delay_histogram(master: DataFrame, own_range: bool = False) -> DataFrame:
    return histogram(master, "delivery_delay_days", BAD, -30, 30, 40, own_range)


def score_distribution(reviews: DataFrame) -> DataFrame:
    """Raw reviews per star, before any roll-up."""
    return value_counts(reviews, "review_score").orderBy("review_score")


def raw_bad_share(reviews: DataFrame, bad_up_to: int = 2) -> DataFrame:
    return reviews.agg((share(F.col("review_score") <= bad_up_to) * 100).alias("bad_pct"),
                       F.count(F.lit(1)).alias("n_reviews"))
