"""The order mart: one row per delivered, reviewed order with a translated product category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from starling.functions import bin_number, flag, month_of, name_of, not_null
from starling.operators.lookups import look_up
from starling.operators.orders import delivered_orders, delivery_features, items_rollup, reviews_rollup
from starling.sources.tables import Tables

# Delay bins in days, right-closed, and their names in order.
DELAY_EDGES = (-100, -7, -1, 0, 7, 100)
DELAY_NAMES = ("7+ days early", "1-7 days early", "on time", "1-7 days late", "7+ days late")
BAD_UP_TO = 2


def with_delay_bucket(df: DataFrame, edges: Sequence[float] = DELAY_EDGES,
                      names: Sequence[str] = DELAY_NAMES) -> DataFrame:
    """Adds the delay bin's name, and its position for sorting."""
    return (df.withColumn("delivery_bucket_ord", bin_number(F.col("delivery_delay_days"), edges))
            .withColumn("delivery_bucket", name_of(F.col("delivery_bucket_ord"), names)))


def order_master(tables: Tables, salts: int = 1) -> DataFrame:
    """The mart, lazily.

    Items and reviews are reduced to order grain before they meet the orders, so the three joins on
    ``order_id`` share one partitioning and no key repeats. Orders without items, review or translated
    category are dropped after the joins; each test is its own ``IS NOT NULL``, which lets Catalyst run
    those joins as inner ones. ``salts`` spreads a product or seller that dominates the orders, for reference
    tables too large to broadcast.
    """
    categories = tables.products.select("product_id", "product_category_name").join(
        tables.translation, "product_category_name", "left")
    sellers = tables.sellers.select("seller_id", "seller_state")
    joined = (delivery_features(delivered_orders(tables.orders))
              .join(items_rollup(tables.items), "order_id", "left")
              .join(reviews_rollup(tables.reviews), "order_id", "left"))
    joined = look_up(joined, categories, "primary_product", "product_id", "order_id", salts)
    joined = look_up(joined, sellers, "primary_seller", "seller_id", "order_id", salts)
    kept = joined.where(not_null("review_score", "total_price", "product_category_name_english"))
    return with_delay_bucket(
        kept.withColumn("is_bad_review", flag(F.col("review_score_round") <= BAD_UP_TO)))


def write_mart(master: DataFrame, path: str) -> None:
    """Stores the mart partitioned by purchase month. The rebalance hint lets AQE split a month that holds
    most orders over several files and merge the thin ones."""
    (master.withColumn("purchase_month", month_of("order_purchase_timestamp").cast("date"))
     .hint("rebalance", F.col("purchase_month"))
     .write.mode("overwrite").partitionBy("purchase_month").parquet(path))


def read_mart(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
