"""Order grain: delivered orders, and items and reviews rolled up to one row per order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from starling.functions import half_even, safe_ratio, whole_days


def delivered_orders(orders: DataFrame) -> DataFrame:
    return orders.where((F.col("order_status") == "delivered")
                        & F.col("order_delivered_customer_date").isNotNull())


def delivery_features(orders: DataFrame) -> DataFrame:
    """Adds whole days from purchase to delivery, and past the estimate (positive means late)."""
    return orders.withColumns({
        "delivery_time_days": whole_days("order_purchase_timestamp", "order_delivered_customer_date"),
        "delivery_delay_days": whole_days("order_estimated_delivery_date", "order_delivered_customer_date")})


def _of_first_item(column: str, *rank: str):
    """The ranked columns of the item that comes first among those where ``column`` is not NULL."""
    return F.min(F.when(F.col(column).isNotNull(), F.struct("order_item_id", *rank)))


def items_rollup(items: DataFrame) -> DataFrame:
    """One row per order. Product and seller are each the first non-null one by item number; equal numbers
    are settled by product, then seller. Every aggregate merges partial results, so one huge order is
    reduced where its rows lie before anything is shuffled."""
    return (items.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        F.count("order_item_id").alias("n_items"),
        F.coalesce(F.sum("price"), F.lit(0.0)).alias("total_price"),
        F.coalesce(F.sum("freight_value"), F.lit(0.0)).alias("total_freight"),
        _of_first_item("seller_id", "product_id", "seller_id").alias("_seller"),
        _of_first_item("product_id", "product_id").alias("_product"))
        .withColumns({"primary_seller": F.col("_seller.seller_id"),
                      "primary_product": F.col("_product.product_id"),
                      "freight_pct": safe_ratio(F.col("total_freight"), F.col("total_price"))})
        .drop("_seller", "_product"))


def reviews_rollup(reviews: DataFrame) -> DataFrame:
    return (reviews.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        F.avg("review_score").alias("review_score"),
        F.count("review_id").alias("n_reviews"))
        .withColumn("review_score_round", half_even(F.col("review_score"))))
