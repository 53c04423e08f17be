"""A few orders by hand, in the shape of the six tables."""

from datetime import datetime, timedelta

from starling.sources.tables import Tables

DAY0 = datetime(2018, 1, 1, 12)


def orders(spark, rows):
    """Rows (order_id, status, days from purchase to delivery or None, days from purchase to estimate)."""
    made = [(o, s, DAY0, None if d is None else DAY0 + timedelta(days=d), DAY0 + timedelta(days=e))
            for o, s, d, e in rows]
    return spark.createDataFrame(made, """order_id string, order_status string,
        order_purchase_timestamp timestamp_ntz, order_delivered_customer_date timestamp_ntz,
        order_estimated_delivery_date timestamp_ntz""")


def items(spark, rows):
    return spark.createDataFrame(rows, """order_id string, order_item_id int, product_id string,
        seller_id string, price double, freight_value double""")


def reviews(spark, rows):
    return spark.createDataFrame(rows, """review_id string, order_id string, review_score int,
        review_comment_message string""")


def tables(spark):
    delivered = [("a", "delivered", 10, 20), ("b", "delivered", 25, 20), ("c", "delivered", 20, 20),
                 ("no_review", "delivered", 5, 20), ("no_items", "delivered", 5, 20),
                 ("untranslated", "delivered", 5, 20), ("canceled", "canceled", 5, 20),
                 ("lost", "delivered", None, 20), ("no_state", "delivered", 12, 20)]
    sold = [(o, 1, "p_unknown" if o == "untranslated" else "p1", "s_gone" if o == "no_state" else "s1", 10.0, 1.0)
            for o, *_ in delivered if o != "no_items"]
    rated = [("r" + o, o, 1 if o == "b" else 5, "text") for o, *_ in delivered if o != "no_review"]
    return Tables(
        orders(spark, delivered), items(spark, sold), reviews(spark, rated),
        spark.createDataFrame([("p1", "brinquedos"), ("p_unknown", "sem_nome")],
                              "product_id string, product_category_name string"),
        spark.createDataFrame([("brinquedos", "toys")],
                              "product_category_name string, product_category_name_english string"),
        spark.createDataFrame([("s1", "SP")], "seller_id string, seller_state string"))
