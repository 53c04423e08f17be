"""The six tables seen through a trade schema (orders, lineitem, part, supplier, nation, documents).

That schema has no reviews and no delivery dates, so both are computed from its keys by fixed rules. Gaps are NULLs in rows
that stay: reviews without a score, a brand without a translation, sellers without a state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from starling.sources.tables import Tables

# A small word list for scoring the sample texts.
SAMPLE_LEXICON = (("and", 0.7), ("is", 0.4), ("la", 1.1), ("le", -0.9),
                  ("of", -1.2), ("that", -2.0), ("the", 1.5), ("un", -1.4))


# Only the columns in use. Stated, so that opening a table reads no file.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_tax double",
    "part": "p_partkey bigint, p_brand string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "documents": "doc_id bigint, text string",
    "events": "event_id bigint, props string",
}


class TradeFolder:
    """A folder with one Parquet file per trade table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def orders(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey AS order_id",
            "CASE WHEN o_orderstatus = 'P' THEN 'canceled' ELSE 'delivered' END AS order_status",
            "o_orderdate AS order_purchase_timestamp",
            """CASE WHEN o_orderkey % 97 <> 0 THEN
                 timestampadd(HOUR, CAST(24 * (10 + o_custkey % 41) + o_orderkey % 24 AS INT), o_orderdate)
               END AS order_delivered_customer_date""",
            "timestampadd(HOUR, 720, o_orderdate) AS order_estimated_delivery_date")

    def items(self) -> DataFrame:
        # A product of zeros may be -0.0; adding 0 makes it 0.0.
        return self.table("lineitem").selectExpr(
            "l_orderkey AS order_id", "l_linenumber AS order_item_id", "l_partkey AS product_id",
            "l_suppkey AS seller_id", "l_extendedprice AS price", "l_extendedprice * l_tax + 0D AS freight_value")

    def reviews(self) -> DataFrame:
        buyers = self.table("orders").select("o_orderkey", "o_custkey")
        return (self.table("lineitem").join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
                .selectExpr("l_orderkey * 8 + l_linenumber AS review_id", "l_orderkey AS order_id",
                            """CASE WHEN l_linenumber <= 2 THEN greatest(1, 1 + CAST(l_quantity AS INT) % 5
                                 - CASE WHEN o_custkey % 41 > 20 THEN 2 ELSE 0 END) END AS review_score"""))

    def products(self) -> DataFrame:
        return self.table("part").selectExpr("p_partkey AS product_id", "p_brand AS product_category_name")

    def translation(self) -> DataFrame:
        return (self.table("part").select("p_brand").distinct()
                .selectExpr("p_brand AS product_category_name",
                            "CASE WHEN p_brand <> 'Brand#13' THEN lower(p_brand) END AS product_category_name_english"))

    def sellers(self) -> DataFrame:
        return (self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
                .selectExpr("s_suppkey AS seller_id", "CASE WHEN s_suppkey % 29 <> 0 THEN n_name END AS seller_state"))

    def region_codes(self) -> DataFrame:
        return self.table("nation").selectExpr("n_name AS seller_state")

    def review_texts(self) -> DataFrame:
        return self.table("documents").selectExpr(
            "doc_id AS review_id", "doc_id AS order_id", "CAST(1 + doc_id % 5 AS INT) AS review_score",
            "text AS review_comment_message")

    def tables(self) -> Tables:
        return Tables(self.orders(), self.items(), self.reviews(), self.products(),
                      self.translation(), self.sellers())


def sample_lexicon(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{word}', {valence}D)" for word, valence in SAMPLE_LEXICON)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS lexicon(token, valence)")
