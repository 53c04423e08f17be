import re

from pyspark.sql import functions as F

import small
from starling.plans import dashboard
from starling.plans.master import order_master, read_mart, write_mart


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_incomplete_orders_are_dropped(spark):
    found = {r.order_id: r for r in order_master(small.tables(spark)).collect()}
    assert sorted(found) == ["a", "b", "c", "no_state"]
    assert (found["b"].is_bad_review, found["b"].delivery_delay_days, found["b"].delivery_bucket) == (
        1, 5, "1-7 days late")
    assert (found["c"].delivery_bucket, found["c"].delivery_bucket_ord) == ("on time", 2)
    assert found["no_state"].seller_state is None and found["no_state"].seller_id is None
    assert found["a"].product_id == found["a"].primary_product == "p1"


def test_missing_state_is_no_group(spark):
    rates = dashboard.state_rates(order_master(small.tables(spark)), 1).collect()
    assert [(r.seller_state, r.n_orders) for r in rates] == [("SP", 3)]


def test_only_the_seller_join_stays_outer(spark, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    plan = plan_of(order_master(small.tables(spark))).split("Initial Plan")[0]
    joins = re.findall(r"SortMergeJoin(?:\(skew=\w+\))? \[.*?\], \[.*?\], (\w+)", plan)
    assert sorted(joins) == ["Inner"] * 4 + ["LeftOuter"]


def big_tables(spark, n=3000):
    """Orders of which a third are for one product and one seller."""
    ids = spark.range(n)
    hot = F.col("id") % 3 == 0
    base = small.tables(spark)
    return base.with_table(
        orders=ids.selectExpr(
            "CAST(id AS STRING) AS order_id", "'delivered' AS order_status",
            "TIMESTAMP_NTZ'2018-01-01 00:00:00' AS order_purchase_timestamp",
            "timestampadd(DAY, CAST(id % 50 AS INT), TIMESTAMP_NTZ'2018-01-01 00:00:00') AS order_delivered_customer_date",
            "TIMESTAMP_NTZ'2018-01-21 00:00:00' AS order_estimated_delivery_date"),
        items=ids.select(
            F.col("id").cast("string").alias("order_id"), F.lit(1).alias("order_item_id"),
            F.concat(F.lit("p"), F.when(hot, 0).otherwise(F.col("id") % 40)).alias("product_id"),
            F.concat(F.lit("s"), F.when(hot, 0).otherwise(F.col("id") % 30)).alias("seller_id"),
            F.lit(10.0).alias("price"), F.lit(1.0).alias("freight_value")),
        reviews=ids.selectExpr("CAST(id AS STRING) AS review_id", "CAST(id AS STRING) AS order_id",
                               "CAST(1 + id % 5 AS INT) AS review_score", "'x' AS review_comment_message"),
        products=spark.range(40).selectExpr("concat('p', id) AS product_id", "concat('c', id % 7) AS product_category_name"),
        translation=spark.range(7).selectExpr("concat('c', id) AS product_category_name",
                                              "concat('e', id) AS product_category_name_english"),
        sellers=spark.range(30).selectExpr("concat('s', id) AS seller_id", "concat('S', id % 4) AS seller_state"))


def test_salting_changes_nothing(spark, settings):
    plain = sorted(map(str, order_master(big_tables(spark)).collect()))
    settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    salted = sorted(map(str, order_master(big_tables(spark), salts=8).collect()))
    assert len(plain) == 3000 and plain == salted


def test_a_hot_product_is_split_when_nothing_can_be_broadcast(spark, settings):
    master = order_master(big_tables(spark, 60_000))
    expected = sorted(map(str, dashboard.category_rates(master, 1).collect()))
    settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
             spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="10k",
             spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.2",
             spark__sql__adaptive__advisoryPartitionSizeInBytes="20k")
    rates = dashboard.category_rates(order_master(big_tables(spark, 60_000)), 1)
    assert "skew=true" in plan_of(rates)
    assert sorted(map(str, rates.collect())) == expected


def test_shuffle_width_changes_nothing(spark, settings):
    first = sorted(map(str, order_master(big_tables(spark)).collect()))
    settings(spark__sql__shuffle__partitions="3")
    assert sorted(map(str, order_master(big_tables(spark)).collect())) == first


def test_mart_is_partitioned_by_month(spark, tmp_path):
    master = order_master(small.tables(spark))
    write_mart(master, str(tmp_path / "mart"))
    assert (tmp_path / "mart" / "purchase_month=2018-01-01").is_dir()
    back = read_mart(spark, str(tmp_path / "mart"))
    assert sorted(map(str, back.select(*master.columns).collect())) == sorted(map(str, master.collect()))
    one_month = back.where("purchase_month = DATE'2018-01-01'")
    one_month.collect()
    assert "PartitionFilters: [isnotnull(purchase_month" in plan_of(one_month)
