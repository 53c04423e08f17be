import re

import pytest
from pyspark.sql import functions as F

import small
from starling.plans.master import order_master
from starling.sources import bucketed
from starling.sources.trade_view import TradeFolder


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moves_by_order(text):
    """Lines that shuffle or sort by the order."""
    return [line for line in text.splitlines() if re.search(r"(Exchange hashpartitioning\(|Sort \[)order_id#", line)]


@pytest.fixture
def trade(spark):
    return TradeFolder(spark, "/root/testdata/sf0.001").tables()


def rows(df):
    return sorted(map(str, df.collect()))


def test_no_shuffle_and_no_sort_by_order(spark, settings, trade, tmp_path):
    settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__shuffle__partitions="5")
    bucketed.land_bucketed(trade, str(tmp_path), 4)
    parts = bucketed.bucketed_parts(spark, str(tmp_path))
    assert len(parts) == 1
    whole = bucketed.order_master_of(parts)
    assert moves_by_order(plan(whole)) == []
    assert moves_by_order(plan(order_master(trade))) != []                # the test would notice
    assert plan(whole).count("SelectedBucketsCount: 4 out of 4") == 3
    assert rows(whole) == rows(order_master(trade))


def test_buckets_grow_with_the_tables(spark, trade, tmp_path):
    few, many = (trade.items.count() // n for n in (3, 12))
    assert bucketed.bucket_count(trade, 8) == 8 and bucketed.bucket_count(trade, 1, few) in (3, 4)
    buckets = bucketed.bucket_count(trade, 2, many)
    assert buckets in (12, 13)
    bucketed.land_bucketed(trade, str(tmp_path), buckets)
    sizes = spark.read.parquet(str(tmp_path / "bucketed" / "items")).groupBy(F.input_file_name()).count().collect()
    assert len(sizes) == buckets and max(r["count"] for r in sizes) < 2 * many
    assert rows(bucketed.order_master_of(bucketed.bucketed_parts(spark, str(tmp_path)))) == rows(order_master(trade))


def test_crowded_orders_are_split_as_usual(spark, settings, trade, tmp_path):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    hot = trade.items.orderBy("order_id").first()["order_id"]
    more = spark.range(3000).select(F.lit(hot).alias("order_id"), (F.col("id") + 10).cast("int").alias("order_item_id"),
                                    F.lit(1).cast("bigint").alias("product_id"), F.lit(1).cast("bigint").alias("seller_id"),
                                    F.lit(0.5).alias("price"), F.lit(0.25).alias("freight_value"))
    nameless = more.limit(50).withColumn("order_id", F.lit(None).cast("bigint"))
    tables = trade.with_table(items=trade.items.unionByName(more).unionByName(nameless))
    bucketed.land_bucketed(tables, str(tmp_path), 4, most_rows=1000)
    parts = bucketed.bucketed_parts(spark, str(tmp_path))
    assert [p.items.where(F.col("order_id") == hot).count() > 3000 for p in parts] == [False, True]
    assert parts[0].orders.count() + parts[1].orders.count() == tables.orders.count() and parts[1].orders.count() == 1
    assert parts[1].items.where("order_id IS NULL").count() == 50
    whole = bucketed.order_master_of(parts)
    assert rows(whole) == rows(order_master(tables))
    # The crowded order goes by partial aggregates before a shuffle; only its side shuffles by the order.
    assert moves_by_order(plan(bucketed.order_master_of(parts[:1]))) == []
    assert "Exchange hashpartitioning(order_id" in plan(bucketed.order_master_of(parts[1:]))


def test_small_and_empty_tables(spark, tmp_path):
    tables = small.tables(spark)
    bucketed.land_bucketed(tables, str(tmp_path / "a"), 3)
    found = bucketed.order_master_of(bucketed.bucketed_parts(spark, str(tmp_path / "a")))
    assert rows(found) == rows(order_master(tables))
    empty = tables.with_table(orders=tables.orders.limit(0), items=tables.items.limit(0), reviews=tables.reviews.limit(0))
    bucketed.land_bucketed(empty, str(tmp_path / "b"), 3)
    assert bucketed.order_master_of(bucketed.bucketed_parts(spark, str(tmp_path / "b"))).collect() == []


def test_landing_again_replaces(spark, tmp_path):
    tables = small.tables(spark)
    for kept in (tables, tables.with_table(orders=tables.orders.where("order_id = 'a'"))):
        bucketed.land_bucketed(kept, str(tmp_path), 2)
    found = bucketed.order_master_of(bucketed.bucketed_parts(spark, str(tmp_path)))
    assert [r["order_id"] for r in found.collect()] == ["a"]
