import small
from starling.operators.lookups import fill_groups
from starling.operators.rates import (
    ascending, highest, histogram, keep_listed, lowest, overall_figures, preview, profile, rounded, share,
)
from starling.plans import dashboard
from starling.plans.master import order_master
from pyspark.sql import functions as F


def test_empty_choice_keeps_all(spark):
    master = order_master(small.tables(spark))
    assert dashboard.filtered(master).count() == 4
    assert dashboard.filtered(master, ["toys"], ["SP"]).count() == 3
    assert dashboard.filtered(master, ["toys"], []).count() == 4


def test_figures_of_nothing_are_missing(spark):
    nothing = dashboard.filtered(order_master(small.tables(spark)), ["nowhere"])
    assert tuple(overall_figures(nothing).first()) == (0, None, None, None, None)


def test_minimum_support_and_ties(spark):
    rows = [("x", 1), ("x", 0), ("y", 1), ("y", 0), ("z", 1), (None, 1)]
    df = spark.createDataFrame(rows, "product_category_name_english string, is_bad_review int").withColumn(
        "delivery_time_days", F.lit(3))
    kept = dashboard.category_rates(df, 2)
    assert [r[0] for r in highest(kept, "bad_rate", "product_category_name_english", 5).collect()] == ["x", "y"]
    assert [r[0] for r in lowest(kept, "bad_rate", "product_category_name_english", 1).collect()] == ["x"]
    flagged = {r[0]: (r.overall_rate, r.is_elevated) for r in dashboard.elevated_categories(df, 1, 9).collect()}
    assert flagged["z"] == (4 / 6, False) or flagged["z"][1] == (1.0 > 4 / 6 * 1.5)
    assert set(flagged) == {"x", "y", "z"}


def test_regions_without_orders_stay(spark):
    regions = spark.createDataFrame([("SP",), ("RJ",)], "seller_state string")
    found = {r.seller_state: r.n_orders for r in dashboard.state_map(
        order_master(small.tables(spark)), regions, 1).collect()}
    assert found == {"SP": 3, "RJ": None}
    assert fill_groups(regions, regions, "seller_state").count() == 2


def test_histogram_top_edge_and_missing(spark):
    df = spark.createDataFrame([(0, 45), (0, 30), (0, -30), (0, -99), (1, 0), (1, None)], "c int, v int")
    found = {(r.c, r.bin): (r.bin_start, r.n) for r in histogram(df, "v", "c", -30, 30, 40).collect()}
    assert found == {(0, 40): (28.5, 2), (0, 1): (-30.0, 2), (1, 21): (0.0, 1)}


def test_histogram_over_each_class_range(spark):
    df = spark.createDataFrame([(0, 0), (0, 40), (0, 10), (1, 5), (1, 5)], "c int, v int")
    found = {(r.c, r.bin): (r.bin_start, r.n) for r in histogram(df, "v", "c", -30, 30, 4, own_range=True).collect()}
    assert found == {(0, 1): (0.0, 1), (0, 4): (22.5, 1), (0, 2): (7.5, 1), (1, 3): (5.0, 2)}


def test_share_counts_missing_as_not_met(spark):
    df = spark.createDataFrame([(1,), (5,), (None,), (2,)], "s int")
    assert df.agg(share(F.col("s") <= 2)).first()[0] == 0.5


def test_profile(spark):
    found = {r.table_name: (r.n_rows, r.n_columns) for r in profile(small.tables(spark).named()).collect()}
    assert found["orders"] == (9, 5) and found["translation"] == (1, 2) and len(found) == 6


def test_list_filter_on_one_column(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert keep_listed(df, k=["a"]).count() == 1 and keep_listed(df, k=[]).count() == 3


def test_ranking_turned_round_rounding_and_preview(spark):
    df = spark.createDataFrame([("a", 0.12345), ("b", 0.5), ("c", 0.5)], "k string, r double")
    top = highest(df, "r", "k", 3)
    assert [r.k for r in top.collect()] == ["b", "c", "a"]
    assert [r.k for r in ascending(top, "r", "k").collect()] == ["a", "b", "c"]
    assert rounded(df, 3, "r").first().r == 0.123
    assert [tuple(r) for r in preview(df, ["k"], "k", 2).collect()] == [("a",), ("b",)]
