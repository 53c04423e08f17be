"""What the driver runs: the flagship query, every registered query, and SQL to check them against."""

from __future__ import annotations

import functools
import hashlib
import importlib.util
import os
import sys
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import Column, DataFrame, SparkSession, functions as F  # noqa: E402

from oracles import ORACLES  # noqa: E402
from starling.functions import clip, risk_tier  # noqa: E402
from starling.operators import (  # noqa: E402
    evaluation, ordered, orders as order_ops, rates, sentiment, significance, summaries,
)
from starling.plans import dashboard, master as mart, refresh, review_text, risk_model  # noqa: E402
from starling.session import checkpoint_folder, run_folder, settled  # noqa: E402
from starling.sources import bucketed, tables as landed  # noqa: E402
from starling.sources.tables import csv_tables, region_codes, write_tables  # noqa: E402
from starling.sources.trade_view import TradeFolder, sample_lexicon  # noqa: E402

# The only place that knows whether the subpackage for training data and its pipeline are there. Where they are, an error
# in importing them is one.
corpus_pipeline = training_data = None
if importlib.util.find_spec("starling.llm") and importlib.util.find_spec("starling.llm.queries"):
    from starling.llm import queries as training_data  # noqa: E402
    if importlib.util.find_spec("corpus_pipeline"):
        import corpus_pipeline  # noqa: E402

# The files behind the six order tables, and the fewest buckets that they are landed in.
ORDER_TABLES = ("orders", "lineitem", "part", "supplier", "nation")
BUCKETS = 8
RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
SMOKE_FOLDER = "/root/testdata/sf0.001"

# Minimum orders per group, fitted to the size of the supplied tables.
MIN_CATEGORY, MIN_MONTH, MIN_STATE = 260, 80, 260
CHOSEN_CATEGORIES = ["brand#1", "brand#2", "brand#25"]
CHOSEN_STATES = ["NATION_6", "NATION_9", "NATION_14"]
# The supplied texts are invented prose without English negators; these words of theirs stand in.
SAMPLE_NEGATORS = ("to", "in", "de", "un")
# A model is fit for use from this area under its curve on, and with at most this gap to training orders.
LEAST_AUC, MOST_GAP = 0.7, 0.3
# What-if values: delays, prices, and a category that no order has.
SCENARIO_DELAYS = (0, 14)
SCENARIO_GRID = {"delivery_delay_days": (-5, 10), "total_price": (20.0, 500.0), "n_items": (1, 4),
                 "product_category_name_english": ("brand#25", "unseen")}


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return rates.rounded(df, 6, *columns)


def _tables(spark, folder):
    return TradeFolder(spark, folder).tables()


def _master(spark: SparkSession, folder: str) -> DataFrame:
    return mart.order_master(_tables(spark, folder))


def _texts(spark, folder):
    return TradeFolder(spark, folder).review_texts()


def _stored(spark, folder, name, tables, make):
    """Where ``make(path)`` has written something derived from ``tables`` of the folder as they are now. Its place
    is named after their files, sizes and times, so that a later query finds it and replaced files are noticed."""
    files = spark.read.format("binaryFile").load([f"{folder}/{t}.parquet" for t in tables])
    stamp = files.agg(F.hex(F.bit_xor(F.xxhash64("path", "length", "modificationTime")))).first()[0]
    own = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{hashlib.md5(folder.encode()).hexdigest()}"
    path, hadoop = f"{own}/{stamp}", spark._jvm.org.apache.hadoop.fs
    done = hadoop.Path(path + "/done")
    there = done.getFileSystem(spark._jsc.hadoopConfiguration())
    if not there.exists(done):
        make(path)
        there.create(done).close()
        # What was derived from files that have been replaced goes.
        for old in there.listStatus(hadoop.Path(own)):
            if old.getPath().getName() != stamp:
                there.delete(old.getPath(), True)
    return path


def _scored_texts(spark, folder, negators=()):
    """Scores of all texts, worked out once for all reports on them."""
    def write(path):
        scored = sentiment.review_sentiment(_texts(spark, folder), sample_lexicon(spark), negators=negators)
        rounded(scored, "sentiment").write.mode("overwrite").parquet(f"{path}/scores")

    kind = "scores-negated" if negators else "scores"
    return spark.read.parquet(_stored(spark, folder, kind, ["documents"], write) + "/scores")


def fixed_score(master: DataFrame, *kept: Column) -> DataFrame:
    """A probability that depends on the delay alone, for checking evaluation apart from any model."""
    score: Column = F.round(clip((F.col("delivery_delay_days") + 30) / 60, 0.0, 1.0), 6)
    return master.select("order_id", "is_bad_review", score.alias("score"), *kept)


def trained(spark, folder):
    """Where the model trained on the folder's orders is saved, by the first query that needs it, with its scores of them."""
    def train(path):
        split = risk_model.split_orders(_master(spark, folder))
        model = risk_model.train(split)
        model.save(path)
        model.score(split).write.mode("overwrite").parquet(f"{path}/scored")

    return _stored(spark, folder, "risk-model", ORDER_TABLES, train)


def _model(spark, folder):
    return risk_model.RiskModel.load(spark, trained(spark, folder))


def _scored(spark, folder):
    return spark.read.parquet(trained(spark, folder) + "/scored")


# ---------------------------------------------------------------- sources and order grain

def scan_profile(spark, folder):
    return rates.profile(_tables(spark, folder).named())


def footer_profile(spark, folder):
    """Rows and columns of the files themselves, from their footers."""
    return landed.footer_profile(spark, {name: f"{folder}/{name}.parquet" for name in RAW_TABLES})


def _write_crlf(df: DataFrame, path: str) -> None:
    """A small table as spreadsheets write it: byte-order mark, CRLF."""
    lines = df.select(F.lit(1).alias("o"), F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in df.columns]).alias("line"))
    head = df.sparkSession.range(1).select(F.lit(0).alias("o"), F.lit("\ufeff" + ",".join(df.columns)).alias("line"))
    (head.unionByName(lines).repartition(1).sortWithinPartitions("o", "line").select("line")
     .write.option("lineSep", "\r\n").text(path))


def csv_ingest(spark, folder):
    """The six tables written as CSV, read back with their schemas, and profiled. The reviews carry the texts of
    ``documents``, every third with quotes and a line break; the translation has a byte-order mark and CRLF."""
    out, tables = run_folder(spark, "csv"), _tables(spark, folder)
    said = F.when(F.col("review_id") % 3 == 0, F.concat("review_comment_message", F.lit(' "so", they\nsaid')))
    reviews = tables.reviews.withColumn("review_comment_message", F.lit(None).cast("string")).unionByName(
        _texts(spark, folder).withColumn("review_comment_message", F.coalesce(said, "review_comment_message")))
    approved = F.col("order_purchase_timestamp") + F.expr("INTERVAL 2 HOURS")
    carried = F.col("order_delivered_customer_date") - F.expr("INTERVAL 30 HOURS")
    orders = tables.orders.withColumns({"order_approved_at": approved, "order_delivered_carrier_date": carried})
    files = {}
    for name, df in tables.with_table(orders=orders, reviews=reviews).named().items():
        files[name] = f"{out}/{name}"
        if name == "translation":
            _write_crlf(df, files[name])
        else:
            df.write.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                             ignoreTrailingWhiteSpace=False).csv(files[name])
    back = csv_tables(spark, files)
    delivered = order_ops.delivery_features(order_ops.delivered_orders(back.orders))
    message = F.col("review_comment_message")

    def row(df, name, figure):
        return df.agg(figure.cast("long").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows",
                                                                  F.lit(0).alias("n_columns"))

    parts = [row(delivered, "delivery days", F.sum("delivery_time_days")),
             row(back.orders, "approved hours", F.sum(F.hour("order_approved_at"))),
             row(back.orders, "carried hours", F.sum(F.hour("order_delivered_carrier_date"))),
             row(back.reviews, "texts", F.count(message)),
             row(back.reviews, "text characters", F.sum(F.length(message))),
             row(back.reviews, "text hashes", F.sum(F.conv(F.substring(F.md5(message), 1, 8), 16, 10).cast("long")))]
    return functools.reduce(DataFrame.unionByName, parts, rates.profile(back.named()))


def mart_by_month(spark, folder):
    """The mart stored by month and read back."""
    out = run_folder(spark, "mart")
    mart.write_mart(_master(spark, folder), out)
    return rounded(mart.read_mart(spark, out).groupBy("purchase_month").agg(
        F.count(F.lit(1)).alias("n_orders"), F.avg("review_score").alias("avg_review")), "avg_review")


def mart_refreshed(spark, folder):
    """The mart built from the orders before 2000, then refreshed after the rest came as a new file: which months were
    written by the refresh, and what they hold."""
    source, out = run_folder(spark, "landing"), run_folder(spark, "refreshed")
    tables = _tables(spark, folder)
    keys = ("order_id", "product_id", "seller_id", "review_id")                     # as texts of the same order
    tables = tables.with_table(**{name: df.withColumns({c: F.lpad(F.col(c).cast("string"), 20, "0")
                                                        for c in keys if c in df.columns})
                                  for name, df in tables.named().items()})
    late = F.col("order_purchase_timestamp") >= F.lit("2000-01-01").cast("timestamp_ntz")
    write_tables(tables.with_table(orders=tables.orders.where(~late)), source)
    refresh.refresh_mart(spark, source, out)
    refresh.add_files(tables.with_table(orders=tables.orders.where(late)), source, "orders")
    done = refresh.refresh_mart(spark, source, out)
    months = [F.lit(m).cast("date") for m in done.written]
    return rounded(refresh.refreshed_mart(spark, out).groupBy("purchase_month").agg(
        F.count(F.lit(1)).alias("n_orders"), F.avg("review_score").alias("avg_review"))
        .withColumn("written_by_refresh", F.col("purchase_month").isin(*months)), "avg_review")


def json_dimension(spark, folder):
    field = F.get_json_object("props", "$.k").cast("int").alias("k")
    events = TradeFolder(spark, folder).table("events").select(field)
    return rates.value_counts(events, "k", "n_events")


def distinct_categories(spark, folder):
    return dashboard.category_options(_master(spark, folder))


def distinct_states(spark, folder):
    return dashboard.state_options(_master(spark, folder))


def table_preview(spark, folder):
    columns = ["order_id", "review_score_round", "is_bad_review", "product_category_name_english",
               "total_price", "delivery_delay_days", "seller_state"]
    shown = rates.preview(_master(spark, folder), columns, "order_id", 5)
    return shown.withColumn("total_price", F.round("total_price", 2))


def delivered_orders(spark, folder):
    return order_ops.delivered_orders(_tables(spark, folder).orders)


def delivery_features(spark, folder):
    featured = order_ops.delivery_features(order_ops.delivered_orders(_tables(spark, folder).orders))
    return featured.select("order_id", "delivery_time_days", "delivery_delay_days")


def delivery_buckets(spark, folder):
    return mart.with_delay_bucket(delivery_features(spark, folder)).select(
        "order_id", "delivery_bucket", "delivery_bucket_ord")


def items_rollup(spark, folder):
    rolled = order_ops.items_rollup(_tables(spark, folder).items)
    return rounded(rolled, "total_price", "total_freight", "freight_pct")


def reviews_rollup(spark, folder):
    return rounded(order_ops.reviews_rollup(_tables(spark, folder).reviews), "review_score")


def order_master(spark, folder):
    return rounded(_master(spark, folder), "total_price", "total_freight", "freight_pct", "review_score")


def order_master_bucketed(spark, folder):
    """The mart from tables landed in buckets of the order: no shuffle and no sort by it."""
    def land(path):
        tables = _tables(spark, folder)
        bucketed.land_bucketed(tables, path, bucketed.bucket_count(tables, BUCKETS))

    path = _stored(spark, folder, "bucketed", ORDER_TABLES, land)
    whole = bucketed.order_master_of(bucketed.bucketed_parts(spark, path))
    return rounded(whole, "total_price", "total_freight", "freight_pct", "review_score")


# ---------------------------------------------------------------- figures and grouped rates

def _figures(master):
    return rounded(dashboard.key_figures(master), "avg_review", "bad_rate_pct", "avg_delivery", "avg_delay")


def kpis(spark, folder):
    return _figures(_master(spark, folder))


def filtered_kpis(spark, folder):
    return _figures(dashboard.filtered(_master(spark, folder), CHOSEN_CATEGORIES, CHOSEN_STATES))


def kpis_of_listed_products(spark, folder):
    """The figures of orders whose first item is one of a long list of products, those of an odd size."""
    listed = spark.read.parquet(f"{folder}/part.parquet").where("p_size % 2 = 1").select("p_partkey")
    return _figures(rates.keep_listed(_master(spark, folder), primary_product=listed))


def bad_rate_by_delivery_bucket(spark, folder):
    return rounded(dashboard.rate_by_delivery(_master(spark, folder)), "bad_rate", "bad_rate_pct")


def filtered_bad_rate_by_delivery_bucket(spark, folder):
    chosen = dashboard.filtered(_master(spark, folder), (), CHOSEN_STATES)
    return rounded(dashboard.rate_by_delivery(chosen), "bad_rate", "bad_rate_pct")


def worst_categories(spark, folder):
    worst = dashboard.worst_categories(_master(spark, folder), MIN_CATEGORY)
    return rounded(worst, "bad_rate", "bad_rate_pct", "avg_delivery")


def worst_categories_chart(spark, folder):
    """The worst categories as a chart that grows upwards lists them, with each bar's place from below."""
    chart = rates.ascending(worst_categories(spark, folder), "bad_rate", dashboard.CATEGORY)
    return (chart.select(dashboard.CATEGORY, "bad_rate").coalesce(1)            # fifteen rows, in order
            .withColumn("place", F.monotonically_increasing_id() + 1))


def best_categories(spark, folder):
    best = dashboard.best_categories(_master(spark, folder), MIN_CATEGORY)
    return rounded(best, "bad_rate", "bad_rate_pct", "avg_delivery")


def elevated_categories(spark, folder):
    # The supplied tables vary little by category, so a factor near 1 is what flags some and not others.
    found = dashboard.elevated_categories(_master(spark, folder), MIN_CATEGORY, factor=1.04)
    return rounded(found, "bad_rate", "bad_rate_pct", "avg_delivery", "overall_rate")


def monthly_trend(spark, folder):
    return rounded(dashboard.monthly_trend(_master(spark, folder), MIN_MONTH),
                   "avg_review", "bad_rate", "bad_rate_pct")


def state_rates(spark, folder):
    return rounded(dashboard.state_rates(_master(spark, folder), MIN_STATE),
                   "bad_rate", "bad_rate_pct", "avg_delivery")


def state_summary(spark, folder):
    return rounded(dashboard.state_summary(_master(spark, folder), MIN_STATE),
                   "bad_rate", "bad_rate_pct", "avg_delivery")


def state_rates_dense(spark, folder):
    """Regions as a GeoJSON file gives them."""
    out = run_folder(spark, "regions")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("seller_state").alias("sigla")).alias("properties"))
    codes = TradeFolder(spark, folder).region_codes()         # one row per region of the country
    (codes.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))))
     .write.text(f"{out}/regions"))
    regions = region_codes(spark, f"{out}/regions")
    return rounded(dashboard.state_map(_master(spark, folder), regions, MIN_STATE),
                   "bad_rate", "bad_rate_pct", "avg_delivery")


def score_distribution(spark, folder):
    return dashboard.score_distribution(_tables(spark, folder).reviews)


def raw_bad_share(spark, folder):
    return rounded(dashboard.raw_bad_share(_tables(spark, folder).reviews), "bad_pct")


def delay_histogram(spark, folder):
    return rounded(dashboard.delay_histogram(_master(spark, folder)), "bin_start")


def delay_histogram_own_range(spark, folder):
    return rounded(dashboard.delay_histogram(_master(spark, folder), own_range=True), "bin_start")


# ---------------------------------------------------------------- significance

def late_effect_ztest(spark, folder):
    return rounded(significance.late_effect(_master(spark, folder)),
                   "rate_ontime", "rate_late", "difference_pp", "pooled_rate", "z")


def late_effect_pvalue(spark, folder):
    return rounded(significance.late_effect_p(_master(spark, folder)), "chi2", "p_value")


def late_effect_by_state(spark, folder):
    """The same test for each state."""
    known = _master(spark, folder).where(F.col(dashboard.STATE).isNotNull())
    return rounded(significance.late_effect_p(known, [dashboard.STATE]), "chi2", "p_value")


def month_effect_by_category(spark, folder):
    """Orders of the second half of a month against the others, by category: hardly an effect, so other verdicts occur."""
    late_in_month = F.dayofmonth("order_purchase_timestamp") - 15
    shifted = _master(spark, folder).withColumn("delivery_delay_days", late_in_month.cast("long"))
    return rounded(significance.late_effect_p(shifted, [dashboard.CATEGORY]), "chi2", "p_value")


def late_effect_verdict(spark, folder):
    tested = significance.late_effect_p(_master(spark, folder))
    return tested.select(F.round("chi2", 4).alias("chi2"), "verdict")


# ---------------------------------------------------------------- model inputs

def top_n_levels(spark, folder):
    return risk_model.frequent_levels(_master(spark, folder))


def rare_level_grouping(spark, folder):
    named = settled(_master(spark, folder).select("order_id", dashboard.CATEGORY, dashboard.STATE))
    return risk_model.grouped_levels(named).select("order_id", "cat_grouped", "state_grouped")


def model_features(spark, folder):
    inputs = risk_model.model_numbers(_master(spark, folder)).select("order_id", *risk_model.NUMBERS)
    return rounded(inputs, "total_price", "total_freight", "freight_pct")


def model_indicators(spark, folder):
    """The indicator columns of each order's input vector that are not 0."""
    named = settled(_master(spark, folder).select("order_id", dashboard.CATEGORY, dashboard.STATE, *risk_model.NUMBERS))
    levels = risk_model.find_levels(named)
    return named.select("order_id", F.array_join(levels.indicators(), " ").alias("indicators"))


def train_test_split(spark, folder):
    return ordered.hash_split(_tables(spark, folder).orders, "order_id").select("order_id", "is_test")


def stratified_split(spark, folder):
    outcomes = settled(_master(spark, folder).select("order_id", "is_bad_review"))
    return ordered.stratified_split(outcomes, "order_id", "is_bad_review")


def class_weights(spark, folder):
    return rounded(risk_model.class_weights(_master(spark, folder)), "weight")


# ---------------------------------------------------------------- evaluation on a fixed score

def auc_rank_sum(spark, folder):
    return rounded(ordered.auc(fixed_score(_master(spark, folder)), "is_bad_review", "score"), "auc")


def roc_curve(spark, folder):
    return rounded(ordered.roc_curve(fixed_score(_master(spark, folder)), "is_bad_review", "score"), "fpr", "tpr")


def roc_curve_corners(spark, folder):
    points = ordered.roc_curve(fixed_score(_master(spark, folder)), "is_bad_review", "score", corners_only=True)
    return rounded(points, "fpr", "tpr")


#: Few bins, so that the bound on the error is seen.
FEW_BINS = 24


def auc_from_histogram(spark, folder):
    """The area from monthly histograms merged, its bound, and whether the exact area is within it."""
    months = fixed_score(_master(spark, folder), F.date_trunc("month", "order_purchase_timestamp").alias("month"))
    stored = settled(summaries.score_histogram(months, "is_bad_review", "score", ["month"], FEW_BINS))
    binned = summaries.binned_auc(summaries.merge_histograms([stored]))
    exact = ordered.auc(months, "is_bad_review", "score").select(F.col("auc").alias("exact"))
    both = binned.crossJoin(exact).withColumn(                                                # one row each
        "within_bound", F.abs(F.col("auc") - F.col("exact")) <= F.col("error_bound") + 1e-12)
    return rounded(both.drop("exact"), "auc", "error_bound")


def roc_from_histogram(spark, folder):
    histogram = summaries.score_histogram(fixed_score(_master(spark, folder)), "is_bad_review", "score", bins=FEW_BINS)
    return rounded(summaries.binned_roc(histogram, bins=FEW_BINS), "threshold", "fpr", "tpr")


def confusion_matrix(spark, folder):
    return evaluation.confusion_matrix(fixed_score(_master(spark, folder)), "is_bad_review", "score")


def precision_recall(spark, folder):
    return rounded(evaluation.precision_recall(fixed_score(_master(spark, folder)), "is_bad_review", "score"),
                   "precision", "recall")


def risk_tiers(spark, folder):
    tiered = fixed_score(_master(spark, folder)).withColumn("risk", risk_tier(F.col("score")))
    return rates.value_counts(tiered, "risk", "n_orders")


# ---------------------------------------------------------------- the model itself
# What SQL can say of a trained model: how many rows it saw, and whether it has the properties it must have.

def risk_model_auc(spark, folder):
    both = risk_model.train_and_test_auc(_scored(spark, folder))
    return both.select("n_train", "n_test", (F.col("test_auc") >= LEAST_AUC).alias("tells_apart"),
                       (F.abs("gap") <= MOST_GAP).alias("holds_on_test_orders"))


def _importance_facts(shown, whole, total):
    delivery = F.col("feature").isin("delivery_delay_days", "delivery_time_days")
    first = shown.agg(F.count(F.lit(1)).alias("n_rows"), F.max_by(delivery, "importance").alias("first_is_delivery"))
    return first.crossJoin(whole.agg((F.abs(F.sum("importance") - total) < 1e-6).alias("adds_up")))    # one row each


def feature_importance(spark, folder):
    model = _model(spark, folder)
    return _importance_facts(model.importance(), model.importance(1000), 1.0)


def split_importance(spark, folder):
    model = _model(spark, folder)
    inner = sum((tree.numNodes - 1) // 2 for tree in model.trees.trees)
    facts = _importance_facts(model.importance(kind="splits"), model.importance(1000, kind="splits"), float(inner))
    n_trees = model.nodes().agg(F.count_distinct("tree").cast("int").alias("n_trees"))
    return facts.drop("first_is_delivery").crossJoin(n_trees)                                         # one row each


def model_confusion(spark, folder):
    tested = _scored(spark, folder).where("is_test = 1")
    found = evaluation.precision_recall(tested, "is_bad_review", risk_model.SCORE)

    def share(c):
        return F.col(c).between(0.5, 1.0)

    return found.select((F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n_test"),
                        (F.col("tp") + F.col("fn")).alias("n_bad"), share("precision").alias("precise"),
                        share("recall").alias("complete"))


def model_roc(spark, folder):
    tested = _scored(spark, folder).where("is_test = 1")
    points = settled(ordered.roc_curve(tested, "is_bad_review", risk_model.SCORE, numbered=True))
    area = ordered.auc(tested, "is_bad_review", risk_model.SCORE).select("auc")
    facts = ordered.curve_facts(points).crossJoin(area)                                               # one row each
    return facts.select("fpr", "tpr", "last_fpr", "last_tpr", "never_falls",
                        (F.abs(F.col("area") - F.col("auc")) < 1e-9).alias("area_is_auc"))


def score_scenarios(spark, folder):
    """Every order on time, or two weeks late."""
    model, orders = _model(spark, folder), _scored(spark, folder).drop(risk_model.SCORE, "risk")
    what_if = model.score(risk_model.with_scenarios(orders, "delivery_delay_days", SCENARIO_DELAYS))
    means = what_if.groupBy("delivery_delay_days").agg(
        F.count(F.lit(1)).alias("n_orders"), F.avg(risk_model.SCORE).alias("mean"))
    on_time = what_if.where(F.col("delivery_delay_days") == SCENARIO_DELAYS[0]).agg(F.avg(risk_model.SCORE).alias("base"))
    return means.crossJoin(on_time).select(                                       # a row per scenario, and one
        F.col("delivery_delay_days").cast("long").alias("delay"), "n_orders",
        (F.col("mean") > F.col("base") + 0.05).alias("riskier"))


def scenario_grid(spark, folder):
    """Every order under each combination of delay, price, number of items and category, one of them unseen."""
    model, orders = _model(spark, folder), _scored(spark, folder).drop(risk_model.SCORE, "risk")
    what_if = model.score(risk_model.with_grid(orders, SCENARIO_GRID))
    keys = [F.col("delivery_delay_days").cast("long").alias("delay"), F.col("total_price").alias("price"),
            F.col("n_items").cast("long").alias("items"), F.col("product_category_name_english").alias("category")]
    return what_if.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("risk").isNotNull()).alias("n_rated"),
        (F.count_if(~F.col(risk_model.SCORE).between(0, 1)) == 0).alias("all_shares"))


def scenario_means(spark, folder):
    """Mean scores of the same grid without a copy of any order, held against scoring the copies."""
    model, orders = _model(spark, folder), _scored(spark, folder).drop(risk_model.SCORE, "risk")
    keys = list(SCENARIO_GRID)
    copied = model.score(risk_model.with_grid(orders, SCENARIO_GRID)).groupBy(*keys).agg(F.avg(risk_model.SCORE).alias("copied"))
    both = risk_model.grid_means(model, orders, SCENARIO_GRID).join(copied, keys)
    return both.select(F.col(keys[0]).cast("long").alias("delay"), F.col(keys[1]).alias("price"),
                       F.col(keys[2]).cast("long").alias("items"), F.col(keys[3]).alias("category"), "n_orders",
                       (F.abs(F.col("mean_score") - F.col("copied")) < 1e-9).alias("same_mean"))


# ---------------------------------------------------------------- review texts

def review_sentiment(spark, folder):
    return _scored_texts(spark, folder).drop("text_hash")


def review_sentiment_negated(spark, folder):
    return _scored_texts(spark, folder, SAMPLE_NEGATORS).drop("text_hash")


def review_sentiment_long_list(spark, folder):
    """Scores by a long word list: half of the words that occur, with valences by rule, and few of them broadcast at once."""
    texts = _texts(spark, folder)
    word = texts.select(F.explode(sentiment.words_of()).alias("token")).where("token RLIKE '^[a-z]+$'").distinct()
    digest = F.md5(F.col("token"))
    def digit(i):
        return F.conv(F.substring(digest, i, 1), 16, 10).cast("int")
    listed = settled(word.where(digit(2) % 2 == 0).select("token", (digit(1) - 7).cast("double").alias("valence")))
    scored = sentiment.review_sentiment(texts, listed, negators=(), most_words=max(1, listed.count() // 3))
    return rounded(scored, "sentiment").drop("text_hash")


def sentiment_by_star(spark, folder):
    return rounded(review_text.sentiment_by_star(_scored_texts(spark, folder)),
                   "q1", "median", "q3", "low_whisker", "high_whisker")


def sentiment_by_star_midpoint(spark, folder):
    return rounded(review_text.sentiment_by_star(_scored_texts(spark, folder), "midpoint"),
                   "q1", "median", "q3", "low_whisker", "high_whisker")


def sentiment_by_star_sketched(spark, folder):
    """Quartiles per star from sketches of the stored scores, one per part of them, and whether the share of scores up to
    each is within the stated error."""
    scored = _scored_texts(spark, folder)
    parts = summaries.quantile_sketches(scored.withColumn("part", F.spark_partition_id()), ["review_score", "part"], "sentiment")
    found = settled(summaries.quartiles(summaries.merge_sketches(parts, ["review_score"])))
    allowed = 2 * summaries.rank_error()                    # twice the error of 99 cases in a hundred

    def near(q, share):
        below, upto = F.avg((F.col("sentiment") < F.col(q)).cast("int")), F.avg((F.col("sentiment") <= F.col(q)).cast("int"))
        return (below - allowed <= share) & (F.lit(share) <= upto + allowed)

    return scored.join(F.broadcast(found), "review_score").groupBy("review_score").agg(                   # five stars
        F.max("n").alias("n"), near("q1", 0.25).alias("q1_near"), near("median", 0.5).alias("median_near"),
        near("q3", 0.75).alias("q3_near"))


def sentiment_mismatch(spark, folder):
    return sentiment.mismatch_counts(_scored_texts(spark, folder))


def mismatched_reviews(spark, folder):
    found = review_text.mismatched_reviews(_texts(spark, folder), sample_lexicon(spark), negators=())
    return rounded(found, "sentiment")


def sample_by_hash(spark, folder):
    return review_text.text_sample(_texts(spark, folder), n=500).select("review_id", "review_score")


REGISTERED = (
    scan_profile, footer_profile, csv_ingest, json_dimension, distinct_categories, distinct_states, table_preview,
    delivered_orders, delivery_features, delivery_buckets, items_rollup, reviews_rollup, order_master,
    order_master_bucketed, mart_by_month, mart_refreshed, kpis, filtered_kpis, kpis_of_listed_products,
    bad_rate_by_delivery_bucket, filtered_bad_rate_by_delivery_bucket, worst_categories, worst_categories_chart,
    best_categories, elevated_categories, monthly_trend, state_rates, state_summary, state_rates_dense,
    score_distribution, raw_bad_share, delay_histogram, delay_histogram_own_range, late_effect_ztest,
    late_effect_pvalue, late_effect_by_state, month_effect_by_category, late_effect_verdict, top_n_levels,
    rare_level_grouping, model_features, model_indicators, train_test_split, stratified_split, class_weights,
    auc_rank_sum, auc_from_histogram, roc_curve, roc_curve_corners, roc_from_histogram, confusion_matrix,
    precision_recall, risk_tiers, risk_model_auc, feature_importance, split_importance, model_confusion, model_roc,
    score_scenarios, scenario_grid, scenario_means, review_sentiment, review_sentiment_negated,
    review_sentiment_long_list, sentiment_by_star, sentiment_by_star_midpoint, sentiment_by_star_sketched,
    sentiment_mismatch, mismatched_reviews, sample_by_hash,
)


def entry(spark: SparkSession) -> DataFrame:
    """Bad-review rate by delivery delay: scan, roll-ups, five joins, bins, rates."""
    return bad_rate_by_delivery_bucket(spark, SMOKE_FOLDER)


def _with_workers(query):
    """Python workers import this package from where it lies; on a cluster it comes with ``--py-files``."""
    @functools.wraps(query)
    def run(spark, folder):
        environment = spark.sparkContext.environment
        environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(
            [str(Path(__file__).resolve().parent), *filter(None, environment.get("PYTHONPATH", "").split(os.pathsep))]))
        return query(spark, folder)
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {query.__name__.replace("risk_model_auc", "risk_model"): query for query in REGISTERED}
    if training_data:
        found |= {name: _with_workers(query) for name, query in training_data.QUERIES.items()}
        if corpus_pipeline:
            found["pipeline"] = _with_workers(corpus_pipeline.run)
    return found


def oracle_sql() -> dict[str, str]:
    found = dict(ORACLES)
    if training_data:
        found |= training_data.ORACLES
        if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
