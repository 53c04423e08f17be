import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from starling.operators import binning
from starling.operators.levels import group_rare, level_counts
from starling.plans import risk_model, tree_nodes
from starling.plans.master import order_master
from starling.plans.risk_model import Levels, RiskModel, train, train_and_test_auc, with_scenarios
from starling.sources.trade_view import TradeFolder
from starling.streaming.scoring import score_stream


@pytest.fixture(scope="module")
def master(spark):
    return order_master(TradeFolder(spark, "/root/testdata/sf0.01").tables())


@pytest.fixture(scope="module")
def fitted(master):
    split = risk_model.split_orders(master)
    model = train(split, trees=5, depth=3)
    return model, model.score(split)


def order(spark, category, state, **numbers):
    values = {c: 1.0 for c in risk_model.NUMBERS} | numbers
    row = ("o", category, state, *[values[c] for c in risk_model.NUMBERS])
    kinds = ", ".join(f"{c} double" for c in risk_model.NUMBERS)
    return spark.createDataFrame([row], f"order_id string, product_category_name_english string, "
                                        f"seller_state string, {kinds}")


def test_rare_and_missing_levels_share_a_name(spark):
    rows = [("b",)] * 3 + [("a",)] * 3 + [("c",)] * 2 + [(None,)] * 9
    df = spark.createDataFrame(rows, "s string")
    found = {(r.s, r.g) for r in group_rare(df, level_counts(df, "s"), "s", 2, "other_state", "g").collect()}
    assert found == {("a", "a"), ("b", "b"), ("c", "other_state"), (None, "other_state")}


def test_input_vector(spark):
    levels = Levels(("other", "toys"), ("RJ", "SP"))
    assert levels.names()[6:] == ["cat_other", "cat_toys", "state_RJ", "state_SP"]
    def inputs(*args, **numbers):
        return list(order(spark, *args, **numbers).select(levels.vector()).first()[0].toArray())
    assert inputs("toys", "SP", total_price=None, freight_pct=float("nan")) == [1, 1, 0, 1, 0, 1, 0, 1, 0, 1]
    # A name unknown to training counts as the catch-all; without one, all its indicators are 0.
    assert inputs("new", "XX")[6:] == [1, 0, 0, 0]
    assert inputs(None, None)[6:] == [1, 0, 0, 0]


def test_levels_of_the_sample(master):
    levels = risk_model.find_levels(master)
    assert len(levels.categories) == 16 and "other" in levels.categories
    assert len(levels.states) == 11 and "NATION_9" in levels.states and "other_state" in levels.states
    wide = risk_model.find_levels(master.where("seller_state IS NOT NULL"), 1000, 1000)
    assert "other" not in wide.categories and "other_state" not in wide.states


def test_class_weights_balance(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "is_bad_review int")
    assert {r.is_bad_review: (r.n, r.weight) for r in risk_model.class_weights(df).collect()} == {
        0: (6, 8 / 12), 1: (2, 2.0)}


def test_model_separates(fitted):
    row = train_and_test_auc(fitted[1]).first()
    assert row.test_auc > 0.7 and row.gap == pytest.approx(row.test_auc - row.train_auc)
    assert row.n_train + row.n_test == 6442
    importance = fitted[0].importance(100).collect()
    assert importance[0].feature in ("delivery_delay_days", "delivery_time_days")
    assert sum(r.importance for r in importance) == pytest.approx(1.0)
    assert len(fitted[0].importance().collect()) == 15
    asked = fitted[0].importance(100, kind="splits").collect()
    nodes = sum(tree.numNodes for tree in fitted[0].trees.trees)
    assert sum(r.importance for r in asked) == (nodes - len(fitted[0].trees.trees)) / 2
    assert {r.feature for r in asked if r.importance} == {r.feature for r in importance if r.importance}


def test_saved_model_scores_alike_and_streams(spark, fitted, tmp_path):
    model, scored = fitted
    model.save(str(tmp_path / "model"))
    again = RiskModel.load(spark, str(tmp_path / "model"))
    assert again.levels == model.levels
    orders = scored.drop(risk_model.SCORE, "risk")
    expected = {r.order_id: (r.probability_bad, r.risk) for r in scored.collect()}
    assert {r.order_id: (r.probability_bad, r.risk) for r in again.score(orders).collect()} == expected

    orders.write.parquet(str(tmp_path / "arriving"))
    arriving = spark.readStream.schema(orders.schema).parquet(str(tmp_path / "arriving"))
    query = score_stream(again, arriving, str(tmp_path / "scored"), str(tmp_path / "progress"))
    query.awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "scored"))
    assert {r.order_id: r.risk for r in streamed.collect()} == {k: v[1] for k, v in expected.items()}


def test_scenarios(spark, fitted):
    base = order(spark, "brand#1", "NATION_1", total_price=0.0, total_freight=5.0, n_items=2.0)
    many = with_scenarios(base, "delivery_delay_days", [-10, 14]).collect()
    assert [(r.delivery_delay_days, r.freight_pct) for r in many] == [(-10.0, 0.0), (14.0, 0.0)]
    priced = with_scenarios(order(spark, "x", "y", total_freight=5.0), "total_price", [10, 20]).collect()
    assert [r.freight_pct for r in priced] == [0.5, 0.25]
    early, late = fitted[0].score(with_scenarios(
        order(spark, "brand#1", "NATION_1", delivery_time_days=30.0), "delivery_delay_days", [-20, 20])).orderBy(
        "delivery_delay_days").collect()
    assert late.probability_bad > early.probability_bad


def test_grid_and_indicators(spark, fitted):
    model = fitted[0]
    grid = risk_model.with_grid(order(spark, "brand#1", "NATION_9"), {
        "delivery_delay_days": [-3, 9], "product_category_name_english": ["brand#25", "never sold"], "n_items": [1, 2, 3]})
    scored = model.score(grid).withColumn("names", model.levels.indicators()).collect()
    assert len(scored) == 12 and all(0 <= r.probability_bad <= 1 for r in scored)
    assert {(r.product_category_name_english, tuple(r.names)) for r in scored} == {
        ("brand#25", ("cat_brand#25" if "brand#25" in model.levels.categories else "cat_other", "state_NATION_9")),
        ("never sold", ("cat_other", "state_NATION_9"))}


def test_importances_from_nodes(fitted):
    model = fitted[0]
    names = model.levels.names()
    expected = {name: float(x) for name, x in zip(names, model.trees.featureImportances.toArray())}
    found = {r.feature: r.importance for r in model.importance(100).collect()}
    assert found == pytest.approx(expected, abs=1e-12)
    with pytest.raises(ValueError):
        model.importance(kind="luck")


def test_scores_come_from_sets_of_leaves(spark, fitted, tmp_path):
    """Scoring needs the table of nodes only, takes an order's numbers unbinned, and makes one pass through Python."""
    model, scored = fitted
    model.save(str(tmp_path / "model"))
    apart = RiskModel(None, model.levels, str(tmp_path / "model"))
    orders = scored.drop(risk_model.SCORE, "risk")
    again = apart.score(orders)
    assert again.columns == scored.columns
    assert again._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    expected = {r.order_id: r.probability for r in model.trees.transform(
        orders.withColumn("features", model.levels.vector())).select("order_id", "probability").collect()}
    assert {r.order_id: r.probability_bad for r in again.collect()} == pytest.approx(
        {k: v[1] for k, v in expected.items()}, abs=1e-12)


def test_leaves_beyond_one_word():
    """A tree of 200 leaves, a chain to the left, and one without a question, against walking them."""
    n, edges = 200, np.arange(199) * 1.0
    left, right = np.arange(1, 2 * n - 1, 2), np.arange(2, 2 * n, 2)
    children = np.arange(2 * n)
    at = [0, *left[:-1]]                          # the node that asks for each edge, the largest first
    feature, threshold, prediction = np.zeros(2 * n, int), np.full(2 * n, np.inf), np.zeros(2 * n)
    lefts, rights = children.copy(), children.copy()
    for i, node in enumerate(at):
        lefts[node], rights[node], threshold[node] = left[i], right[i], edges[::-1][i]
        prediction[right[i]] = n - 1 - i
    prediction[-1] = 0.25
    trees = tree_nodes.Trees(np.array([0, 2 * n - 1]), np.array([0.01, 2.0]), lefts, rights, feature, threshold, prediction)
    x = np.array([[-1.0], [0.0], [0.5], [63.0], [63.5], [64.5], [127.5], [198.0], [198.5], [1e9]])
    margin = 0.01 * np.searchsorted(edges, x[:, 0], side="left") + 0.5
    assert trees.exits.words == 4
    assert trees.probability(x) == pytest.approx(1 / (1 + np.exp(-2 * margin)), abs=1e-12)
    assert len(trees.probability(np.zeros((0, 1)))) == 0


def test_probabilities_from_nodes(fitted):
    model, scored = fitted
    trees = tree_nodes.Trees.of(model.nodes())
    rows = scored.limit(500).select(model.levels.inputs().alias("x"), risk_model.SCORE).collect()
    assert trees.probability(np.array([r.x for r in rows])) == pytest.approx([r.probability_bad for r in rows], abs=1e-12)


GRIDS = [{"delivery_delay_days": (-5, 0, 10)}, {"total_price": (0.0, 20.0, 500.0)}, {"freight_pct": (0.9,)},
         {"product_category_name_english": ("brand#25", "unseen"), "seller_state": ("NATION_9", "nowhere")},
         {"total_freight": (0.0, 7.5), "n_items": (1, 4), "delivery_time_days": (3, 60)}]


@pytest.mark.parametrize("grid", GRIDS, ids=lambda g: "-".join(g))
def test_grid_means_equal_scored_copies(fitted, grid):
    model, orders = fitted[0], fitted[1].drop(risk_model.SCORE, "risk")
    copied = model.score(risk_model.with_grid(orders, grid))
    if "freight_pct" in grid:                          # follows from price and freight, whatever is asked
        copied = copied.withColumn("freight_pct", F.lit(0.9))
    expected = {tuple(r[:-2]): tuple(r[-2:]) for r in copied.groupBy(*grid).agg(
        F.count(F.lit(1)), F.avg(risk_model.SCORE)).collect()}
    found = {tuple(r[c] for c in grid): (r.n_orders, r.mean_score)
             for r in risk_model.grid_means(model, orders, grid).collect()}
    assert set(found) == set(expected)
    for key, (n, mean) in expected.items():
        assert found[key][0] == n and found[key][1] == pytest.approx(mean, abs=1e-9)


def test_grid_means_copy_no_order(spark, fitted):
    model, orders = fitted[0], fitted[1].drop(risk_model.SCORE, "risk")
    def plan(n):
        means = risk_model.grid_means(model, orders, {"delivery_delay_days": range(n)})
        return means._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan(50) and plan(50).count("MapInPandas") == 1
    assert plan(50).count("\n") == plan(2).count("\n")
    # Values between two edges of the bins are worked out once.
    trees = tree_nodes.Trees.of(model.nodes())
    assert len(set(trees.cells(0, np.linspace(-1e6, 1e6, 5000)).tolist())) <= 33
    none = risk_model.grid_means(model, orders.limit(0), {"delivery_delay_days": (1,)}).collect()
    assert [(r.n_orders, r.mean_score) for r in none] == [(0, None)]


def test_orders_alike_are_merged(spark, master):
    training = risk_model.split_orders(master).where("is_test = 0")
    levels = risk_model.find_levels(training)
    coarse = Levels(levels.categories, levels.states, ((0.0,),) + ((),) * 5)
    rows = risk_model.training_rows(training, coarse).cache()
    assert rows.count() <= 2 * 2 * 17 * 12
    weights = {r.is_bad_review: r.n * r.weight for r in risk_model.class_weights(training).collect()}
    assert {r[0]: r[1] for r in rows.groupBy("is_bad_review").sum("weight").collect()} == pytest.approx(weights)
    assert rows.agg(F.sum("n_orders")).first()[0] == training.count()


def test_bins(spark):
    df = spark.createDataFrame([(float(i % 10), None if i % 3 else float(i)) for i in range(1000)], "a double, b double")
    edges = binning.quantile_edges(df, ["a", "b"], 4)
    assert set(edges["a"]) <= set(range(10)) and len(edges["a"]) == 3
    counts = [r[1] for r in df.where("b IS NOT NULL").groupBy(binning.bin_of(F.col("b"), edges["b"]).alias("x")).count().collect()]
    assert len(counts) == 4 and max(counts) - min(counts) <= 6
    assert binning.quantile_edges(df.limit(0), ["a"], 4) == {"a": ()}
    one = spark.createDataFrame([(x,) for x in (0.5, 1.0, 1.5, 2.0, 9.0)], "v double")
    assert [r[0] for r in one.orderBy("v").select(binning.bin_of(F.col("v"), (1.0, 2.0))).collect()] == [0, 0, 1, 1, 2]
    assert one.select(binning.bin_of(F.col("v"), ())).first()[0] == 0


def test_bins_keep_the_quality(master):
    split = risk_model.split_orders(master)
    training = split.where("is_test = 0")
    levels = risk_model.find_levels(split)
    whole = GBTClassifier(labelCol="is_bad_review", maxIter=5, maxDepth=3, stepSize=0.05, seed=42, minInstancesPerNode=20,
                          weightCol="weight").fit(risk_model.training_rows(training, levels))
    unbinned = train_and_test_auc(RiskModel(whole, levels).score(split)).first().test_auc
    binned = train_and_test_auc(train(split, trees=5, depth=3).score(split)).first().test_auc
    assert abs(unbinned - binned) < 0.02
