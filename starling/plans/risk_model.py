"""A boosted-tree model of bad reviews: inputs, training, evaluation, scoring of what-if orders."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from starling.functions import risk_tier, safe_ratio
from starling.operators.binning import bin_of, merged, quantile_edges
from starling.operators.levels import group_rare, level_counts, top_levels
from starling.operators.ordered import auc, stratified_split
from starling.operators.rates import BAD, highest
from starling.plans import tree_nodes
from starling.plans.dashboard import CATEGORY, STATE
from starling.session import checkpoint_folder, run_folder, settled

# The model's inputs, how many levels keep a name, and the names of the rest.
NUMBERS = ("delivery_delay_days", "delivery_time_days", "total_price", "total_freight", "freight_pct", "n_items")
N_CATEGORIES, N_STATES = 15, 10
OTHER_CATEGORY, OTHER_STATE = "other", "other_state"
SCORE = "probability_bad"


# ---------------------------------------------------------------- inputs

def grouped_levels(master: DataFrame, n_categories: int = N_CATEGORIES, n_states: int = N_STATES) -> DataFrame:
    """Adds ``cat_grouped`` and ``state_grouped``: frequent categories and states by name, the rest as one.
    Reads ``master`` twice, so give it the stored mart or a settled frame."""
    counts = level_counts(master, CATEGORY, STATE)
    named = group_rare(master, counts, CATEGORY, n_categories, OTHER_CATEGORY, "cat_grouped")
    return group_rare(named, counts, STATE, n_states, OTHER_STATE, "state_grouped")


def frequent_levels(master: DataFrame, n_categories: int = N_CATEGORIES, n_states: int = N_STATES) -> DataFrame:
    """The top categories and states with their counts, both from one pass over the orders."""
    counts = level_counts(master, CATEGORY, STATE)
    parts = [top_levels(counts, column, n).select(F.lit(kind).alias("kind"), F.col(column).alias("level"), "n")
             for kind, column, n in (("category", CATEGORY, n_categories), ("state", STATE, n_states))]
    return parts[0].unionByName(parts[1])


def _number(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.when(F.isnan(value), F.lit(0.0)).otherwise(F.coalesce(value, F.lit(0.0)))


def model_numbers(df: DataFrame) -> DataFrame:
    """The six numeric inputs, missing values as 0."""
    return df.withColumns({c: _number(c) for c in NUMBERS})


def class_weights(df: DataFrame, label: str = BAD) -> DataFrame:
    """Per class: rows, and the weight N / (classes * n) under which all classes count alike."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    classes = Window.partitionBy()        # over one row per class
    return counts.withColumn("weight", F.sum("n").over(classes) / (F.count("n").over(classes) * F.col("n")))


@dataclass(frozen=True)
class Levels:
    """The category and state names that got a column of their own in training, sorted, and the bins of the numeric
    inputs: the edges of each in the order of ``NUMBERS``, or none where the numbers are used as they are."""
    categories: tuple[str, ...]
    states: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...] = ()

    def names(self) -> list[str]:
        return [*NUMBERS, *["cat_" + v for v in self.categories], *["state_" + v for v in self.states]]

    def parts(self) -> dict[str, Column]:
        """An order's inputs before the names become columns: numbers (or their bins), shown category and state. A name
        without a column counts as the catch-all."""
        numbers = {c: bin_of(_number(c), self.edges[i]) if self.edges else _number(c) for i, c in enumerate(NUMBERS)}
        def shown(column, known, other):
            return F.when(F.col(column).isin(*known), F.col(column)).otherwise(F.lit(other))
        return numbers | {CATEGORY: shown(CATEGORY, self.categories, OTHER_CATEGORY),
                          STATE: shown(STATE, self.states, OTHER_STATE)}

    def inputs(self, parts: dict[str, Column] | None = None) -> Column:
        """The inputs in the order of ``names`` as an array. Where the catch-all has no column either, all indicators of its
        kind are 0."""
        parts = parts or self.parts()
        flags = [(parts[column] == F.lit(v)).cast("double")
                 for column, known in ((CATEGORY, self.categories), (STATE, self.states)) for v in known]
        return F.array(*[parts[c] for c in NUMBERS], *flags)

    def raw(self) -> list[Column]:
        """What ``rows`` takes: the numbers as they are, and the places (from 1) of the shown category and state; 0 for none."""
        parts = replace(self, edges=()).parts()
        places = [F.array_position(F.array(*[F.lit(v) for v in known]).cast("array<string>"), parts[column])
                  for column, known in ((CATEGORY, self.categories), (STATE, self.states))]
        return [*[parts[c] for c in NUMBERS], *places]

    def rows(self, raw: Sequence[np.ndarray]) -> np.ndarray:
        """The inputs of many orders, a row each, out of the columns of ``raw``."""
        out = np.zeros((len(raw[0]), len(self.names())))
        for i, values in enumerate(raw[:len(NUMBERS)]):
            out[:, i] = np.searchsorted(np.asarray(self.edges[i], float), values, side="left") if self.edges else values
        first = len(NUMBERS) - 1
        for place, known in zip(raw[len(NUMBERS):], (self.categories, self.states)):
            some = np.flatnonzero(place > 0)
            out[some, first + place[some]] = 1.0
            first += len(known)
        return out

    def vector(self, parts: dict[str, Column] | None = None) -> Column:
        return array_to_vector(self.inputs(parts))

    def indicators(self) -> Column:
        """Names of the category and state columns that are not 0 for an order, out of its input vector."""
        first = len(NUMBERS)
        names = F.array(*[F.lit(name) for name in self.names()[first:]])
        shown = F.slice(vector_to_array(self.vector()), first + 1, len(self.names()) - first)
        return F.filter(F.transform(shown, lambda x, i: F.when(x != 0, F.get(names, i))), lambda name: name.isNotNull())


def find_levels(master: DataFrame, n_categories: int = N_CATEGORIES, n_states: int = N_STATES) -> Levels:
    """Names that get a column. Only these few come to the driver; the catch-all is listed if it occurs."""
    found = {"category": set(), "state": set()}
    for row in frequent_levels(master, n_categories, n_states).collect():
        found[row["kind"]].add(row["level"])
    rest = [F.count_if(F.col(column).isNull() | ~F.col(column).isin(*found[kind])).alias(kind)
            for kind, column in (("category", CATEGORY), ("state", STATE))]
    beyond = master.agg(*rest).first()
    for kind, other in (("category", OTHER_CATEGORY), ("state", OTHER_STATE)):
        if beyond[kind]:
            found[kind].add(other)
    return Levels(tuple(sorted(found["category"])), tuple(sorted(found["state"])))


# ---------------------------------------------------------------- the fitted model

@dataclass(frozen=True)
class RiskModel:
    trees: GBTClassificationModel
    levels: Levels
    path: str | None = None         # where it is saved

    @cached_property
    def arrays(self) -> tree_nodes.Trees:
        return tree_nodes.Trees.of(self.nodes())

    def score(self, orders: DataFrame) -> DataFrame:
        """Adds ``probability_bad`` and ``risk``. Every step is per row, so streaming frames work as well.

        A task cuts its numbers into bins and finds the leaves of a batch of orders in all trees at once."""
        levels, exits = self.levels, self.arrays.exits
        shared = orders.sparkSession.sparkContext.broadcast(exits)

        @F.pandas_udf("double")
        def probability(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for batch in batches:
                columns = [c.to_numpy() for c in batch]
                parts = [levels.rows([c[at:at + tree_nodes.ROWS] for c in columns])
                         for at in range(0, len(columns[0]), tree_nodes.ROWS)]
                yield pd.Series(np.concatenate([shared.value.probability(shared.value.open(x)) for x in parts] or [np.zeros(0)]))

        scored = orders.select("*", probability(*levels.raw()).alias(SCORE))
        return scored.withColumn("risk", risk_tier(F.col(SCORE)))

    def nodes(self) -> DataFrame:
        """The trees as a table of nodes, read from where the model is saved; one that is not is saved for the run."""
        spark, path = SparkSession.active(), self.path
        if path is None:
            path = run_folder(spark, "model")
            self.save(path)
        return tree_nodes.tree_nodes(spark, f"{path}/trees")

    def importance(self, n: int = 15, kind: str = "gain") -> DataFrame:
        """The ``n`` most important inputs: by ``gain``, shares that sum to 1 over all inputs, or by
        ``splits``, the number of times the trees ask for them. Works on the model's nodes, not on data."""
        return highest(tree_nodes.importances(self.nodes(), self.levels.names(), kind), "importance", "feature", n)

    def save(self, path: str) -> None:
        self.trees.write().overwrite().save(f"{path}/trees")
        rows = [(list(self.levels.categories), list(self.levels.states), [list(e) for e in self.levels.edges])]
        (SparkSession.active().createDataFrame(rows, "categories array<string>, states array<string>, "
                                                     "edges array<array<double>>")
         .coalesce(1).write.mode("overwrite").parquet(f"{path}/levels"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> RiskModel:
        row = spark.read.parquet(f"{path}/levels").first()
        return RiskModel(GBTClassificationModel.load(f"{path}/trees"),
                         Levels(tuple(row.categories), tuple(row.states), tuple(map(tuple, row.edges))), path)


# ---------------------------------------------------------------- training and evaluation

# The number, depth and rate of the trees, the seed, and the share of test orders.
TREES, DEPTH, RATE, SEED, TEST_SHARE = 150, 8, 0.05, 42, 0.2


def split_orders(master: DataFrame, key: str = "order_id", seed: int = SEED, test_share: float = TEST_SHARE) -> DataFrame:
    """The model's inputs and outcome of all orders, with ``is_test`` for a stratified part. The inputs are settled once:
    boosting passes over them some trees-times-depth times, and must not redo the joins when an executor is lost."""
    inputs = settled(master.select(key, CATEGORY, STATE, BAD, *NUMBERS))
    return stratified_split(inputs, key, BAD, seed, test_share)


def training_rows(training: DataFrame, levels: Levels) -> DataFrame:
    """``training`` with a weight under which both classes count alike, orders alike in outcome and inputs merged into one
    row: label, ``weight``, ``n_orders`` and ``features``. With binned inputs there are at most as many rows as
    combinations of bins and names, however many orders."""
    weights = {r[BAD]: r["weight"] for r in class_weights(training).collect()}
    weight = F.when(F.col(BAD) == 1, weights.get(1, 1.0)).otherwise(weights.get(0, 1.0))
    parts = levels.parts()
    alike = merged(training.select(F.col(BAD).cast("double").alias(BAD), weight.alias("weight"),
                                   *[c.alias(name) for name, c in parts.items()]),
                   [BAD, *parts], weight=F.col("weight"), n_orders=F.lit(1))
    return alike.select(BAD, "weight", "n_orders", levels.vector({name: F.col(name) for name in parts}).alias("features"))


def train(split: DataFrame, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, seed: int = SEED,
          min_leaf: int = 20, bins: int = 32) -> RiskModel:
    """Fits the model on the training part of ``split``.

    Numeric inputs are cut into ``bins`` quantile bins once, and orders that are then alike are merged, so that boosting
    passes over combinations and not over orders. A leaf holds at least ``min_leaf`` orders by weight.
    """
    checkpoint_folder(split.sparkSession)
    training = split.where("is_test = 0")
    edges = quantile_edges(model_numbers(training), NUMBERS, bins)
    levels = replace(find_levels(split), edges=tuple(edges[c] for c in NUMBERS))
    rows = settled(training_rows(training, levels).hint("rebalance"))
    whole = rows.agg(F.sum("weight")).first()[0] or 1.0
    booster = GBTClassifier(labelCol=BAD, weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=rate, maxBins=max(bins, 2),
                            seed=seed, minWeightFractionPerNode=min(min_leaf / whole, 0.49), maxMemoryInMB=512,
                            checkpointInterval=25)
    # A job for each level of each tree: full partitions keep their number, and so the cost of a job, down.
    return RiskModel(booster.fit(rows), levels)


def train_and_test_auc(scored: DataFrame) -> DataFrame:
    """One row: AUC on training and test orders, and how much lower the test one is (a negative gap)."""
    sides = auc(scored, BAD, SCORE, by=["is_test"])
    def of(side, figure):
        return F.max(F.when(F.col("is_test") == side, figure))
    return (sides.agg(of(0, F.col("n_pos") + F.col("n_neg")).alias("n_train"),
                      of(1, F.col("n_pos") + F.col("n_neg")).alias("n_test"),
                      of(0, F.col("auc")).alias("train_auc"), of(1, F.col("auc")).alias("test_auc"))
            .withColumn("gap", F.col("test_auc") - F.col("train_auc")))


# ---------------------------------------------------------------- what-if orders

def with_freight_share(orders: DataFrame) -> DataFrame:
    """Sets ``freight_pct`` from freight and price; 0 for a free order."""
    ratio = safe_ratio(F.col("total_freight"), F.col("total_price"))
    return orders.withColumn("freight_pct", F.when(F.col("total_price") > 0, ratio).otherwise(F.lit(0.0)))


def with_scenarios(orders: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Every order once per given value of ``column``, its own value replaced. Freight share follows."""
    kind = orders.schema[column].dataType
    options = F.array(*[F.lit(v).cast(kind) for v in values])
    return with_freight_share(orders.drop(column).withColumn(column, F.explode(options)).select(*orders.columns))


def with_grid(orders: DataFrame, values: dict[str, Sequence]) -> DataFrame:
    """Every order once per combination of the given values."""
    for column, options in values.items():
        orders = with_scenarios(orders, column, options)
    return orders


def grid_means(model: RiskModel, orders: DataFrame, values: dict[str, Sequence]) -> DataFrame:
    """Mean score of all ``orders`` under each combination of the given values, with ``n_orders``: what scoring
    ``with_grid`` and averaging gives, but without a copy of any order. Freight share follows."""
    names, numbers = model.levels.names(), list(NUMBERS)
    entries = tree_nodes.combinations(values)

    def inputs(entry):
        found = {}
        for column, value in entry.items():
            if column in numbers:
                kind = orders.schema[column].dataType.typeName()
                found[numbers.index(column)] = float(int(value) if kind in ("integer", "long") else value)
                continue
            known, other, prefix = ((model.levels.categories, OTHER_CATEGORY, "cat_") if column == CATEGORY else
                                    (model.levels.states, OTHER_STATE, "state_"))
            shown = value if value in known else other
            found |= {names.index(prefix + v): float(v == shown) for v in known}
        return found

    raw = replace(model.levels, edges=())
    edges = dict(enumerate(model.levels.edges))
    share = tuple(map(numbers.index, ("freight_pct", "total_freight", "total_price")))
    means = tree_nodes.mean_scores(orders.select(raw.inputs().alias("x")), model.arrays,
                                   [inputs(e) for e in entries], share, edges)
    kinds = ", ".join(f"`{c}` {orders.schema[c].dataType.simpleString()}" for c in values)
    def typed(column, value):
        return int(value) if orders.schema[column].dataType.typeName() in ("integer", "long") else value
    grid = orders.sparkSession.createDataFrame(
        [(at, *(typed(c, v) for c, v in e.items())) for at, e in enumerate(entries)], f"at int, {kinds}")
    # Without orders there is no mean, and the count is 0.
    return grid.join(means, "at", "left").withColumn("n_orders", F.coalesce("n_orders", F.lit(0))).drop("at")
