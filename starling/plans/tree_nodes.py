"""The trees of a saved boosted model as a table of nodes, and what can be read off it: importances of inputs, and mean scores
under what-if values without a copy of any order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def tree_nodes(spark: SparkSession, path: str) -> DataFrame:
    """One row per node: tree, tree_weight, node, its children left and right (-1 for a leaf), feature and threshold of the
    question (left if not above it), prediction, gain, and the weight of the training orders that reached it."""
    node = F.col("nodeData")
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "about", "tree_weight").select("tree", "tree_weight")
    return (spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("node"), node["leftChild"].alias("left"),
        node["rightChild"].alias("right"), node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], 0).alias("threshold"), node["prediction"].alias("prediction"),
        node["gain"].alias("gain"), F.get(node["impurityStats"], 0).alias("weight")).join(weights, "tree"))


def importances(nodes: DataFrame, names: Sequence[str], kind: str = "gain") -> DataFrame:
    """``feature`` and ``importance`` of every input: ``gain``, shares of the weighted gain of all questions, or
    ``splits``, the number of questions asked."""
    if kind not in ("gain", "splits"):
        raise ValueError(f"unknown kind of importance {kind}")
    figure = F.sum(F.col("gain") * F.col("weight")) if kind == "gain" else F.count(F.lit(1)).cast("double")
    asked = nodes.where("left >= 0").groupBy(F.col("feature").alias("at")).agg(figure.alias("figure"))
    inputs = nodes.sparkSession.createDataFrame(list(enumerate(names)), "at int, feature string")
    every = inputs.join(asked, "at", "left").select("feature", F.coalesce("figure", F.lit(0.0)).alias("importance"))
    if kind == "splits":
        return every
    total = every.agg(F.sum("importance").alias("total"))                                  # one row
    return every.crossJoin(total).select("feature", F.when(F.col("total") > 0, F.col("importance") / F.col("total"))
                                         .otherwise(0.0).alias("importance"))


@dataclass(frozen=True)
class Trees:
    """The nodes of all trees in arrays, one tree after another, children by their place in the arrays."""
    first: np.ndarray           # place of each tree's root
    weight: np.ndarray          # of each tree
    left: np.ndarray            # a leaf is its own child
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    prediction: np.ndarray

    @staticmethod
    def of(nodes: DataFrame) -> Trees:
        """A model has a bounded number of trees and of levels, so its nodes come to the driver."""
        rows = nodes.toPandas().sort_values(["tree", "node"], ignore_index=True)
        first = np.flatnonzero(rows["node"] == 0)
        start = first[rows["tree"].rank(method="dense").astype(int).to_numpy() - 1]
        leaf = rows["left"].to_numpy() < 0
        here = np.arange(len(rows))
        left = np.where(leaf, here, start + rows["left"].to_numpy())
        right = np.where(leaf, here, start + rows["right"].to_numpy())
        return Trees(first, rows["tree_weight"].to_numpy()[first], left, right, np.where(leaf, 0, rows["feature"].to_numpy()),
                     np.where(leaf, np.inf, rows["threshold"].to_numpy(float)), rows["prediction"].to_numpy())

    def cells(self, feature: int, values: np.ndarray) -> np.ndarray:
        """Which values of an input no question of the trees can tell apart: equal numbers."""
        asked = np.unique(self.threshold[(self.feature == feature) & np.isfinite(self.threshold)])
        return np.searchsorted(asked, values, side="left")

    @cached_property
    def exits(self) -> Exits:
        return Exits.of(self)

    def probability(self, inputs: np.ndarray) -> np.ndarray:
        """The probability of class 1 for rows of inputs."""
        exits = self.exits
        return np.concatenate([exits.probability(exits.open(inputs[at:at + ROWS])) for at in range(0, len(inputs), ROWS)]
                              or [np.zeros(0)])


#: Rows whose open leaves are worked out at a time: what a processor's cache holds.
ROWS = 256


@dataclass(frozen=True)
class Exits:
    """The trees as sets of leaves, so that a row is scored without walking them. A question that an input answers with
    "above" closes the leaves of its left side; of the leaves that all inputs leave open, the leftmost one is the row's. What a
    cell of an input leaves open is one bit a leaf, over all trees at once."""
    asked: dict[int, np.ndarray]        # thresholds by input, ascending
    left_open: dict[int, np.ndarray]    # by input: cells by words by trees
    values: np.ndarray                  # of the leaves, 64 a word, words by trees, times the weight of the tree
    words: int                          # that hold the leaves of the largest tree
    n_trees: int

    @staticmethod
    def of(trees: Trees) -> Exits:
        place = np.zeros(len(trees.left), int)                      # of the first leaf at or below a node
        tree_of = np.zeros(len(trees.left), int)
        inner, sizes = [], []
        for tree, root in enumerate(trees.first):
            n, todo = 0, [int(root)]
            while todo:
                node = todo.pop()
                place[node], tree_of[node] = n, tree
                if trees.left[node] == node:
                    n += 1
                else:
                    inner.append(node)
                    todo += [int(trees.right[node]), int(trees.left[node])]
            sizes.append(n)
        words = -(-max(sizes) // 64)
        values = np.zeros((len(sizes), words * 64))
        leaf = trees.left == np.arange(len(trees.left))
        values[tree_of[leaf], place[leaf]] = (trees.weight[tree_of] * trees.prediction)[leaf]
        inner = np.array(inner, int)
        asked = {int(f): np.unique(trees.threshold[inner[trees.feature[inner] == f]]) for f in np.unique(trees.feature[inner])}
        left_open = {f: np.full((len(ends) + 1, words, len(sizes)), ~np.uint64(0)) for f, ends in asked.items()}
        whole = (1 << words * 64) - 1
        for node in inner:
            feature, tree = int(trees.feature[node]), tree_of[node]
            closed = (1 << int(place[trees.right[node]])) - (1 << int(place[node]))
            cell = np.searchsorted(asked[feature], trees.threshold[node]) + 1
            left_open[feature][cell, :, tree] &= np.frombuffer((whole ^ closed).to_bytes(words * 8, "little"), "<u8")
        for cells in left_open.values():
            np.bitwise_and.accumulate(cells, axis=0, out=cells)
        return Exits(asked, left_open, values.ravel(), words, len(sizes))

    def open(self, inputs: np.ndarray, features: Iterable[int] | None = None) -> np.ndarray:
        """Rows by words by trees: the leaves left open by the given inputs, or by all."""
        left = np.full((len(inputs), self.words, self.n_trees), ~np.uint64(0))
        taken = np.empty_like(left)
        for feature in self.asked if features is None else features:
            if feature not in self.asked:
                continue
            ends, cells = self.asked[feature], self.left_open[feature]
            if len(ends) > 1:
                np.take(cells, np.searchsorted(ends, inputs[:, feature], side="left"), axis=0, out=taken, mode="clip")
                np.bitwise_and(left, taken, out=left)
            else:                                                   # a flag, which few rows have set
                some = np.flatnonzero(inputs[:, feature] > ends[0])
                if len(some):
                    left[some] &= cells[1]
        return left

    def probability(self, left: np.ndarray) -> np.ndarray:
        """The probability of class 1 by the leaves left open."""
        word, at = left[:, -1], self.words - 1
        for w in range(self.words - 2, -1, -1):
            here = left[:, w] != 0
            word, at = np.where(here, left[:, w], word), np.where(here, w, at)
        lowest = (word & (~word + np.uint64(1))).astype(np.float64)
        bit = (lowest.view(np.int64) >> 52) - 1023                  # its exponent
        start = np.arange(self.n_trees) * (64 * self.words)
        return 1 / (1 + np.exp(-2 * self.values[start + at * 64 + bit].sum(1)))


def mean_scores(inputs: DataFrame, trees: Trees, grid: Sequence[dict[int, float]], ratio: tuple[int, int, int] | None = None,
                edges: dict[int, Sequence[float]] | None = None) -> DataFrame:
    """``at`` (place in ``grid``), ``n_orders`` and ``mean_score``: the mean probability of class 1 over all rows of
    ``inputs`` (column ``x``, an array) when the inputs named in the grid entry have its values.

    No row is copied: a task works through its rows once, finds the leaves that the inputs named nowhere leave open, and takes
    from them, per kind of entry, what its values close; it hands on one sum a kind. Entries whose values no tree tells apart are
    one kind. ``ratio`` names an input that follows from two others (share, part,
    whole; 0 without a whole), whatever a grid entry says of it; ``edges`` cut inputs into bins before the trees see them.
    """
    edges = edges or {}
    grid = list(grid)

    def binned(x: np.ndarray) -> np.ndarray:
        out = x.copy()
        for feature, ends in edges.items():
            out[:, feature] = np.searchsorted(np.asarray(ends, float), x[:, feature], side="left")
        return out

    def changed(x: np.ndarray, entry: dict[int, float]) -> np.ndarray:
        out = x.copy()
        for feature, value in entry.items():
            out[:, feature] = value
        if ratio:
            share, part, whole = ratio
            positive = out[:, whole] > 0
            out[:, share] = np.where(positive, out[:, part] / np.where(positive, out[:, whole], 1), 0)
        return binned(out)

    def kind(entry: dict[int, float]) -> tuple:
        def cell(feature, value):
            if ratio and feature in ratio:
                return value                                       # its exact value goes into the share
            seen = binned(np.full((1, max(feature, *edges, 0) + 1), value))[0, feature]
            return int(trees.cells(feature, np.array([seen]))[0])
        return tuple(sorted((feature, cell(feature, value)) for feature, value in entry.items()))

    kinds: dict[tuple, list[int]] = {}
    for at, entry in enumerate(grid):
        kinds.setdefault(kind(entry), []).append(at)

    exits = trees.exits
    share = ratio[:1] if ratio else ()
    moved = set(share).union(*grid)
    fixed = [f for f in exits.asked if f not in moved]
    shown = [grid[same[0]] for same in kinds.values()]
    given, own = [], []                   # what an entry's values leave open, and the inputs that each row has of its own
    for entry in shown:
        row = np.zeros((1, max(moved | set(edges) | set(exits.asked), default=0) + 1))
        for feature, value in entry.items():
            row[0, feature] = value
        given.append(exits.open(binned(row), [f for f in entry if f not in share]))
        own.append((tuple(sorted(f for f in moved if f not in entry or f in share)),
                    tuple(entry.get(f) for f in ratio or ())))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(len(kinds)), 0
        for batch in batches:
            x = np.stack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, 1))
            n += len(x)
            for start in range(0, len(x), ROWS):
                rows = x[start:start + ROWS]
                kept = exits.open(binned(rows), fixed)
                alike = {what: kept & exits.open(changed(rows, entry), what[0]) for what, entry in dict(zip(own, shown)).items()}
                total += [exits.probability(alike[what] & values).sum() for what, values in zip(own, given)]
        yield pd.DataFrame([(at, s, n) for same, s in zip(kinds.values(), total) for at in same],
                           columns=["at", "total", "n"])

    return (inputs.select("x").mapInPandas(score, "at int, total double, n bigint").groupBy("at")
            .agg(F.sum("n").alias("n_orders"), (F.sum("total") / F.sum("n")).alias("mean_score")))


def combinations(values: dict[str, Sequence]) -> list[dict]:
    """All combinations of the given values, in order."""
    return [dict(zip(values, entry)) for entry in product(*values.values())]
