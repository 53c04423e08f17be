"""Toxicity by class-conditional Kneser-Ney language models of characters.

Toxic and ordinary labelled texts each give an interpolated Kneser-Ney model over 28 symbols: letters without accents,
digits, and runs of anything else. Letters of other scripts are dealt to the 26 by their code points, so that words of any
script keep a shape of their own, though some letters of a script share one. Orders five to three are of the class alone; below, both
classes share the continuation counts of two and one symbols, so an expression that a class has hardly seen is
judged by what is usual in both. What the models say of a symbol after four others is one table of log-likelihood
ratios with 28**5 places, the largest it can be however many texts are learned from.

A text is scored by the length-normalised ratio of its likelihoods, over the whole text and over its most toxic
passage of ``PASSAGE`` symbols, as one bad sentence makes a long text toxic. A logistic regression fitted on labelled
texts that the models have not seen turns the two into a score.

NULL and empty texts are scored like any text, as one without a toxic passage. Labels other than 0 and 1 are not
learned from. Without both classes every score is 0.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from starling.llm.byte_bpe import slices
from starling.llm.pieces import LETTER, Slice, character_classes
from starling.session import settled

SYMBOLS, LETTERS, ORDER = 28, 26, 5
PASSAGE = 16
#: Of the labelled texts, one part in so many fits the regression, the others the models.
CALIBRATION_PARTS = 4
THRESHOLD = 0.7
SLICE_CHARS = 2_000_000
FEATURES = ("passage", "whole")


def symbol_table() -> np.ndarray:
    """Per code point: 1 to 26 for a letter, 27 for a digit, 0 for anything else. Capitals count as small letters."""
    letter = character_classes() == LETTER
    small = np.arange(len(letter))
    points = np.flatnonzero(letter)
    small[points] = [ord(chr(p).lower()[0]) for p in points]
    table = np.where(letter, 1 + small % LETTERS, 0).astype(np.uint8)
    table[ord("0"):ord("9") + 1] = SYMBOLS - 1
    for point in range(0x41, 0x250):
        plain = unicodedata.normalize("NFKD", chr(point).lower())[0]
        if "a" <= plain <= "z" and table[point]:
            table[point] = ord(plain) - ord("a") + 1
    return table


_TABLE: list[np.ndarray] = []


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each symbol with the four before it, in order, and how many each text has. Before a text
    there is nothing but breaks."""
    if not _TABLE:
        _TABLE.append(symbol_table())
    s = Slice.of(texts)
    symbol = _TABLE[0][s.points]
    keep = (symbol > 0) | s.first[:-1]
    keep[1:] |= symbol[:-1] > 0
    ends = np.concatenate(([0], np.cumsum(keep)))[np.concatenate(([0], s.lengths.cumsum()))]
    symbol, sizes = symbol[keep].astype(np.int32), np.diff(ends)
    place = np.arange(len(symbol)) - np.repeat(ends[:-1], sizes)
    code = symbol.copy()
    for back in range(1, ORDER):
        earlier = np.zeros_like(symbol)
        earlier[back:] = symbol[:len(symbol) - back]
        code += np.where(place >= back, earlier, 0) * SYMBOLS ** back
    return code, sizes


# ---------------------------------------------------------------- the models

def counts(labelled: DataFrame, text: str, toxic: str) -> pd.DataFrame:
    """How often each five symbols occur in either class: at most 28**5 rows."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label in (0, 1):
                for some in slices(batch["t"][batch["y"] == label], SLICE_CHARS):
                    code, n = np.unique(grams(some)[0], return_counts=True)
                    yield pd.DataFrame({"y": label, "code": code, "n": n})

    rows = labelled.select(F.col(text).alias("t"), F.col(toxic).cast("int").alias("y")).where("y IN (0, 1)")
    return (rows.mapInPandas(count, "y int, code int, n bigint").groupBy("code")
            .agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("ordinary"),
                 F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic")).toPandas())


def _discount(n: np.ndarray) -> float:
    """The usual estimate from how many are seen once and twice."""
    once, twice = np.count_nonzero(n == 1), np.count_nonzero(n == 2)
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def _interpolated(n: np.ndarray, below: np.ndarray, discount: float) -> np.ndarray:
    """Probabilities of the last symbol given those before, from counts ``n`` (contexts by symbols) and those
    given a context shorter by its first symbol."""
    total = n.sum(1, keepdims=True)
    kinds = (n > 0).sum(1, keepdims=True)
    below = np.tile(below, (len(n) // len(below), 1))
    seen = (np.maximum(n - discount, 0) + discount * kinds * below) / np.maximum(total, 1)
    return np.where(total > 0, seen, below).astype(np.float32)


def _continuations(n: np.ndarray) -> np.ndarray:
    """Before how many different symbols each shorter expression is seen."""
    return (n.reshape(SYMBOLS, -1) > 0).sum(0).astype(np.float32).reshape(-1, SYMBOLS)


def log_ratios(code: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """log P(symbol | four before, toxic) - log P(symbol | four before, ordinary), for every five symbols."""
    by_class = []
    for n in (ordinary, toxic):
        full = np.zeros(SYMBOLS ** ORDER, np.float32)
        full[code] = n
        four = _continuations(full)
        by_class.append((full.reshape(-1, SYMBOLS), four, _continuations(four)))
    two = sum(_continuations(three) for _, _, three in by_class)
    one = _continuations(two)
    shared = _interpolated(one, np.full((1, SYMBOLS), 1 / SYMBOLS, np.float32), _discount(one))
    shared = _interpolated(two, shared, _discount(two))
    sides = [(full, _interpolated(four, _interpolated(three, shared, _discount(three)), _discount(four)), _discount(full))
             for full, four, three in by_class]
    found = np.zeros((SYMBOLS, SYMBOLS ** (ORDER - 1)), np.float16)
    for first in range(SYMBOLS):                            # a part at a time: the driver holds few whole tables
        part = slice(first * SYMBOLS ** 3, (first + 1) * SYMBOLS ** 3)
        logs = [np.log(_interpolated(full[part], below, discount)).reshape(-1) for full, below, discount in sides]
        found[first] = logs[1] - logs[0]
    return found.reshape(-1)


def features(ratios: np.ndarray, texts: list[str]) -> np.ndarray:
    """Per text: mean log ratio of its most toxic passage, and of the whole text."""
    code, sizes = grams(texts)
    found = np.zeros((len(texts), 2))
    if not len(code):
        return found
    value = ratios[code].astype(np.float64)
    ends = sizes.cumsum()
    starts = ends - sizes
    sums = np.concatenate(([0.0], np.cumsum(value)))
    from_ = np.maximum(np.arange(len(code)) + 1 - PASSAGE, np.repeat(starts, sizes))
    passage = (sums[1:] - sums[from_]) / PASSAGE
    some = sizes > 0
    found[some, 0] = np.maximum.reduceat(passage, starts[some])
    found[:, 1] = (sums[ends] - sums[starts]) / np.maximum(sizes, 1)
    return found


@dataclass
class ToxicityModel:
    ratios: np.ndarray | None
    weights: tuple[float, ...] = (0.0, 0.0)
    intercept: float = 0.0


def _measured(spark: SparkSession, ratios: np.ndarray, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(ratios)

    @F.pandas_udf("passage double, whole double")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [features(shared.value, some) for some in slices(batch, SLICE_CHARS)]
            yield pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, 2)), columns=FEATURES)

    return measure(text)


def fit(labelled: DataFrame, text: str = "text", toxic: str = "toxic", key: str = "doc_id") -> ToxicityModel:
    """A model from ``labelled``, which must hold training rows only. One part in ``CALIBRATION_PARTS`` never enters
    the counts: it fits the regression."""
    spark = labelled.sparkSession
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(CALIBRATION_PARTS))
    # Read once for the models and once for the regression, each its own part: cheaper than a copy of all texts.
    rows = (labelled.select(F.col(text).alias("t"), F.col(toxic).cast("int").alias("y"), part.alias("part"))
            .where("y IN (0, 1)"))
    found = counts(rows.where("part != 0"), "t", "y")
    if not found["ordinary"].sum() or not found["toxic"].sum():
        return ToxicityModel(None)
    ratios = log_ratios(*(found[c].to_numpy() for c in ("code", "ordinary", "toxic")))
    unseen = settled(rows.where("part = 0").select("y", _measured(spark, ratios, F.col("t")).alias("m"))
                     .select(F.col("y").cast("double").alias("label"),
                             array_to_vector(F.array("m.passage", "m.whole")).alias("features")))
    if unseen.select("label").distinct().count() < 2:
        # Too few labelled texts for a regression: a passage twice as likely per symbol is a toxic one.
        return ToxicityModel(ratios, (8.0, 0.0), -8.0 * float(np.log(2)))
    line = LogisticRegression(regParam=1e-4, maxIter=50).fit(unseen)
    return ToxicityModel(ratios, tuple(line.coefficients.toArray().tolist()), float(line.intercept))


def score(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    """A number from 0 to 1, higher for what is likelier toxic."""
    if model.ratios is None:
        return F.lit(0.0)
    measured = _measured(spark, model.ratios, text)
    line = measured["passage"] * model.weights[0] + measured["whole"] * model.weights[1] + model.intercept
    return 1 / (1 + F.exp(-line))

