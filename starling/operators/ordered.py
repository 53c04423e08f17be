"""Figures that depend on the order of values - running totals, quantiles, ROC, AUC, exact splits -
without ever sorting raw rows in one task.

Raw rows are first counted per distinct value. The counts are range-partitioned by value, which Spark balances by
sampling however the values lie, and settled with the number of their part. Totals run inside a part and over the
parts, and the two are added: every sort sees one part, or one row per part, and the totals are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from starling.functions import flag, safe_ratio
from starling.operators.lookups import look_up
from starling.session import settled

SPREAD = 32


def _running(measures: Sequence[str], window, suffix: str) -> dict[str, Column]:
    return {m + suffix: F.coalesce(F.sum(m).over(window), F.lit(0)) for m in measures}


def running_totals(counts: DataFrame, value: str, measures: Sequence[str], by: Sequence[str] = (),
                   descending: bool = False) -> DataFrame:
    """Adds ``<measure>_upto``, the measure summed over all values up to and including this row's, and
    ``<measure>_all``, its sum over the whole group.

    ``counts`` has one row per (``by``, ``value``), none of them NULL.
    """
    by, measures = list(by), list(measures)
    order = F.desc if descending else F.asc
    # Settled with the part's number: a part must hold the same rows for its own totals and for those of others.
    placed = settled(counts.repartitionByRange(*by, order(value)).withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy(*by, "_part").agg(*[F.sum(m).alias(m) for m in measures])
    whole = Window.partitionBy(*by).orderBy("_part")         # one row per part
    starts = parts.select(
        *by, "_part",
        *[c.alias(n) for n, c in _running(measures, whole.rowsBetween(Window.unboundedPreceding, -1), "_p").items()],
        *[c.alias(n) for n, c in _running(measures, whole.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing), "_all").items()])
    inside = placed.withColumns(_running(
        measures, Window.partitionBy(*by, "_part").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0), "_v"))
    return (inside.join(starts, [*by, "_part"])
            .select(*counts.columns, *[(F.col(m + "_v") + F.col(m + "_p")).alias(m + "_upto") for m in measures],
                    *[m + "_all" for m in measures]))


def _per_value(df: DataFrame, value: str, by: Sequence[str], **measures: Column) -> DataFrame:
    return settled(df.where(F.col(value).isNotNull()).groupBy(*by, value)
                   .agg(*[m.alias(name) for name, m in measures.items()]))


# ---------------------------------------------------------------- quantiles and box plots

def _rank(share: float, method: str) -> Column:
    """Zero-based position of a quantile among ``n_all`` ordered values; fractions interpolate."""
    if method == "linear":
        return (F.col("n_all") - 1) * share
    if method == "midpoint":      # each value stands for the middle of its own slot
        return F.greatest(F.lit(0.0), F.least(F.col("n_all") * share - 0.5, F.col("n_all") - 1.0))
    raise ValueError(f"unknown quantile method {method}")


def five_numbers(df: DataFrame, by: str, value: str, method: str = "linear", copies: str | None = None) -> DataFrame:
    """Box-plot figures per group: size, quartiles, whiskers (the furthest values within 1.5 times the
    quartile distance) and the number of values beyond them. Exact for any group size. ``copies`` names a
    column that says how many rows each row stands for."""
    size = F.sum(copies) if copies else F.count(F.lit(1))
    counts = _per_value(df.where(F.col(by).isNotNull()), value, [by], n=size)
    ranked = running_totals(counts, value, ["n"], by=[by])
    # The value at position r is the smallest one whose running count exceeds r.
    cuts = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    picks, quartiles = [F.max("n_all").alias("n_all")], {}
    for name, cut in cuts.items():
        rank = _rank(cut, method)
        for side, position in (("below", F.floor(rank)), ("above", F.ceil(rank))):
            picks.append(F.min(F.when(F.col("n_upto") > position, F.col(value))).alias(f"_{name}_{side}"))
        part, start = rank - F.floor(rank), F.col(f"_{name}_below")
        quartiles[name] = start + part * (F.col(f"_{name}_above") - start)
    boxes = (ranked.groupBy(by).agg(*picks)
             .select(F.col(by).alias("_group"), *[q.alias(name) for name, q in quartiles.items()]))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    # Few groups, many values each: the boxes are copied so that a group's values spread over tasks.
    return (look_up(counts, boxes, by, "_group", spread_by=value, salts=SPREAD)
            .groupBy(by, *cuts)
            .agg(F.sum("n").alias("n"),
                 F.min(F.when(inside, F.col(value))).alias("_low"),
                 F.max(F.when(inside, F.col(value))).alias("_high"),
                 F.sum(F.when(~inside, F.col("n")).otherwise(0)).alias("n_outliers"))
            .select(by, "n", *cuts, F.least("_low", "q1").alias("low_whisker"),
                    F.greatest("_high", "q3").alias("high_whisker"), "n_outliers"))


# ---------------------------------------------------------------- ROC and AUC

def _score_counts(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    bad = F.col(label).cast("long")
    return _per_value(df.where(bad.isNotNull()), score, by, pos=F.sum(bad), neg=F.sum(1 - bad),
                      step=F.max(F.lit(1).cast("long")))


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group, or in one row: the chance that a bad order scores above a good one, ties counting half.
    NULL with one class."""
    counts = running_totals(_score_counts(df, label, score, by), score, ["neg"], by=by)
    wins = F.col("pos") * ((F.col("neg_upto") - F.col("neg")) + F.col("neg") / 2)
    return (counts.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
                                    F.sum(wins).alias("_wins"))
            .select(*by, "n_pos", "n_neg",
                    safe_ratio(F.col("_wins"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc")))


def roc_curve(df: DataFrame, label: str, score: str, corners_only: bool = False, numbered: bool = False) -> DataFrame:
    """One point per distinct score, from (0, 0) with a NULL threshold to (1, 1).

    ``corners_only`` leaves out inner points on a straight piece: those whose step equals the next one's.
    ``numbered`` adds the place of each point on the whole curve.
    """
    counts = _score_counts(df, label, score)
    points = running_totals(counts, score, ["pos", "neg", "step"], descending=True)
    if corners_only:
        following = points.select((F.col("step_upto") - 1).alias("step_upto"),
                                  F.col("pos").alias("_pos"), F.col("neg").alias("_neg"))
        straight = (F.col("pos") == F.col("_pos")) & (F.col("neg") == F.col("_neg"))
        points = points.join(following, "step_upto", "left").where(~F.coalesce(straight, F.lit(False)))
    curve = points.select(
        F.col(score).alias("threshold"), safe_ratio(F.col("neg_upto"), F.col("neg_all")).alias("fpr"),
        safe_ratio(F.col("pos_upto"), F.col("pos_all")).alias("tpr"), F.col("step_upto").alias("point"))
    start = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
                                            F.lit(0.0).alias("tpr"), F.lit(0).cast("long").alias("point"))
    whole = start.unionByName(curve)
    return whole if numbered else whole.drop("point")


def curve_facts(points: DataFrame) -> DataFrame:
    """One row on a numbered whole curve: its ends, whether it ever falls, and the area under it."""
    before = points.select((F.col("point") + 1).alias("point"), F.col("fpr").alias("_fpr"), F.col("tpr").alias("_tpr"))
    steps = points.join(before, "point", "left")
    width, height = F.col("fpr") - F.col("_fpr"), (F.col("tpr") + F.col("_tpr")) / 2
    return steps.agg(
        F.min(F.struct("point", "fpr", "tpr")).alias("first"), F.max(F.struct("point", "fpr", "tpr")).alias("last"),
        (F.count_if((width < 0) | (F.col("tpr") < F.col("_tpr"))) == 0).alias("never_falls"),
        F.sum(width * height).alias("area")).select("first.fpr", "first.tpr", F.col("last.fpr").alias("last_fpr"),
                                                     F.col("last.tpr").alias("last_tpr"), "never_falls", "area")


# ---------------------------------------------------------------- splits and samples

def row_hash(key: str, seed: int, digits: int = 8) -> Column:
    """A number from the first hex digits of a hash of key and seed: the same on every run and layout."""
    text = F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def hash_split(df: DataFrame, key: str, seed: int = 42, parts: int = 5) -> DataFrame:
    """Adds ``is_test`` to one row in ``parts``, chosen by the key alone: no shuffle, no pass over the data."""
    return df.withColumn("is_test", flag(F.pmod(row_hash(key, seed), F.lit(parts)) == 0))


def stratified_split(df: DataFrame, key: str, label: str, seed: int = 42, test_share: float = 0.2) -> DataFrame:
    """Adds ``is_test`` to exactly ``round(test_share * n)`` rows of every class (halves to even), those
    with the smallest hashes.

    Rows are neither moved nor sorted. The cut-off hash of each class is narrowed down by counting: over the
    leading 12 of 60 bits, then over the next 12 inside the range found, then over the few hashes left there.
    That takes three passes over ``df``, so settle it first if it is dear; one row per class comes back.
    """
    hashed = df.withColumn("_hash", row_hash(key, seed, digits=15))
    inside, found = hashed.where(F.col(label).isNotNull()), {}
    for bits_left in (48, 36, 0):
        cell = F.shiftright("_hash", bits_left)
        counts = inside.groupBy(label, cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        whole, ordered = Window.partitionBy(label), Window.partitionBy(label).orderBy("cell")
        left = _by_class(label, {c: F.lit(at["left"]) for c, at in found.items()})
        wanted = left if found else F.bround(F.sum("n").over(whole) * test_share).cast("long")
        before = F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        hit = (counts.withColumns({"wanted": wanted, "before": before})
               .where((F.col("before") < F.col("wanted")) & (F.col("before") + F.col("n") >= F.col("wanted"))))
        found = {row[label]: {"cell": row["cell"], "left": row["wanted"] - row["before"]}
                 for row in hit.collect()}
        inside = inside.where(cell == _by_class(label, {c: F.lit(at["cell"]) for c, at in found.items()}))
    cut = _by_class(label, {c: F.lit(at["cell"]) for c, at in found.items()})
    return hashed.withColumn("is_test", F.coalesce(flag(F.col("_hash") <= cut), F.lit(0))).drop("_hash")


def _by_class(label: str, values: dict) -> Column:
    """The value given for the row's class, NULL for a class that has none."""
    picked = F.when(F.lit(False), F.lit(None).cast("long"))
    for name, value in values.items():
        picked = picked.when(F.col(label) == F.lit(name), value)
    return picked


def sample_by_hash(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, or all if fewer, those with the smallest hashes of their keys; rows of one key in the order of a hash
    of the whole row. Only keys and hashes are ranked: the rows up to the last are picked out where they lie, and
    of those that tie with it the few that exceed ``n`` are left out."""
    hashed = df.withColumns({"_key_hash": row_hash(key, seed, digits=15), "_row_hash": F.xxhash64(*df.columns)})
    last = hashed.select("_key_hash", "_row_hash").orderBy("_key_hash", "_row_hash").limit(n).agg(
        F.max(F.struct("_key_hash", "_row_hash")).alias("m")).first()["m"]
    if last is None:
        return df.limit(0)
    place = F.struct("_key_hash", "_row_hash")
    end = F.struct(F.lit(last["_key_hash"]).alias("_key_hash"), F.lit(last["_row_hash"]).alias("_row_hash"))
    return hashed.where(place <= end).orderBy("_key_hash", "_row_hash").limit(n).drop("_key_hash", "_row_hash")
