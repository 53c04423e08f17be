import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from starling.operators.ordered import (
    auc, curve_facts, five_numbers, hash_split, roc_curve, running_totals, sample_by_hash, stratified_split,
)


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, score double")


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("parts", [1, 3, 40])
def test_running_totals_match_a_plain_sum(spark, settings, descending, parts):
    settings(spark__sql__shuffle__partitions=str(parts), spark__sql__adaptive__coalescePartitions__enabled="false")
    rng = random.Random(parts)
    # Crowded, spread, negative and out-of-range values.
    values = {round(rng.choice([rng.random(), rng.gauss(0.5, 0.001), rng.uniform(-3, 3)]), 9) for _ in range(300)}
    rows = [(g, v, rng.randrange(9)) for g in "ab" for v in values]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    found = {(r.g, r.v): (r.n_upto, r.n_all)
             for r in running_totals(df, "v", ["n"], by=["g"], descending=descending).collect()}
    assert len(found) == len(rows)
    for group in "ab":
        upto, total = 0, sum(n for g, _, n in rows if g == group)
        for _, v, n in sorted((r for r in rows if r[0] == group), key=lambda r: r[1], reverse=descending):
            upto += n
            assert found[(group, v)] == (upto, total)


def test_crowded_values_are_spread_over_parts(spark, settings):
    """200,000 distinct values within 1e-9: no part holds more than a few times its share."""
    settings(spark__sql__shuffle__partitions="20", spark__sql__adaptive__coalescePartitions__enabled="false")
    df = spark.range(200_000).select((0.5 + F.col("id") * 5e-15).alias("v"), F.lit(1).cast("long").alias("n"))
    n = df.select("v").distinct().count()
    found = running_totals(df.groupBy("v").agg(F.sum("n").alias("n")), "v", ["n"])
    assert found.agg(F.max("n_upto"), F.min("n_all")).first() == (200_000, 200_000)
    placed = df.repartitionByRange(F.asc("v")).groupBy(F.spark_partition_id().alias("p")).count()
    assert placed.agg(F.max("count")).first()[0] < 4 * 200_000 / 20 and n > 10_000


def test_facts_of_a_curve(spark):
    df = scored(spark, [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)])
    row = curve_facts(roc_curve(df, "label", "score", numbered=True)).first()
    assert tuple(row) == (0.0, 0.0, 1.0, 1.0, True, 0.625)


@pytest.mark.parametrize("method, numpy_method", [("linear", "linear"), ("midpoint", "hazen")])
def test_quartiles_match_numpy(spark, method, numpy_method):
    rng = random.Random(3)
    groups = {1: [round(rng.uniform(-1, 1), 3) for _ in range(101)], 2: [0.0] * 50 + [0.9], 3: [0.25],
              4: [-1.0, 1.0], 5: [round(rng.gauss(0, 0.1), 2) for _ in range(400)]}
    df = spark.createDataFrame([(s, v) for s, vs in groups.items() for v in vs] + [(None, 0.1), (1, None)],
                               "star int, mood double")
    found = {r.star: r for r in five_numbers(df, "star", "mood", method).collect()}
    assert sorted(found) == [1, 2, 3, 4, 5]
    for star, values in groups.items():
        q1, median, q3 = np.quantile(values, [0.25, 0.5, 0.75], method=numpy_method)
        row, reach = found[star], 1.5 * (q3 - q1)
        assert (row.q1, row.median, row.q3) == pytest.approx((q1, median, q3), abs=1e-12)
        inside = [v for v in values if q1 - reach <= v <= q3 + reach]
        assert row.n == len(values) and row.n_outliers == len(values) - len(inside)
        assert row.low_whisker == pytest.approx(min([q1, *inside]))
        assert row.high_whisker == pytest.approx(max([q3, *inside]))


def test_one_hot_group_gives_the_same_box(spark):
    """A third of all rows in one star and one value."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 5).cast("int").alias("star"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise((F.col("id") % 2001 - 1000) / 1000.0).alias("mood"))
    rows = df.collect()
    for r in five_numbers(df, "star", "mood").collect():
        values = [x.mood for x in rows if x.star == r.star]
        assert r.n == len(values)
        assert [r.q1, r.q3] == pytest.approx(list(np.quantile(values, [0.25, 0.75])))


def test_equal_scores_share_a_point_and_count_half(spark):
    df = scored(spark, [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1), (None, 0.2), (1, None)])
    points = sorted(((r.fpr, r.tpr) for r in roc_curve(df, "label", "score").collect()))
    assert points == [(0.0, 0.0), (0.5, 0.5), (0.5, 1.0), (1.0, 1.0)]
    row = auc(df, "label", "score").first()
    assert (row.n_pos, row.n_neg, row.auc) == (2, 2, 0.625)


def test_one_class_has_no_auc(spark):
    assert auc(scored(spark, [(0, 0.2), (0, 0.7)]), "label", "score").first().auc is None


def test_auc_and_roc_match_the_built_in_evaluator(spark):
    rng = random.Random(8)
    rows = [(int(rng.random() < s), round(s, 2)) for s in (rng.random() for _ in range(3000))]
    df = scored(spark, rows)
    built_in = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    assert auc(df, "label", "score").first().auc == pytest.approx(built_in.evaluate(df), abs=1e-12)
    points = sorted((r.fpr, r.tpr) for r in roc_curve(df, "label", "score").collect())
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0)
    assert [t for _, t in points] == sorted(t for _, t in points)
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert area == pytest.approx(built_in.evaluate(df), abs=1e-12)


def test_corners_leave_out_equal_steps(spark):
    df = scored(spark, [(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (0, 0.5), (1, 0.4)])
    found = sorted((r.fpr, r.tpr) for r in roc_curve(df, "label", "score", corners_only=True).collect())
    assert found == [(0.0, 0.0), (0.0, 0.75), (1.0, 0.75), (1.0, 1.0)]


def test_stratified_split_is_exact_and_stable(spark):
    df = spark.range(5003).select(F.col("id").alias("k"), F.when(F.col("id") % 7 == 0, 1).otherwise(0).alias("y"))
    one = {r.k: r.is_test for r in stratified_split(df, "k", "y").collect()}
    other = {r.k: r.is_test for r in stratified_split(df.repartition(11), "k", "y").collect()}
    assert one == other and len(one) == 5003
    for label in (0, 1):
        sizes = [one[k] for k in one if (k % 7 == 0) == bool(label)]
        assert sum(sizes) == round(0.2 * len(sizes))
    assert one != {r.k: r.is_test for r in stratified_split(df, "k", "y", seed=7).collect()}


def test_stratified_split_of_a_tiny_class(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (5, None)], "k long, y int")
    found = stratified_split(df, "k", "y").collect()
    assert len(found) == 5 and sum(r.is_test for r in found if r.y == 0) == 1
    assert all(r.is_test == 0 for r in found if r.y != 0)


def test_hash_split_and_sample(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert 150 < hash_split(df, "k").where("is_test = 1").count() < 250
    once = {r.k for r in sample_by_hash(df, "k", 100).collect()}
    assert len(once) == 100 and once == {r.k for r in sample_by_hash(df.repartition(9), "k", 100).collect()}
    assert sample_by_hash(df, "k", 5000).count() == 1000


def test_sample_has_n_rows_though_keys_repeat(spark):
    df = spark.range(300).select((F.col("id") % 60).alias("k"), F.col("id").alias("own"))
    once = sorted(map(tuple, sample_by_hash(df, "k", 23).collect()))
    assert len(once) == 23 and once == sorted(map(tuple, sample_by_hash(df.repartition(5), "k", 23).collect()))
    copies = spark.range(40).select(F.lit(1).alias("k"))
    assert sample_by_hash(copies, "k", 25).count() == 25 and sample_by_hash(copies.limit(0), "k", 5).count() == 0
