import random

import pytest
from pyspark.sql import functions as F

from starling.operators import ordered, summaries


@pytest.fixture(scope="module")
def scored(spark):
    pick = random.Random(5)
    rows = []
    for i in range(4000):
        bad = int(pick.random() < 0.3)
        score = round(min(1.0, max(0.0, pick.gauss(0.6 if bad else 0.4, 0.2))), 3)
        rows.append((bad if i % 50 else None, score if i % 70 else None, f"m{i % 3}", float("nan") if i % 99 == 0 else score))
    return spark.createDataFrame(rows, "bad int, score double, month string, odd double").cache()


@pytest.mark.parametrize("bins", [1, 7, 100, 10_000])
def test_auc_is_within_its_bound(scored, bins):
    exact = ordered.auc(scored, "bad", "score").first()
    found = summaries.binned_auc(summaries.score_histogram(scored, "bad", "score", bins=bins)).first()
    assert (found.n_pos, found.n_neg) == (exact.n_pos, exact.n_neg)
    assert abs(found.auc - exact.auc) <= found.error_bound + 1e-12
    assert found.error_bound <= 0.5 and (bins < 10_000 or abs(found.auc - exact.auc) < 1e-12)


def test_histograms_add_up(scored):
    whole = summaries.score_histogram(scored, "bad", "score", bins=64)
    monthly = summaries.score_histogram(scored, "bad", "score", by=["month"], bins=64)
    parts = [summaries.score_histogram(scored.where(F.col("month") == m), "bad", "score", bins=64) for m in ("m0", "m1", "m2")]
    expected = sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, summaries.merge_histograms([monthly]).collect())) == expected
    assert sorted(map(tuple, summaries.merge_histograms(parts).collect())) == expected
    assert whole.count() <= 64
    by_month = {r.month: r.auc for r in summaries.binned_auc(monthly, by=["month"]).collect()}
    for part, m in zip(parts, ("m0", "m1", "m2")):
        assert by_month[m] == pytest.approx(summaries.binned_auc(part).first().auc)


def test_roc_points_lie_on_the_exact_curve(scored):
    histogram = summaries.score_histogram(scored, "bad", "score", bins=20)
    found = sorted((r.fpr, r.tpr) for r in summaries.binned_roc(histogram, bins=20).collect())
    assert len(found) <= 21 and found[0] == (0, 0) and found[-1] == (1, 1)
    exact = {(round(r.fpr, 9), round(r.tpr, 9)) for r in ordered.roc_curve(scored, "bad", "score").collect()}
    assert all((round(x, 9), round(y, 9)) in exact for x, y in found)


def test_odd_scores(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.7), (0, -3.0), (0, 0.0), (0, None), (None, 0.5), (1, float("nan"))],
                               "bad int, score double")
    rows = {r.bin: (r.pos, r.neg) for r in summaries.score_histogram(df, "bad", "score", bins=10).collect()}
    assert rows == {9: (2, 0), 0: (0, 2)}
    one = summaries.binned_auc(summaries.score_histogram(df.where("bad = 1"), "bad", "score")).first()
    assert one.auc is None and one.error_bound is None
    for bins in (0, summaries.BINS + 1):
        with pytest.raises(ValueError):
            summaries.score_histogram(df, "bad", "score", bins=bins)


def rank_span(values, q):
    return sum(v < q for v in values) / len(values), sum(v <= q for v in values) / len(values)


@pytest.mark.parametrize("size", [64, 1024])
def test_sketched_quartiles_are_within_the_stated_rank(spark, size):
    pick = random.Random(8)
    # A star with nine of ten rows, and a crowded value in it.
    rows = [(5 if pick.random() < 0.9 else pick.randint(1, 4), round(pick.gauss(0, 1), 2) if pick.random() < 0.7 else 0.0)
            for _ in range(30_000)]
    df = spark.createDataFrame(rows + [(5, None), (5, float("nan")), (None, 1.0)], "star int, mood double").repartition(9)
    merged = summaries.merge_sketches(summaries.quantile_sketches(
        df.withColumn("part", F.spark_partition_id()), ["star", "part"], "mood", size), ["star"])
    allowed = 2 * summaries.rank_error(size)              # twice the error of 99 cases in a hundred
    found = {r.star: r for r in summaries.quartiles(merged).collect()}
    for star in range(1, 6):
        values = [m for s, m in rows if s == star]
        assert found[star].n == len(values)
        for share, q in ((0.25, found[star].q1), (0.5, found[star].median), (0.75, found[star].q3)):
            low, high = rank_span(values, q)
            assert low - allowed <= share <= high + allowed


def test_boxes_of_sketches(spark):
    rows = [(i % 2, float(i % 101)) for i in range(2020)] + [(0, 900.0), (1, -900.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "star int, mood double")
    sketches = summaries.quantile_sketches(df.where("star IS NOT NULL"), ["star"], "mood", 4096)
    exact = {r.star: r for r in ordered.five_numbers(df, "star", "mood").collect()}
    for r in summaries.five_numbers_from(sketches, df, "star", "mood").collect():
        whole = exact[r.star]
        assert (r.n, r.low_whisker, r.high_whisker, r.n_outliers) == (whole.n, whole.low_whisker, whole.high_whisker, 1)
        assert [r.q1, r.median, r.q3] == pytest.approx([whole.q1, whole.median, whole.q3], abs=1)


def test_one_pass_without_sort(spark):
    df = spark.range(100).select((F.col("id") % 5).alias("star"), F.col("id").cast("double").alias("mood"))
    plan = summaries.quantile_sketches(df, ["star"], "mood")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan and "partial_kll" in plan
