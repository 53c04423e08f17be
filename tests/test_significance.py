import math

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F

from starling.operators.evaluation import confusion_matrix, precision_recall
from starling.operators.significance import late_effect, late_effect_p, two_sided_p


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "delivery_delay_days long, is_bad_review int")


def test_z_squared_is_chi_square(spark):
    rows = [(-5, 1)] * 12 + [(0, 0)] * 88 + [(3, 1)] * 30 + [(9, 0)] * 40 + [(None, 1)] * 9
    df = outcomes(spark, rows)
    row = late_effect(df).first()
    assert (row.n_ontime, row.bad_ontime, row.n_late, row.bad_late) == (100, 12, 70, 30)
    pooled = 42 / 170
    z = (30 / 70 - 0.12) / math.sqrt(pooled * (1 - pooled) * (1 / 100 + 1 / 70))
    assert row.z == pytest.approx(z) and row.difference_pp == pytest.approx((30 / 70 - 0.12) * 100)
    tested = late_effect_p(df).first()
    assert tested.chi2 == pytest.approx(z * z)
    assert tested.p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=2e-7)
    assert tested.verdict == "p < 0.001 (extremely significant)"
    # The built-in test of the same table, as a cross-check.
    rows = VectorAssembler(inputCols=["late"], outputCol="features").transform(df.where(
        "delivery_delay_days IS NOT NULL").selectExpr("double(delivery_delay_days > 0) AS late", "double(is_bad_review) AS y"))
    built_in = ChiSquareTest.test(rows, "features", "y").first()
    assert tested.chi2 == pytest.approx(built_in.statistics[0]) and tested.p_value == pytest.approx(built_in.pValues[0], rel=1e-6)


@pytest.mark.parametrize("z", [0.0, 0.3, -1.0, 1.96, 2.5, -3.3, 6.0, 12.0, 45.0])
def test_p_over_its_range(spark, z):
    p = spark.range(1).select(two_sided_p(F.lit(z))).first()[0]
    assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=2e-7, abs=1e-300)


def test_all_verdicts_by_group(spark):
    """Groups whose late orders do worse by more and more."""
    rows = [(g, delay, int(i < bad)) for g, late_bad in (("none", 50), ("some", 65), ("more", 70), ("most", 80))
            for delay, bad in ((-1, 50), (1, late_bad)) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, delivery_delay_days long, is_bad_review int")
    verdicts = {r.g: r.verdict for r in late_effect_p(df, ["g"]).collect()}
    assert verdicts["none"] == "p = 1.0000 (NOT significant)" and verdicts["most"].startswith("p < 0.001")
    assert verdicts["some"].endswith("(significant)") and verdicts["more"].endswith("(highly significant)")
    assert {r.g: r.n_late for r in late_effect(df, ["g"]).collect()} == dict.fromkeys(("none", "some", "more", "most"), 100)


@pytest.mark.parametrize("rows", [[(-1, 0), (2, 0), (3, 0)], [(1, 0), (2, 1)], [(-1, 0), (-2, 1)]])
def test_no_contrast_gives_no_z(spark, rows):
    df = outcomes(spark, rows)
    assert late_effect(df).first().z is None
    assert tuple(late_effect_p(df).first()) == (None, None, None)


def test_z_of_nothing(spark):
    row = late_effect(outcomes(spark, [])).first()
    assert (row.n_ontime, row.bad_late, row.z, row.pooled_rate) == (0, 0, None, None)


def test_threshold_counts_as_bad_and_empty_cells_are_zero(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.2), (0, 0.1)], "y int, p double")
    found = {(r.actual, r.predicted): r.n for r in confusion_matrix(df, "y", "p").collect()}
    assert found == {(0, 0): 1, (0, 1): 0, (1, 0): 1, (1, 1): 1}
    row = precision_recall(df, "y", "p").first()
    assert (row.precision, row.recall) == (1.0, 0.5)


def test_nothing_flagged_gives_zero_precision(spark):
    row = precision_recall(spark.createDataFrame([(0, 0.1)], "y int, p double"), "y", "p").first()
    assert (row.precision, row.recall) == (0.0, 0.0)
