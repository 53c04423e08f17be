from datetime import datetime

from pyspark.sql import functions as F

from starling.functions import (
    bin_number, clip, half_even, month_of, name_of, risk_tier, safe_ratio, significance_text, whole_days,
)
from starling.plans.master import DELAY_EDGES, DELAY_NAMES


def one(spark, values, kind, made):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.select("i", made(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_days_round_down(spark):
    pairs = [(datetime(2018, 1, 2), datetime(2018, 1, 1, 15)), (datetime(2018, 1, 2), datetime(2018, 1, 2, 9)),
             (datetime(2018, 1, 2), datetime(2018, 1, 1)), (datetime(2018, 1, 2), datetime(2018, 1, 9)),
             (datetime(2018, 1, 2), datetime(2018, 1, 8, 23, 59, 59, 999999)), (datetime(2018, 1, 2), None)]
    df = spark.createDataFrame(pairs, "due timestamp_ntz, came timestamp_ntz")
    assert [r[0] for r in df.select(whole_days("due", "came")).collect()] == [-1, 0, -1, 7, 6, None]


def test_days_ignore_the_session_zone(spark, settings):
    settings(spark__sql__session__timeZone="America/Sao_Paulo")      # clocks went forward on 4 November 2018
    pairs = [(datetime(2018, 11, 3, 12), datetime(2018, 11, 4, 12)), (datetime(2018, 11, 4, 12), datetime(2018, 11, 3, 12)),
             (datetime(2018, 11, 3, 12), datetime(2018, 11, 4, 11, 59, 59, 999999))]
    df = spark.createDataFrame(pairs, "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(whole_days("a", "b")).collect()] == [1, -1, 0]


def test_bin_edges_close_on_the_right(spark):
    delays = [-101, -100, -99, -7, -6, -1, 0, 1, 7, 8, 100, 101, None]
    expected = [None, None, 0, 0, 1, 1, 2, 3, 3, 4, 4, None, None]
    assert one(spark, delays, "long", lambda x: bin_number(x, DELAY_EDGES)) == expected
    names = one(spark, delays, "long", lambda x: name_of(bin_number(x, DELAY_EDGES), DELAY_NAMES))
    assert names == [None if n is None else DELAY_NAMES[n] for n in expected]


def test_halves_go_to_even(spark):
    assert one(spark, [2.5, 1.5, 3.5, 0.5, 2.4999, None], "double", half_even) == [2, 2, 4, 0, 2, None]


def test_ratio_of_zero_is_missing(spark):
    assert one(spark, [0.0, 2.0, None], "double", lambda x: safe_ratio(F.lit(5.0), x)) == [None, 2.5, None]


def test_clip_keeps_missing(spark):
    assert one(spark, [45, -45, 3, None], "int", lambda x: clip(x, -30, 30)) == [30, -30, 3, None]


def test_month_ignores_the_session_zone(spark, settings):
    settings(spark__sql__session__timeZone="America/Sao_Paulo")
    df = spark.createDataFrame([(datetime(2018, 11, 30, 23, 59),), (datetime(2018, 11, 4, 0, 30),)],
                               "t timestamp_ntz")
    assert [r[0] for r in df.select(month_of("t")).collect()] == [datetime(2018, 11, 1)] * 2


def test_tiers_are_strict(spark):
    assert one(spark, [0.5, 0.50001, 0.3, 0.30001, None], "double", risk_tier) == [
        "Elevated risk", "Likely bad review", "Low risk", "Elevated risk", None]


def test_significance_words(spark):
    assert one(spark, [0.0, 0.0012, 0.0123, 0.05, None], "double", significance_text) == [
        "p < 0.001 (extremely significant)", "p = 0.0012 (highly significant)", "p = 0.0123 (significant)",
        "p = 0.0500 (NOT significant)", None]
