import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import compare


@pytest.fixture(scope="module")
def con():
    return compare.tables()


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, compare.FOLDER)
    sql = entry.oracle_sql()[name]
    assert compare.spark_result(df) == compare.sql_result(con, sql)
    assert compare.kinds(df, con, sql) == {}


def test_known_figures(spark):
    master = entry._master(spark, compare.FOLDER)
    row = master.agg(F.count("*"), F.count_distinct("order_id"), F.count("seller_state"), F.sum("n_items"),
                     F.min("delivery_delay_days"), F.max("delivery_delay_days")).first()
    assert tuple(row) == (6442, 6442, 6189, 29047, -20, 20)
    buckets = [(r.delivery_bucket, r.n_orders, r.bad_rate)
               for r in entry.bad_rate_by_delivery_bucket(spark, compare.FOLDER).collect()]
    assert buckets == [("7+ days early", 2187, 0.369456), ("1-7 days early", 946, 0.381607),
                       ("on time", 156, 0.461538), ("1-7 days late", 1071, 0.85901),
                       ("7+ days late", 2082, 0.872238)]
    assert entry.late_effect_ztest(spark, compare.FOLDER).first().z == 40.48481
    assert round(entry.late_effect_pvalue(spark, compare.FOLDER).first().chi2, 6) == 1639.019841
    assert entry.train_test_split(spark, compare.FOLDER).agg(F.sum("is_test")).first()[0] == 2948
    top = entry.worst_categories(spark, compare.FOLDER).collect()[:3]
    assert [(r[0], r.n_orders, r.bad_rate) for r in top] == [
        ("brand#25", 305, 0.64918), ("brand#2", 349, 0.644699), ("brand#7", 264, 0.643939)]


def test_flagship(spark):
    assert entry.entry(spark).count() == 5


def test_stored_results_follow_their_files(spark, tmp_path):
    """A replaced file makes a new result, and the old one goes; another folder's stays."""
    made = []
    def write(path):
        made.append(path)
        spark.range(len(made)).write.parquet(f"{path}/rows")
    for folder in ("a", "b"):
        spark.range(3).write.parquet(str(tmp_path / folder / "orders.parquet"))
    def stored(folder):
        return entry._stored(spark, str(tmp_path / folder), "kept", ["orders"], write)
    first, other = stored("a"), stored("b")
    assert stored("a") == first and len(made) == 2
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "a" / "orders.parquet"))
    second = stored("a")
    assert second != first and spark.read.parquet(second + "/rows").count() == 3
    from pathlib import Path
    assert not Path(first).exists() and Path(other).exists()
