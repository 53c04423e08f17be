import pytest
from pyspark.sql import functions as F

from starling.operators import membership, rates


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bits", [1 << 27, 1 << 16, 1 << 15])
def test_map_leaves_out_only_what_is_not_there(spark, bits):
    rows = spark.range(3000).select("id", (F.col("id") * 7).alias("x"), F.lit("kept").alias("other"))
    wanted = rows.where("id % 10 = 3").select("id", "x")
    inside = {r["id"] for r in membership.maybe_in(rows, wanted, "id", "x", bits=bits).collect()}
    outside = {r["id"] for r in membership.maybe_in(rows, wanted, "id", "x", bits=bits, inside=False).collect()}
    assert inside | outside == set(range(3000)) and not inside & outside
    assert inside >= set(range(3, 3000, 10)) and len(inside) < 300 * (1.01 if bits > 1 << 20 else 1.2)
    assert membership.maybe_in(rows, wanted.limit(0), "id", "x", bits=bits).count() == 0
    assert membership.maybe_in(rows, wanted, "id", "x").columns == rows.columns


def test_lists_of_every_kind_give_the_same(spark):
    rows = spark.createDataFrame([(i, f"v{i % 50}" if i % 7 else None) for i in range(500)], "k int, v string")
    few = [f"v{i}" for i in range(0, 50, 3)]
    many = few + [f"x{i}" for i in range(5000)] + [None]
    table = spark.createDataFrame([(v,) for v in many + few], "anything string")
    expected = sorted(r["k"] for r in rows.where(F.col("v").isin(few)).collect())
    for values in (few, many, table):
        found = rates.keep_listed(rows, v=values)
        assert found.columns == ["k", "v"] and sorted(r["k"] for r in found.collect()) == expected
    assert rates.keep_listed(rows, v=[]).count() == 500
    assert rates.keep_listed(rows, v=table.limit(0)).count() == 0
    assert rates.keep_listed(rows, v=few, k=list(range(2000))).count() == len(expected)


def test_a_million_values(spark, settings, tmp_path):
    spark.range(0, 3_000_000, 1).select(F.col("id").alias("k"), (F.col("id") % 9).alias("x")).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    listed = spark.range(0, 3_000_000, 3).select((F.col("id") * 2).alias("value"))          # half of them beyond the rows
    found = membership.in_table(rows, "k", listed)
    assert found.agg(F.count("*"), F.sum("k")).first()[:] == (500_000, sum(range(0, 3_000_000, 6)))
    settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false")
    text = plan(membership.in_table(rows, "k", listed))
    # The map is looked up below the shuffle of the rows, by a broadcast of fixed size.
    assert "BroadcastHashJoin" in text[text.index("Exchange hashpartitioning(k"):] and "LeftSemi" in text
    kept = membership.maybe_in(rows, listed.select(F.col("value").alias("k")), "k").count()
    assert 500_000 <= kept < 530_000
