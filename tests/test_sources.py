import json
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from starling.plans.master import order_master
from starling.sources.tables import (
    CSV_COLUMNS, ORDER_MOMENTS, csv_tables, parquet_tables, parse_moments, read_csv, region_codes, write_tables,
)

HEAD = "order_id,customer_id,order_status," + ",".join(ORDER_MOMENTS)
FILES = {
    "orders": HEAD + "\no1,c1,delivered,2018-01-01 10:00:00,,,2018-01-09 09:00:00,2018-01-08 00:00:00\n"
                     "o2,c2,delivered,2018-01-01 10:00:00,,,,2018-01-08 00:00:00\n",
    "items": "freight_value,order_id,order_item_id,product_id,seller_id,price\n2.5,o1,1,p1,s1,NA\n1.5,o1,2,p1,s1,8.0\n",
    "reviews": 'review_id,order_id,review_score,review_comment_message\n'
               'r1,o1,2,"said ""no"",\nthen, left"\nr2,o2,5,null\nr3,o2,4,""\n',
    "products": "product_id,product_category_name\np1,costrução\np2,N/A\n",
    "translation": "﻿product_category_name,product_category_name_english\r\ncostrução,costruction_tools\r\n"
                   "musica,music",
    "sellers": "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,01001,sao paulo,SP\n",
}


@pytest.fixture
def paths(tmp_path):
    for name, text in FILES.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode("utf-8"))
    return {name: str(tmp_path / f"{name}.csv") for name in FILES}


def test_csv_to_mart_and_back(spark, paths, tmp_path):
    tables = csv_tables(spark, paths)
    assert [r.review_comment_message for r in tables.reviews.orderBy("review_id").collect()] == [
        'said "no",\nthen, left', None, None]
    assert [tuple(r) for r in tables.translation.collect()] == [("costrução", "costruction_tools"),
                                                                ("musica", "music")]
    assert [r.product_category_name for r in tables.products.orderBy("product_id").collect()] == ["costrução", None]
    row = order_master(tables).first()
    assert (row.order_id, row.total_price, row.n_items, row.delivery_time_days, row.delivery_delay_days,
            row.is_bad_review, row.seller_state) == ("o1", 8.0, 2, 7, 1, 1, "SP")
    write_tables(tables, str(tmp_path / "landed"))
    landed = parquet_tables(spark, str(tmp_path / "landed"))
    assert order_master(landed).select("order_id", "delivery_bucket").collect() == [("o1", "1-7 days late")]


def test_columns_go_by_name(spark, paths):
    row = csv_tables(spark, paths).items.orderBy("order_item_id").first()
    assert (row.price, row.freight_value, row.product_id) == (None, 2.5, "p1")
    with pytest.raises(ValueError, match="order_item_id"):
        read_csv(spark, paths["sellers"], CSV_COLUMNS["items"])


def test_bad_moment_stops_or_is_listed(spark):
    moments = {c: "2018-01-01 00:00:00" for c in ORDER_MOMENTS} | {ORDER_MOMENTS[0]: "not a date"}
    df = spark.createDataFrame([tuple(moments.values())], ", ".join(f"{c} string" for c in ORDER_MOMENTS))
    with pytest.raises(PySparkException, match="CAST_INVALID_INPUT"):
        parse_moments(df).collect()
    row = parse_moments(df, strict=False).first()
    assert row.bad_moments == [ORDER_MOMENTS[0]] and row[ORDER_MOMENTS[0]] is None
    assert row[ORDER_MOMENTS[1]] == datetime(2018, 1, 1)


def test_region_codes(spark, tmp_path):
    features = [{"type": "Feature", "properties": {"sigla": s}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
                for s in ("SP", "RJ")]
    (tmp_path / "regions.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    assert [r.seller_state for r in region_codes(spark, str(tmp_path / "regions.geojson")).collect()] == ["SP", "RJ"]


def write(path, **files):
    path.mkdir()
    for name, text in files.items():
        (path / f"{name}.csv").write_text(text)
    return str(path)


def test_a_differing_header_stops_the_job(spark, tmp_path):
    head = "order_id,order_item_id,product_id,seller_id,price,freight_value"
    swapped = "order_id,order_item_id,product_id,seller_id,freight_value,price"
    folder = write(tmp_path / "items", a=f"{head}\no1,1,p,s,99.0,1.0\n", b=f"{swapped}\no2,1,p,s,1.0,99.0\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        read_csv(spark, folder, CSV_COLUMNS["items"]).collect()


def test_bad_numbers_and_short_rows_stop_or_are_listed(spark, tmp_path):
    head = "order_id,order_item_id,product_id,seller_id,price,freight_value\n"
    good, bad = "o1,1,p,s,9.0,NA\n", ("o2,x2,p,s,9.0,1.0\n", "o3,1,p,s,abc,1.0\n", "o4,1,p\n")
    assert read_csv(spark, write(tmp_path / "good", a=head + good), CSV_COLUMNS["items"]).first().price == 9.0
    for i, line in enumerate(bad):
        folder = write(tmp_path / f"bad{i}", a=head + good + line)
        with pytest.raises(Exception, match="CAST_INVALID_INPUT|MALFORMED_CSV"):
            read_csv(spark, folder, CSV_COLUMNS["items"]).collect()
        with pytest.raises(Exception, match="CAST_INVALID_INPUT|MALFORMED_CSV"):
            read_csv(spark, folder, CSV_COLUMNS["items"]).selectExpr("sum(price)", "sum(order_item_id)").collect()
    folder = write(tmp_path / "all", a=head + good + "".join(bad))
    rows = read_csv(spark, folder, CSV_COLUMNS["items"], strict=False).orderBy("order_id").collect()
    assert [r.bad_fields for r in rows] == [[], ["order_item_id"], ["price"], ["row"]]
    assert [(r.order_item_id, r.price) for r in rows] == [(1, 9.0), (None, 9.0), (1, None), (1, None)]


def test_counts_come_from_footers(spark, tmp_path):
    from starling.operators.rates import profile
    from starling.sources.tables import counting_from_footers, footer_profile
    made = {"a": spark.range(1000).repartition(3), "b": spark.range(7).selectExpr("id", "id * 2 AS x"), "none": spark.range(0)}
    files = {name: str(tmp_path / name) for name in made}
    for name, df in made.items():
        df.write.parquet(files[name])
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    found = sorted(map(tuple, footer_profile(spark, files).collect()))
    assert found == sorted(map(tuple, profile(made).collect())) and spark.conf.get("spark.sql.sources.useV1SourceList") == before
    with counting_from_footers(spark):
        plan = spark.read.parquet(files["a"]).groupBy().count()._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan
