from datetime import datetime

import pytest
from pyspark.sql import functions as F

import small
from starling.plans import refresh
from starling.plans.master import order_master
from starling.sources.tables import parquet_tables, write_tables

COLUMNS = ["order_id", "order_purchase_timestamp", "n_items", "total_price", "review_score", "seller_state",
           "product_category_name_english", "delivery_bucket"]


def order(o, month, days=10):
    bought = datetime(2018, month, 3) if month else None
    return (o, "delivered", bought, datetime(2018, month or 1, 20), datetime(2018, month or 1, 13))


def orders(spark, *rows):
    return spark.createDataFrame(list(rows), small.orders(spark, []).schema)


@pytest.fixture
def source(spark, tmp_path):
    """Orders of three months, an order without a time, and a file of items and of reviews each."""
    made = orders(spark, *[order(f"{m}-{i}", m) for m in (1, 2, 3) for i in range(3)], order("none", None))
    ids = [r[0] for r in made.collect()]
    tables = small.tables(spark).with_table(
        orders=made, items=small.items(spark, [(o, 1, "p1", "s1", 10.0, 1.0) for o in ids]),
        reviews=small.reviews(spark, [("r" + o, o, 5, "text") for o in ids]))
    write_tables(tables.with_table(orders=made.coalesce(1), items=tables.items.coalesce(1), reviews=tables.reviews.coalesce(1)),
                 str(tmp_path / "in"))
    return tables, str(tmp_path / "in"), str(tmp_path / "mart")


def rows(df):
    return sorted(map(str, df.select(*COLUMNS).collect()))


def up_to_date(spark, folder, mart):
    """The refreshed mart equals one built from scratch, and a second refresh finds nothing to do."""
    assert rows(refresh.refreshed_mart(spark, mart)) == rows(order_master(parquet_tables(spark, folder)))
    assert refresh.refresh_mart(spark, folder, mart) == refresh.Refreshed((), (), 0)


def month_files(tmp_path):
    return {str(f): f.stat().st_mtime_ns for f in tmp_path.glob("mart/months/*/*.parquet")}


JANUARY, FEBRUARY, MARCH, APRIL = (f"2018-0{m}-01" for m in (1, 2, 3, 4))


def test_first_build_and_nothing_new(spark, source):
    _, folder, mart = source
    done = refresh.refresh_mart(spark, folder, mart)
    assert done.written == (refresh.NO_MONTH, JANUARY, FEBRUARY, MARCH) and not done.emptied
    assert refresh.refreshed_mart(spark, mart).count() == 10
    up_to_date(spark, folder, mart)


def test_only_a_partial_build_picks_items(spark, source, monkeypatch):
    """Where all months are built, items and reviews go to their roll-ups as they are, without a join that moves every row."""
    tables, folder, mart = source
    joins, build = [], refresh.order_master
    monkeypatch.setattr(refresh, "order_master", lambda part: joins.append(
        [df._jdf.queryExecution().analyzed().toString().count("Join LeftSemi") for df in (part.items, part.reviews)])
        or build(part))
    refresh.refresh_mart(spark, folder, mart)
    refresh.add_files(tables.with_table(items=small.items(spark, [("2-1", 9, "p1", "s1", 5.0, 1.0)])), folder, "items")
    refresh.refresh_mart(spark, folder, mart)
    assert joins == [[0, 0], [1, 1]]
    monkeypatch.undo()
    up_to_date(spark, folder, mart)


def test_a_new_file_rewrites_only_its_months(spark, source, tmp_path):
    tables, folder, mart = source
    refresh.refresh_mart(spark, folder, mart)
    before = month_files(tmp_path)
    late = tables.with_table(orders=orders(spark, order("late", 3), order("april", 4), order("alone", 4)),
                             items=small.items(spark, [(o, 1, "p1", "s1", 5.0, 1.0) for o in ("late", "april")]),
                             reviews=small.reviews(spark, [("x" + o, o, 1, "t") for o in ("late", "april")]))
    refresh.add_files(late, folder, "orders", "items", "reviews")
    done = refresh.refresh_mart(spark, folder, mart)
    assert done.written == (MARCH, APRIL) and done.n_changed >= 3
    after = month_files(tmp_path)
    kept = {f for f in before if MARCH not in f}
    assert {f: after.get(f) for f in kept} == {f: before[f] for f in kept}
    assert not {f for f in before if MARCH in f} & set(after)
    up_to_date(spark, folder, mart)


def test_more_items_and_reviews_for_known_orders(spark, source):
    tables, folder, mart = source
    refresh.refresh_mart(spark, folder, mart)
    refresh.add_files(tables.with_table(items=small.items(spark, [("2-1", 2, "p1", "s1", 7.0, 1.0), ("gone", 1, "p1", "s1", 1.0, 1.0)])),
                      folder, "items")
    assert refresh.refresh_mart(spark, folder, mart).written == (FEBRUARY,)
    refresh.add_files(tables.with_table(reviews=small.reviews(spark, [("again", "none", 1, "t")])), folder, "reviews")
    assert refresh.refresh_mart(spark, folder, mart).written == (refresh.NO_MONTH,)
    up_to_date(spark, folder, mart)


def test_replaced_and_missing_files(spark, source):
    tables, folder, mart = source
    refresh.refresh_mart(spark, folder, mart)
    # The one file of orders replaced: an order moves to April, March loses all of its orders.
    moved = orders(spark, *[order(f"{m}-{i}", m) for m in (1, 2) for i in range(3) if (m, i) != (1, 0)], order("1-0", 4))
    moved.coalesce(1).write.mode("overwrite").parquet(f"{folder}/orders")
    done = refresh.refresh_mart(spark, folder, mart)
    assert done.written == (JANUARY, FEBRUARY, APRIL) and done.emptied == (refresh.NO_MONTH, MARCH)
    up_to_date(spark, folder, mart)
    # The items' file is older than the move, but now touches April too.
    small.items(spark, [("2-0", 1, "p1", "s1", 1.0, 1.0)]).coalesce(1).write.mode("overwrite").parquet(f"{folder}/items")
    done = refresh.refresh_mart(spark, folder, mart)
    assert done.written == (FEBRUARY,) and set(done.emptied) >= {JANUARY, APRIL}
    up_to_date(spark, folder, mart)


def test_a_changed_dimension_makes_all_stale(spark, source):
    tables, folder, mart = source
    refresh.refresh_mart(spark, folder, mart)
    spark.createDataFrame([("s1", "RJ")], "seller_id string, seller_state string").coalesce(1).write.mode("overwrite").parquet(
        f"{folder}/sellers")
    assert len(refresh.refresh_mart(spark, folder, mart).written) == 4
    assert {r.seller_state for r in refresh.refreshed_mart(spark, mart).collect()} == {"RJ"}
    up_to_date(spark, folder, mart)


def test_lost_manifest_builds_anew(spark, source, tmp_path):
    import shutil
    _, folder, mart = source
    refresh.refresh_mart(spark, folder, mart)
    shutil.rmtree(tmp_path / "mart" / "manifest")
    shutil.copytree(tmp_path / "mart" / "months" / f"purchase_month={MARCH}", tmp_path / "mart" / "months" / "purchase_month=2011-01-01")
    assert len(refresh.refresh_mart(spark, folder, mart).written) == 4
    up_to_date(spark, folder, mart)
