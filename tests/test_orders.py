import small
from starling.operators.orders import items_rollup, reviews_rollup


def test_first_values_are_found_apart_and_skip_missing(spark):
    rows = [("a", 2, "p2", "s2", 1.0, 0.0), ("a", 1, "p1", None, 2.0, 0.5), ("a", 3, None, "s0", 3.0, 0.5)]
    found = items_rollup(small.items(spark, rows)).first()
    assert (found.primary_seller, found.primary_product) == ("s2", "p1")
    assert (found.n_items, found.total_price, found.total_freight) == (3, 6.0, 1.0)


def test_sum_of_nothing_is_zero(spark):
    found = items_rollup(small.items(spark, [("a", 1, "p", "s", None, None)])).first()
    assert (found.total_price, found.total_freight, found.freight_pct) == (0.0, 0.0, None)


def test_free_order_has_no_freight_share(spark):
    found = items_rollup(small.items(spark, [("a", 1, "p", "s", 0.0, 5.0)])).first()
    assert found.freight_pct is None and found.total_freight == 5.0


def test_result_does_not_depend_on_layout(spark):
    rows = [(f"o{i % 7}", i % 3, f"p{i * 5 % 11}", f"s{i * 3 % 5}", float(i % 4), 1.0) for i in range(200)]
    one = sorted(items_rollup(small.items(spark, rows).coalesce(1)).collect())
    many = sorted(items_rollup(small.items(spark, rows[::-1]).repartition(13)).collect())
    assert one == many and len(one) == 7


def test_mean_score_rounds_half_to_even(spark):
    pairs = {"x": (2, 3), "y": (1, 2), "z": (3, 4)}
    rows = [(f"{o}{s}", o, s, None) for o, scores in pairs.items() for s in scores]
    found = {r.order_id: (r.review_score, r.review_score_round, r.n_reviews)
             for r in reviews_rollup(small.reviews(spark, rows)).collect()}
    assert found == {"x": (2.5, 2, 2), "y": (1.5, 2, 2), "z": (3.5, 4, 2)}
