"""DuckDB SQL that checks the registered queries. Written on its own, from the table rules up."""

VIEWS = """
WITH v_orders AS (
  SELECT o_orderkey AS order_id,
         CASE WHEN o_orderstatus = 'P' THEN 'canceled' ELSE 'delivered' END AS order_status,
         o_orderdate AS order_purchase_timestamp,
         CASE WHEN o_orderkey % 97 <> 0
              THEN o_orderdate + to_hours(24 * (10 + o_custkey % 41) + o_orderkey % 24) END
           AS order_delivered_customer_date,
         o_orderdate + to_hours(720) AS order_estimated_delivery_date
  FROM orders),
v_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
         l_suppkey AS seller_id, l_extendedprice AS price, l_extendedprice * l_tax + 0.0 AS freight_value
  FROM lineitem),
v_reviews AS (
  SELECT l_orderkey * 8 + l_linenumber AS review_id, l_orderkey AS order_id,
         CASE WHEN l_linenumber <= 2 THEN CAST(greatest(1, 1 + CAST(l_quantity AS INTEGER) % 5
              - CASE WHEN o_custkey % 41 > 20 THEN 2 ELSE 0 END) AS INTEGER) END AS review_score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
v_products AS (SELECT p_partkey AS product_id, p_brand AS product_category_name FROM part),
v_translation AS (
  SELECT DISTINCT p_brand AS product_category_name,
         CASE WHEN p_brand <> 'Brand#13' THEN lower(p_brand) END AS product_category_name_english
  FROM part),
v_sellers AS (
  SELECT s_suppkey AS seller_id, CASE WHEN s_suppkey % 29 <> 0 THEN n_name END AS seller_state
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
v_delivered AS (
  SELECT *,
    CAST(floor((epoch_us(order_delivered_customer_date) - epoch_us(order_purchase_timestamp))
               / 86400000000.0) AS BIGINT) AS delivery_time_days,
    CAST(floor((epoch_us(order_delivered_customer_date) - epoch_us(order_estimated_delivery_date))
               / 86400000000.0) AS BIGINT) AS delivery_delay_days
  FROM v_orders WHERE order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL),
v_items_agg AS (
  SELECT order_id, count(order_item_id) AS n_items, coalesce(sum(price), 0.0) AS total_price,
         coalesce(sum(freight_value), 0.0) AS total_freight,
         arg_min(seller_id, struct_pack(a := order_item_id, b := product_id, c := seller_id, d := price))
           AS primary_seller,
         arg_min(product_id, struct_pack(a := order_item_id, b := product_id, c := seller_id, d := price))
           AS primary_product
  FROM v_items GROUP BY order_id),
v_items_pct AS (
  SELECT *, CASE WHEN total_price <> 0 THEN total_freight / total_price END AS freight_pct FROM v_items_agg),
v_reviews_agg AS (
  SELECT order_id, avg(review_score) AS review_score, count(review_id) AS n_reviews,
         CAST(round_even(avg(review_score), 0) AS INTEGER) AS review_score_round
  FROM v_reviews GROUP BY order_id),
v_joined AS (
  SELECT d.*, i.n_items, i.total_price, i.total_freight, i.primary_seller, i.primary_product, i.freight_pct,
         r.review_score, r.n_reviews, r.review_score_round, p.product_id, p.product_category_name,
         t.product_category_name_english, s.seller_id, s.seller_state
  FROM v_delivered d
  LEFT JOIN v_items_pct i ON d.order_id = i.order_id
  LEFT JOIN v_reviews_agg r ON d.order_id = r.order_id
  LEFT JOIN v_products p ON i.primary_product = p.product_id
  LEFT JOIN v_translation t ON p.product_category_name = t.product_category_name
  LEFT JOIN v_sellers s ON i.primary_seller = s.seller_id),
v_bucket_names AS (
  SELECT * FROM (VALUES (-100, -7, '7+ days early', 0), (-7, -1, '1-7 days early', 1), (-1, 0, 'on time', 2),
                        (0, 7, '1-7 days late', 3), (7, 100, '7+ days late', 4))
    AS b(above, upto, delivery_bucket, delivery_bucket_ord)),
v_master AS (
  SELECT j.*, CAST(review_score_round <= 2 AS INTEGER) AS is_bad_review, b.delivery_bucket, b.delivery_bucket_ord
  FROM v_joined j LEFT JOIN v_bucket_names b ON delivery_delay_days > above AND delivery_delay_days <= upto
  WHERE review_score IS NOT NULL AND total_price IS NOT NULL AND product_category_name_english IS NOT NULL),
v_score AS (
  SELECT order_id, is_bad_review,
         round(greatest(0.0, least(1.0, (delivery_delay_days + 30) / 60.0)), 6) AS score FROM v_master)
"""

RATES = """round(avg(is_bad_review), 6) AS bad_rate, count(is_bad_review) AS n_orders,
           round(avg(is_bad_review) * 100, 6) AS bad_rate_pct"""

FIGURES = """SELECT count(*) AS n_orders, round(avg(review_score), 6) AS avg_review,
       round(avg(is_bad_review) * 100, 6) AS bad_rate_pct, round(avg(delivery_time_days), 6) AS avg_delivery,
       round(avg(delivery_delay_days), 6) AS avg_delay"""

CATEGORY_RATES = f"""SELECT product_category_name_english, {RATES}, round(avg(delivery_time_days), 6) AS avg_delivery
  FROM v_master GROUP BY 1 HAVING count(is_bad_review) >= 260"""

STATE_RATES = f"""SELECT seller_state, {RATES}, round(avg(delivery_time_days), 6) AS avg_delivery
  FROM v_master WHERE seller_state IS NOT NULL GROUP BY 1 HAVING count(is_bad_review) >= 260"""


def _bucket_rates(where):
    return f"""SELECT delivery_bucket, {RATES}, delivery_bucket_ord FROM v_master
  WHERE delivery_bucket IS NOT NULL AND {where} GROUP BY delivery_bucket, delivery_bucket_ord"""


def _profile(tables):
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, (SELECT count(*) FROM v_{name}) AS n_rows, {columns} AS n_columns"
        for name, columns in tables.items())


def _histogram(low, high):
    return f""", x AS (
  SELECT is_bad_review, greatest(-30, least(30, delivery_delay_days)) AS v FROM v_master
  WHERE delivery_delay_days IS NOT NULL),
ends AS (SELECT is_bad_review, {low} AS lo, {high} AS hi FROM x GROUP BY is_bad_review),
binned AS (
  SELECT x.is_bad_review, lo, hi, CAST(least(40, floor(40 * (v - lo) / (hi - lo)) + 1) AS INTEGER) AS bin
  FROM x JOIN ends ON x.is_bad_review = ends.is_bad_review)
SELECT is_bad_review, bin, round(min(lo + (bin - 1) * (hi - lo) / 40.0), 6) AS bin_start, count(*) AS n
FROM binned GROUP BY is_bad_review, bin"""


# One row per distinct score, from high to low, with what lies at or above it.
ROC = """, g AS (
  SELECT score, CAST(sum(is_bad_review) AS BIGINT) AS pos, CAST(sum(1 - is_bad_review) AS BIGINT) AS neg
  FROM v_score GROUP BY score),
c AS (
  SELECT score, pos, neg, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg,
         lead(pos) OVER (ORDER BY score DESC) AS next_pos, lead(neg) OVER (ORDER BY score DESC) AS next_neg,
         sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg
  FROM g WINDOW w AS (ORDER BY score DESC))
SELECT CAST(NULL AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr
UNION ALL
SELECT CAST(score AS DOUBLE), round(cum_neg / all_neg, 6), round(cum_pos / all_pos, 6) FROM c"""

WORDS = """WITH lexicon AS (
  SELECT * FROM (VALUES ('and', 0.7), ('is', 0.4), ('la', 1.1), ('le', -0.9), ('of', -1.2), ('that', -2.0),
                        ('the', 1.5), ('un', -1.4)) AS l(token, valence)),
texts AS (
  SELECT doc_id, CAST(1 + doc_id % 5 AS INTEGER) AS review_score, text,
         [trim(w, '''') FOR w IN regexp_split_to_array(translate(lower(text), '\u2019\u2018', ''''''), '[^\\p{L}'']+')]
           AS words FROM documents),
placed AS (
  SELECT doc_id, unnest(words) AS token, unnest(range(1, len(words) + 1)) AS i FROM texts),
tokens AS (
  SELECT doc_id, token, lag(token, 1) OVER w AS back1, lag(token, 2) OVER w AS back2, lag(token, 3) OVER w AS back3
  FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
"""


def _sentiment(factor="1.0"):
    return WORDS + f"""sums AS (
  SELECT doc_id, sum(CAST(valence AS DOUBLE) * {factor}) AS s
  FROM tokens JOIN lexicon ON tokens.token = lexicon.token GROUP BY doc_id),
scored AS (
  SELECT texts.doc_id AS review_id, texts.doc_id AS order_id, review_score, text AS review_comment_message,
         round(coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15.0), 6) AS sentiment
  FROM texts LEFT JOIN sums ON texts.doc_id = sums.doc_id)
"""


NEGATED = """CASE WHEN back1 IN ('to', 'in', 'de', 'un') OR back2 IN ('to', 'in', 'de', 'un')
  OR back3 IN ('to', 'in', 'de', 'un') THEN -0.74 ELSE 1.0 END"""


def _boxes(quartiles):
    return _sentiment() + f""", {quartiles},
marked AS (
  SELECT s.review_score, s.sentiment, q1, median, q3,
         s.sentiment BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM scored s JOIN q ON s.review_score = q.review_score)
SELECT review_score, count(*) AS n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(least(min(sentiment) FILTER (inside), q1), 6) AS low_whisker,
       round(greatest(max(sentiment) FILTER (inside), q3), 6) AS high_whisker,
       count(*) FILTER (NOT inside) AS n_outliers
FROM marked GROUP BY review_score, q1, median, q3"""


LINEAR = """q AS (
  SELECT review_score, quantile_cont(sentiment, 0.25) AS q1, quantile_cont(sentiment, 0.5) AS median,
         quantile_cont(sentiment, 0.75) AS q3 FROM scored GROUP BY review_score)"""


def _midpoint(name):
    low, high = (f"max(sentiment) FILTER (k = {end}({name}_at))" for end in ("floor", "ceil"))
    part = f"any_value({name}_at - floor({name}_at))"
    return f"{low} + {part} * ({high} - {low}) AS {name}"


# Position n * share - 0.5, kept inside the list.
MIDPOINT = f"""sized AS (
  SELECT review_score, sentiment, row_number() OVER (PARTITION BY review_score ORDER BY sentiment) - 1 AS k,
         count(*) OVER (PARTITION BY review_score) AS n FROM scored),
ranks AS (
  SELECT review_score, sentiment, k, greatest(0.0, least(n * 0.25 - 0.5, n - 1.0)) AS q1_at,
         greatest(0.0, least(n * 0.5 - 0.5, n - 1.0)) AS median_at,
         greatest(0.0, least(n * 0.75 - 0.5, n - 1.0)) AS q3_at FROM sized),
q AS (SELECT review_score, {_midpoint('q1')}, {_midpoint('median')}, {_midpoint('q3')}
      FROM ranks GROUP BY review_score)"""


def _hash(key, digits):
    return f"CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || '|42'), 1, {digits})) AS BIGINT)"


CONFUSION = """, c AS (
  SELECT count(*) FILTER (is_bad_review = 0 AND score < 0.5) AS tn,
         count(*) FILTER (is_bad_review = 0 AND score >= 0.5) AS fp,
         count(*) FILTER (is_bad_review = 1 AND score < 0.5) AS fn,
         count(*) FILTER (is_bad_review = 1 AND score >= 0.5) AS tp FROM v_score)
"""

TOP_CATEGORIES = """(SELECT product_category_name_english AS level, count(*) AS n FROM v_master
   GROUP BY 1 ORDER BY n DESC, level LIMIT 15)"""
TOP_STATES = """(SELECT seller_state AS level, count(*) AS n FROM v_master WHERE seller_state IS NOT NULL
   GROUP BY 1 ORDER BY n DESC, level LIMIT 10)"""

# Two-sided p by the published Chebyshev fit to erfc.
ERFC = ("-1.26551223", "1.00002368", "0.37409196", "0.09678418", "-0.18628806", "0.27886807", "-1.13520398", "1.48851587",
        "-0.82215223", "0.17087277")


def _p_tests(groups, late):
    """z squared, p and verdict of late against on time for each group."""
    keys = f"{groups}, " if groups else ""
    series = ERFC[-1]
    for coefficient in reversed(ERFC[:-1]):
        series = f"{coefficient} + t * ({series})"
    return VIEWS + f""", c AS (
  SELECT {keys}count(*) FILTER ({late} <= 0) AS n1, sum(is_bad_review) FILTER ({late} <= 0) AS b1,
         count(*) FILTER ({late} > 0) AS n2, sum(is_bad_review) FILTER ({late} > 0) AS b2
  FROM v_master {f"WHERE {groups} IS NOT NULL GROUP BY {groups}" if groups else ""}),
r AS (SELECT *, CAST(coalesce(b1, 0) + coalesce(b2, 0) AS DOUBLE) / nullif(n1 + n2, 0) AS pooled FROM c),
s AS (
  SELECT *, CASE WHEN n1 > 0 AND n2 > 0 AND pooled > 0 AND pooled < 1
    THEN (b2 / n2 - b1 / n1) / sqrt(pooled * (1 - pooled) * (1.0 / n1 + 1.0 / n2)) END AS z FROM r),
x AS (SELECT *, CAST(1 / (1 + abs(z) / sqrt(2.0) / 2) AS DOUBLE) AS t FROM s),
p AS (SELECT *, t * exp(-z * z / 2 + {series}) AS p FROM x)
SELECT {keys}round(z * z, 6) AS chi2, round(p, 6) AS p_value,
  CASE WHEN p < 0.001 THEN 'p < 0.001 (extremely significant)'
       WHEN p < 0.01 THEN printf('p = %.4f (highly significant)', p)
       WHEN p < 0.05 THEN printf('p = %.4f (significant)', p)
       WHEN p IS NOT NULL THEN printf('p = %.4f (NOT significant)', p) END AS verdict FROM p"""


TEST_SIZES = """, sizes AS (
  SELECT is_bad_review, count(*) AS n, CAST(round_even(count(*) * 0.2, 0) AS BIGINT) AS test
  FROM v_master GROUP BY is_bad_review)
"""

ORACLES = {
    "late_effect_pvalue": _p_tests("", "delivery_delay_days"),
    "late_effect_by_state": _p_tests("seller_state", "delivery_delay_days"),
    "month_effect_by_category": _p_tests("product_category_name_english", "(day(order_purchase_timestamp) - 15)"),
    "risk_model": VIEWS + TEST_SIZES + """SELECT CAST(sum(n - test) AS BIGINT) AS n_train,
  CAST(sum(test) AS BIGINT) AS n_test, true AS tells_apart, true AS holds_on_test_orders FROM sizes""",
    "feature_importance": "SELECT CAST(15 AS BIGINT) AS n_rows, true AS first_is_delivery, true AS adds_up",
    "split_importance": "SELECT CAST(15 AS BIGINT) AS n_rows, true AS adds_up, 150 AS n_trees",
    "model_confusion": VIEWS + TEST_SIZES + """SELECT CAST(sum(test) AS BIGINT) AS n_test,
  CAST(sum(test) FILTER (is_bad_review = 1) AS BIGINT) AS n_bad, true AS precise, true AS complete FROM sizes""",
    "model_roc": """SELECT CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr, CAST(1 AS DOUBLE) AS last_fpr,
  CAST(1 AS DOUBLE) AS last_tpr, true AS never_falls, true AS area_is_auc""",
    "score_scenarios": VIEWS + """SELECT CAST(delay AS BIGINT) AS delay, (SELECT count(*) FROM v_master) AS n_orders, riskier
FROM (VALUES (0, false), (14, true)) AS s(delay, riskier)""",
    "scenario_grid": VIEWS + """SELECT CAST(delay AS BIGINT) AS delay, CAST(price AS DOUBLE) AS price,
  CAST(items AS BIGINT) AS items, category, (SELECT count(*) FROM v_master) AS n_orders,
  (SELECT count(*) FROM v_master) AS n_rated, true AS all_shares
FROM (VALUES (-5), (10)) AS d(delay), (VALUES (20.0), (500.0)) AS p(price), (VALUES (1), (4)) AS i(items),
  (VALUES ('brand#25'), ('unseen')) AS c(category)""",
    "model_indicators": VIEWS + f"""SELECT order_id,
  'cat_' || CASE WHEN product_category_name_english IN (SELECT level FROM {TOP_CATEGORIES})
                 THEN product_category_name_english ELSE 'other' END
  || ' state_' || CASE WHEN seller_state IN (SELECT level FROM {TOP_STATES}) THEN seller_state ELSE 'other_state' END
    AS indicators FROM v_master""",
    "scan_profile": VIEWS + _profile({"orders": 5, "items": 6, "reviews": 3, "products": 2,
                                      "translation": 2, "sellers": 2}),
    "csv_ingest": VIEWS + """, v_texts AS (
  SELECT text || CASE WHEN doc_id % 3 = 0 THEN ' "so", they' || chr(10) || 'said' ELSE '' END AS message FROM documents)
""" + _profile({"orders": 7, "items": 6, "products": 2, "translation": 2, "sellers": 2}) + """
UNION ALL SELECT 'reviews', (SELECT count(*) FROM v_reviews) + (SELECT count(*) FROM documents), 4
UNION ALL SELECT 'delivery days', CAST(sum(delivery_time_days) AS BIGINT), 0 FROM v_delivered
UNION ALL SELECT 'approved hours', CAST(sum(hour(order_purchase_timestamp + to_hours(2))) AS BIGINT), 0 FROM v_orders
UNION ALL SELECT 'carried hours', CAST(sum(hour(order_delivered_customer_date - to_hours(30))) AS BIGINT), 0 FROM v_orders
UNION ALL SELECT 'texts', count(message), 0 FROM v_texts
UNION ALL SELECT 'text characters', CAST(sum(length(message)) AS BIGINT), 0 FROM v_texts
UNION ALL SELECT 'text hashes', CAST(sum(CAST('0x' || substr(md5(message), 1, 8) AS BIGINT)) AS BIGINT), 0 FROM v_texts""",
    "mart_by_month": VIEWS + """SELECT CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS purchase_month,
  count(*) AS n_orders, round(avg(review_score), 6) AS avg_review FROM v_master
GROUP BY 1""",
    "late_effect_verdict": VIEWS + """, c AS (
  SELECT count(*) FILTER (delivery_delay_days <= 0) AS n1, sum(is_bad_review) FILTER (delivery_delay_days <= 0) AS b1,
         count(*) FILTER (delivery_delay_days > 0) AS n2, sum(is_bad_review) FILTER (delivery_delay_days > 0) AS b2
  FROM v_master),
z AS (SELECT (b2 / n2 - b1 / n1) / sqrt((b1 + b2) / (n1 + n2) * (1 - (b1 + b2) / (n1 + n2)) * (1.0 / n1 + 1.0 / n2))
        AS z FROM c)
-- The two-sided p is under 0.001 where z is beyond 3.290527.
SELECT round(z * z, 4) AS chi2, CASE WHEN abs(z) > 3.290527 THEN 'p < 0.001 (extremely significant)' END AS verdict
FROM z""",
    "json_dimension": """SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n_events
FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1""",
    "distinct_categories": VIEWS + "SELECT DISTINCT product_category_name_english FROM v_master",
    "distinct_states": VIEWS + "SELECT DISTINCT seller_state FROM v_master WHERE seller_state IS NOT NULL",
    "table_preview": VIEWS + """SELECT order_id, review_score_round, is_bad_review, product_category_name_english,
  round(total_price, 2) AS total_price, delivery_delay_days, seller_state FROM v_master ORDER BY order_id LIMIT 5""",
    "delivered_orders": VIEWS + """SELECT * FROM v_orders
WHERE order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL""",
    "delivery_features": VIEWS + "SELECT order_id, delivery_time_days, delivery_delay_days FROM v_delivered",
    "delivery_buckets": VIEWS + """SELECT order_id, delivery_bucket, delivery_bucket_ord
FROM v_delivered LEFT JOIN v_bucket_names ON delivery_delay_days > above AND delivery_delay_days <= upto""",
    "items_rollup": VIEWS + """SELECT order_id, n_items, round(total_price, 6) AS total_price,
  round(total_freight, 6) AS total_freight, primary_seller, primary_product, round(freight_pct, 6) AS freight_pct
FROM v_items_pct""",
    "reviews_rollup": VIEWS + """SELECT order_id, round(review_score, 6) AS review_score, n_reviews,
  review_score_round FROM v_reviews_agg""",
    "order_master": VIEWS + """SELECT * REPLACE (round(total_price, 6) AS total_price,
  round(total_freight, 6) AS total_freight, round(freight_pct, 6) AS freight_pct,
  round(review_score, 6) AS review_score) FROM v_master""",
    "kpis": VIEWS + FIGURES + " FROM v_master",
    "filtered_kpis": VIEWS + FIGURES + """ FROM v_master
WHERE product_category_name_english IN ('brand#1', 'brand#2', 'brand#25')
  AND seller_state IN ('NATION_6', 'NATION_9', 'NATION_14')""",
    "bad_rate_by_delivery_bucket": VIEWS + _bucket_rates("true"),
    "filtered_bad_rate_by_delivery_bucket":
        VIEWS + _bucket_rates("seller_state IN ('NATION_6', 'NATION_9', 'NATION_14')"),
    "worst_categories": VIEWS + CATEGORY_RATES + """
ORDER BY avg(is_bad_review) DESC, product_category_name_english LIMIT 15""",
    "worst_categories_chart": VIEWS + f""", w AS ({CATEGORY_RATES}
ORDER BY avg(is_bad_review) DESC, product_category_name_english LIMIT 15)
SELECT product_category_name_english, bad_rate,
  row_number() OVER (ORDER BY bad_rate, product_category_name_english) AS place FROM w""",
    "best_categories": VIEWS + CATEGORY_RATES + """
ORDER BY avg(is_bad_review), product_category_name_english LIMIT 5""",
    "elevated_categories": VIEWS + f""", o AS (SELECT avg(is_bad_review) AS overall_exact FROM v_master),
k AS (SELECT product_category_name_english, {RATES}, round(avg(delivery_time_days), 6) AS avg_delivery,
        avg(is_bad_review) AS exact FROM v_master GROUP BY 1 HAVING count(is_bad_review) >= 260)
SELECT product_category_name_english, bad_rate, n_orders, bad_rate_pct, avg_delivery,
       round(overall_exact, 6) AS overall_rate, exact > overall_exact * 1.04 AS is_elevated
FROM k, o ORDER BY exact DESC, product_category_name_english LIMIT 15""",
    "monthly_trend": VIEWS + f"""SELECT CAST(date_trunc('month', order_purchase_timestamp) AS TIMESTAMP) AS month,
  {RATES}, round(avg(review_score), 6) AS avg_review FROM v_master GROUP BY 1 HAVING count(is_bad_review) >= 80""",
    "state_rates": VIEWS + STATE_RATES,
    "state_summary": VIEWS + STATE_RATES,
    "state_rates_dense": VIEWS + f""", s AS ({STATE_RATES})
SELECT n_name AS seller_state, s.* EXCLUDE (seller_state) FROM nation LEFT JOIN s ON n_name = s.seller_state""",
    "score_distribution": VIEWS + "SELECT review_score, count(*) AS n FROM v_reviews "
                                  "WHERE review_score IS NOT NULL GROUP BY review_score",
    "raw_bad_share": VIEWS + """SELECT round(avg(coalesce(CAST(review_score <= 2 AS INTEGER), 0)) * 100, 6) AS bad_pct,
  count(*) AS n_reviews FROM v_reviews""",
    "delay_histogram": VIEWS + _histogram("-30", "30"),
    "delay_histogram_own_range": VIEWS + _histogram("min(v)", "max(v)"),
    "late_effect_ztest": VIEWS + """, c AS (
  SELECT count(*) FILTER (delivery_delay_days <= 0) AS n_ontime,
         CAST(sum(is_bad_review) FILTER (delivery_delay_days <= 0) AS BIGINT) AS bad_ontime,
         count(*) FILTER (delivery_delay_days > 0) AS n_late,
         CAST(sum(is_bad_review) FILTER (delivery_delay_days > 0) AS BIGINT) AS bad_late FROM v_master),
p AS (SELECT *, bad_ontime / n_ontime AS p1, bad_late / n_late AS p2,
             (bad_ontime + bad_late) / (n_ontime + n_late) AS pooled FROM c)
SELECT n_ontime, bad_ontime, n_late, bad_late, round(p1, 6) AS rate_ontime, round(p2, 6) AS rate_late,
       round((p2 - p1) * 100, 6) AS difference_pp, round(pooled, 6) AS pooled_rate,
       round((p2 - p1) / sqrt(pooled * (1 - pooled) * (1.0 / n_ontime + 1.0 / n_late)), 6) AS z FROM p""",
    "top_n_levels": VIEWS + f"""SELECT 'category' AS kind, level, n FROM {TOP_CATEGORIES}
UNION ALL SELECT 'state' AS kind, level, n FROM {TOP_STATES}""",
    "rare_level_grouping": VIEWS + f"""SELECT order_id,
  CASE WHEN product_category_name_english IN (SELECT level FROM {TOP_CATEGORIES})
       THEN product_category_name_english ELSE 'other' END AS cat_grouped,
  CASE WHEN seller_state IN (SELECT level FROM {TOP_STATES}) THEN seller_state ELSE 'other_state' END
    AS state_grouped FROM v_master""",
    "model_features": VIEWS + """SELECT order_id, CAST(delivery_delay_days AS DOUBLE) AS delivery_delay_days,
  CAST(delivery_time_days AS DOUBLE) AS delivery_time_days, round(total_price, 6) AS total_price,
  round(total_freight, 6) AS total_freight, round(coalesce(freight_pct, 0), 6) AS freight_pct,
  CAST(n_items AS DOUBLE) AS n_items FROM v_master""",
    "train_test_split": VIEWS + f"""SELECT order_id, CAST({_hash('order_id', 8)} % 5 = 0 AS INTEGER) AS is_test
FROM v_orders""",
    "stratified_split": VIEWS + f""", r AS (
  SELECT order_id, is_bad_review,
         row_number() OVER (PARTITION BY is_bad_review ORDER BY {_hash('order_id', 15)}) AS k,
         count(*) OVER (PARTITION BY is_bad_review) AS n FROM v_master)
SELECT order_id, is_bad_review, CAST(k <= round_even(n * 0.2, 0) AS INTEGER) AS is_test FROM r""",
    "class_weights": VIEWS + """SELECT is_bad_review, count(*) AS n,
  round((SELECT count(*) FROM v_master) / (2 * count(*)), 6) AS weight FROM v_master GROUP BY is_bad_review""",
    "auc_rank_sum": VIEWS + """, r AS (
  SELECT is_bad_review, rank() OVER (ORDER BY score)
         + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid_rank FROM v_score),
s AS (SELECT sum(mid_rank) FILTER (is_bad_review = 1) AS rank_sum, count(*) FILTER (is_bad_review = 1) AS n_pos,
             count(*) FILTER (is_bad_review = 0) AS n_neg FROM r)
SELECT n_pos, n_neg, round((rank_sum - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 6) AS auc FROM s""",
    "roc_curve": VIEWS + ROC,
    "roc_curve_corners": VIEWS + ROC + " WHERE NOT (pos = next_pos AND neg = next_neg) OR next_pos IS NULL",
    "confusion_matrix": VIEWS + CONFUSION + """SELECT 0 AS actual, 0 AS predicted, tn AS n FROM c
UNION ALL SELECT 0, 1, fp FROM c UNION ALL SELECT 1, 0, fn FROM c UNION ALL SELECT 1, 1, tp FROM c""",
    "precision_recall": VIEWS + CONFUSION + """SELECT tn, fp, fn, tp,
  CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0.0 END AS recall FROM c""",
    "risk_tiers": VIEWS + """SELECT CASE WHEN score > 0.5 THEN 'Likely bad review'
  WHEN score > 0.3 THEN 'Elevated risk' ELSE 'Low risk' END AS risk, count(*) AS n_orders FROM v_score GROUP BY 1""",
    "review_sentiment": _sentiment() + """SELECT review_id, order_id, review_score, sentiment,
  count(*) OVER (PARTITION BY review_id, review_comment_message) AS n_copies FROM scored""",
    "review_sentiment_negated":
        _sentiment(NEGATED) + """SELECT review_id, order_id, review_score, sentiment,
  count(*) OVER (PARTITION BY review_id, review_comment_message) AS n_copies FROM scored""",
    "sentiment_by_star": _boxes(LINEAR),
    "sentiment_by_star_midpoint": _boxes(MIDPOINT),
    "sentiment_mismatch": _sentiment() + """SELECT
  count(*) FILTER (review_score = 5 AND sentiment < -0.3) AS n_five_star_negative,
  count(*) FILTER (review_score = 1 AND sentiment > 0.3) AS n_one_star_positive, count(*) AS n_scored FROM scored""",
    "mismatched_reviews": _sentiment() + """SELECT review_id, order_id, review_score, sentiment,
  review_score = 5 AND sentiment < -0.3 AS five_star_negative,
  review_score = 1 AND sentiment > 0.3 AS one_star_positive, review_comment_message
FROM scored WHERE five_star_negative OR one_star_positive""",
    "sample_by_hash": f"""SELECT doc_id AS review_id, CAST(1 + doc_id % 5 AS INTEGER) AS review_score FROM documents
ORDER BY {_hash('doc_id', 15)}, doc_id LIMIT 500""",
}
# The same mart from other files.
ORACLES["order_master_bucketed"] = ORACLES["order_master"]
# Of the means without copies SQL knows how many orders they cover; the query holds them against scored copies.
ORACLES["scenario_means"] = ORACLES["scenario_grid"].replace("AS n_orders,", "AS n_orders, true AS same_mean").replace(
    """
  (SELECT count(*) FROM v_master) AS n_rated, true AS all_shares""", "")
ORACLES["kpis_of_listed_products"] = VIEWS + FIGURES + """ FROM v_master
WHERE primary_product IN (SELECT p_partkey FROM part WHERE p_size % 2 = 1)"""
ORACLES["mart_refreshed"] = VIEWS + """SELECT CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS purchase_month,
  count(*) AS n_orders, round(avg(review_score), 6) AS avg_review,
  date_trunc('month', order_purchase_timestamp) >= DATE '2000-01-01' AS written_by_refresh FROM v_master GROUP BY 1, 4"""

# Scores in 24 equal bins, from below and from above.
_BINS = VIEWS + """, h AS (
  SELECT CAST(greatest(0, least(23, floor(score * 24))) AS INTEGER) AS bin,
    sum(is_bad_review) AS pos, sum(1 - is_bad_review) AS neg FROM v_score GROUP BY 1),
c AS (
  SELECT *, coalesce(sum(neg) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower,
    sum(pos) OVER (ORDER BY bin DESC) AS pos_above, sum(neg) OVER (ORDER BY bin DESC) AS neg_above,
    sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg FROM h)
"""
ORACLES["auc_from_histogram"] = _BINS + """SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
  round(sum(pos * (lower + neg / 2.0)) / (sum(pos) * CAST(sum(neg) AS DOUBLE)), 6) AS auc,
  round(sum(pos * neg / 2.0) / (sum(pos) * CAST(sum(neg) AS DOUBLE)), 6) AS error_bound, true AS within_bound FROM c"""
ORACLES["roc_from_histogram"] = _BINS + """SELECT round(bin / 24.0, 6) AS threshold,
  round(neg_above / CAST(all_neg AS DOUBLE), 6) AS fpr, round(pos_above / CAST(all_pos AS DOUBLE), 6) AS tpr FROM c
UNION ALL SELECT NULL, 0.0, 0.0"""
ORACLES["sentiment_by_star_sketched"] = _sentiment() + """SELECT review_score, count(*) AS n, true AS q1_near,
  true AS median_near, true AS q3_near FROM scored GROUP BY review_score"""
_DIGIT = "instr('0123456789abcdef', substr(md5(token), {}, 1)) - 1"
ORACLES["review_sentiment_long_list"] = _sentiment().replace("sums AS (", f"""long_list AS (
  SELECT DISTINCT token, {_DIGIT.format(1)} - 7 AS valence FROM tokens
  WHERE regexp_full_match(token, '[a-z]+') AND ({_DIGIT.format(2)}) % 2 = 0),
sums AS (""", 1).replace("JOIN lexicon ON tokens.token = lexicon.token", "JOIN long_list ON tokens.token = long_list.token") + """
SELECT review_id, order_id, review_score, sentiment, count(*) OVER (PARTITION BY review_id, review_comment_message) AS n_copies
FROM scored"""
_RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
ORACLES["footer_profile"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, "
    f"(SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE {t})) AS n_columns" for t in _RAW)
