import math

import pytest
from pyspark.sql import functions as F

import small
from starling.operators.sentiment import checked_words, mismatch_counts, review_sentiment, with_valence
from starling.plans import review_text
from starling.sources.tables import missing_to_null
from starling.sources.trade_view import TradeFolder, sample_lexicon


def lexicon(spark):
    return spark.sql("SELECT * FROM VALUES ('good', 1.9D), ('bad', -2.5D), ('ótimo', 3.0D) AS l(token, valence)")


def mood(spark, text, **options):
    rows = review_sentiment(small.reviews(spark, [("r", "o", 5, text)]), lexicon(spark), **options).collect()
    return rows[0].sentiment if rows else None


def norm(total):
    return total / math.sqrt(total * total + 15)


@pytest.mark.parametrize("text, total", [
    ("Good, GOOD... good!", 5.7), ("nothing of note here", 0.0), ("produto ótimo", 3.0), ("goodness", 0.0),
    ("not good", -0.74 * 1.9), ("not at all good", -0.74 * 1.9), ("not at all that good", 1.9),
    ("It isn't a bad one", 0.74 * 2.5), ("bad, never good", -2.5 - 0.74 * 1.9), ("good not", 1.9),
    ("'good'", 1.9), ("don\u2019t think good", -0.74 * 1.9), ("\u2018bad\u2019 \u2014 'tis", -2.5)])
def test_words_and_negation(spark, text, total):
    assert mood(spark, text) == pytest.approx(norm(total))


def test_missing_texts_are_not_scored(spark):
    rows = [(str(i), "o", 3, t) for i, t in enumerate(["", "NA", "null", None, "good"])]
    scored = review_sentiment(missing_to_null(small.reviews(spark, rows)), lexicon(spark)).collect()
    assert [r.review_id for r in scored] == ["4"]


def test_whole_long_text_counts(spark):
    assert mood(spark, "word " * 20_000 + "good") == pytest.approx(norm(1.9))


def test_undelivered_orders_are_scored(spark):
    reviews = small.tables(spark).reviews
    assert "canceled" in {r.order_id for r in review_sentiment(reviews, lexicon(spark)).collect()}


def test_mismatches(spark):
    rows = [("a", "o", 5, "bad"), ("b", "o", 1, "good good"), ("c", "o", 5, "good"), ("d", "o", 1, "bad"),
            ("e", "o", 4, "bad")]
    reviews = small.reviews(spark, rows)
    scored = review_sentiment(reviews, lexicon(spark))
    assert tuple(mismatch_counts(scored).first()) == (1, 1, 5)
    found = review_text.mismatched_reviews(reviews, lexicon(spark)).orderBy("review_id").collect()
    assert [(r.review_id, r.review_comment_message) for r in found] == [("a", "bad"), ("b", "good good")]


def test_rows_without_ids_stay(spark):
    rows = [("a", "o", 5, "bad"), (None, "o", 5, "bad bad"), ("c", None, 1, "good"), (None, None, 5, "good")]
    reviews = small.reviews(spark, rows)
    assert tuple(mismatch_counts(review_sentiment(reviews, lexicon(spark))).first()) == (2, 1, 4)
    found = review_text.mismatched_reviews(reviews, lexicon(spark)).collect()
    assert {(r.review_id, r.order_id, r.review_comment_message) for r in found} == {tuple(r[:2]) + (r[3],) for r in rows[:3]}


def test_word_list_is_broadcast_after_a_check(spark, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    words = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "token string, valence double")
    scored = review_sentiment(small.reviews(spark, [("r", "o", 5, "good")]), words)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning(token" not in plan
    assert checked_words(words, most=1) is None


def test_copies_and_shared_keys_count_in_full(spark):
    """A third of the rows are copies of one review, another third share its key with other texts."""
    rows = ([("r", "o", 5, "bad")] * 20 + [("r", "o", 5, f"good {i}") for i in range(20)]
            + [(f"x{i}", "o", 1, "good") for i in range(20)])
    reviews = small.reviews(spark, rows).repartition(7)
    scored = review_sentiment(reviews, lexicon(spark))
    assert {(r.review_score, round(r.sentiment, 6)): r.n for r in scored.groupBy(
        "review_score", F.round("sentiment", 6).alias("sentiment")).agg(F.sum("n_copies").alias("n")).collect()} == {
        (5, round(norm(-2.5), 6)): 20, (5, round(norm(1.9), 6)): 20, (1, round(norm(1.9), 6)): 20}
    assert tuple(mismatch_counts(scored).first()) == (20, 20, 60)
    assert review_text.mismatched_reviews(reviews, lexicon(spark)).count() == 40
    five = review_text.sentiment_by_star(scored).where("review_score = 5").first()
    assert five.n == 40 and five.median == pytest.approx((norm(-2.5) + norm(1.9)) / 2)


def test_sample_texts_give_the_known_sum(spark):
    texts = TradeFolder(spark, "/root/testdata/sf0.01").review_texts()
    scored = review_sentiment(texts, sample_lexicon(spark), negators=(), word_break="[^a-z]+")
    mood = F.round("sentiment", 6)
    total, low = scored.agg(F.round(F.sum(mood), 3), F.count_if(mood < -0.3)).first()
    assert (total, low) == (542.114, 93)


def test_words_are_not_shuffled(spark):
    texts = TradeFolder(spark, "/root/testdata/sf0.01").review_texts()
    scored = review_sentiment(texts, sample_lexicon(spark))
    scored.collect()
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning(review_id") == 1


def test_long_word_lists_give_the_same(spark):
    texts = TradeFolder(spark, "/root/testdata/sf0.001").review_texts()
    few = sample_lexicon(spark)
    more = few.unionByName(spark.range(5000).select(F.concat(F.lit("never"), "id").alias("token"), F.lit(1.0).alias("valence")))
    expected = sorted(map(str, review_sentiment(texts, few).collect()))
    for most in (200_000, 4999, 3, 1):
        assert sorted(map(str, review_sentiment(texts, more, most_words=most).collect())) == expected
    with pytest.raises(ValueError, match="pieces"):
        review_sentiment(texts, texts.select(F.explode(F.split(F.lower("review_comment_message"), "[^a-z]+")).alias("token")).distinct()
                         .withColumn("valence", F.lit(1.0)), most_words=2)


def test_a_million_words_shuffle_no_occurrence(spark, settings):
    listed = spark.range(1_000_000).select(F.concat(F.lit("w"), "id").alias("token"), (F.col("id") % 9 - 4.0).alias("valence"))
    words = spark.range(60_000).select(F.col("id").alias("review_id"), F.concat(F.lit("w"), (F.col("id") * 37) % 1_200_000).alias("token"))
    rows = words.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20))))
    found = with_valence(rows, listed, most=20_000)
    assert found.count() == 1_200_000 and found.where("valence IS NULL").count() == 20 * words.where(
        "CAST(substring(token, 2) AS BIGINT) >= 1000000").count()
    settings(spark__sql__adaptive__enabled="false")
    plan = with_valence(rows, listed, most=20_000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 3 and "hashpartitioning" not in plan
