"""Review texts against stars. Works on raw reviews, those of undelivered orders included."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from starling.operators.ordered import five_numbers, sample_by_hash
from starling.operators.sentiment import STARS, TEXT, mismatch_flags, review_sentiment, text_hash

SAMPLE_SIZE = 5000


def text_sample(reviews: DataFrame, key: str = "review_id", n: int = SAMPLE_SIZE, seed: int = 42) -> DataFrame:
    """A repeatable sample of the reviews that have a text. Scoring needs none: it handles all of them."""
    return sample_by_hash(reviews.where(reviews[TEXT].isNotNull()), key, n, seed)


def sentiment_by_star(scored: DataFrame, method: str = "linear") -> DataFrame:
    return five_numbers(scored, STARS, "sentiment", method, copies="n_copies")


def mismatched_reviews(reviews: DataFrame, lexicon: DataFrame, **options) -> DataFrame:
    """The disagreeing reviews with their texts, copies each on a row. Texts join the mismatches only."""
    keys = [*options.get("keys", ("review_id", "order_id")), STARS, "text_hash"]
    scored = mismatch_flags(review_sentiment(reviews, lexicon, **options))
    texts = reviews.where(F.col(TEXT).isNotNull()).withColumn("text_hash", text_hash()).select(
        *[F.col(k).alias(f"_{k}") for k in keys], TEXT)
    # Keys may be NULL, and NULL is a key like any other here.
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return (scored.where("five_star_negative OR one_star_positive").drop("n_copies")
            .join(texts, same).drop("text_hash", *[f"_{k}" for k in keys]))
