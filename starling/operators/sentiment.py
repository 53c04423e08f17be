"""Polarity of review texts from a word list, and reviews whose words and stars disagree."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from starling.session import settled

# Fixed values of the published VADER method: normalisation and negation factor, and its negators.
NORMALISER = 15.0
NEGATION = -0.74
NEGATORS = (
    "ain't", "aint", "aren't", "arent", "can't", "cannot", "cant", "couldn't", "couldnt", "daren't", "darent",
    "despite", "didn't", "didnt", "doesn't", "doesnt", "don't", "dont", "hadn't", "hadnt", "hasn't", "hasnt",
    "haven't", "havent", "isn't", "isnt", "mightn't", "mightnt", "mustn't", "mustnt", "needn't", "neednt",
    "neither", "never", "none", "nope", "nor", "not", "nothing", "nowhere", "oughtn't", "oughtnt", "rarely",
    "seldom", "shan't", "shant", "shouldn't", "shouldnt", "uhuh", "wasn't", "wasnt", "weren't", "werent",
    "without", "won't", "wont", "wouldn't", "wouldnt",
)
NEGATION_REACH = 3

# Anything but a letter or an apostrophe parts words, so accented words and contractions stay whole.
WORD_BREAK = r"[^\p{L}']+"

#: Curly apostrophes, written as straight ones; at the ends of a word they are quotes.
CURLY = "\u2019\u2018"
#: Words that are broadcast at once, and pieces of that size that a longer list may come to in texts.
MOST_WORDS, MOST_PIECES = 200_000, 20

TEXT, STARS = "review_comment_message", "review_score"


def text_hash(text: str = TEXT) -> Column:
    return F.xxhash64(text)


def words_of(text: str = TEXT, word_break: str = WORD_BREAK) -> Column:
    straight = F.translate(F.lower(text), CURLY, "'" * len(CURLY))
    return F.transform(F.split(straight, word_break), lambda word: F.btrim(word, F.lit("'")))


def checked_words(lexicon: DataFrame, most: int = MOST_WORDS) -> DataFrame | None:
    """The list, marked for broadcast once its size is known to allow it; None for a longer one."""
    words = lexicon.select("token", "valence")
    return None if words.limit(most + 1).count() > most else F.broadcast(words)


def with_valence(rows: DataFrame, lexicon: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """``rows`` (a word each, in ``token``) with its ``valence``, NULL for a word that is not listed.

    A list of up to ``most`` words is broadcast. Of a longer one only the words that occur matter: the distinct words of
    each task, never their occurrences, are shuffled to the list, and what is left of it is broadcast in pieces of
    ``most`` words, up to ``MOST_PIECES`` of them, that every word is looked up in where it lies.
    """
    words = checked_words(lexicon, most)
    if words is not None:
        return rows.join(words, "token", "left")
    held = settled(lexicon.select("token", "valence").join(rows.select("token").distinct(), "token", "left_semi"))
    n_pieces = max(1, -(-held.count() // most))
    # By hash a piece may be somewhat larger than the mean; a quarter more pieces allow for it.
    n_pieces = 1 if n_pieces == 1 else n_pieces + -(-n_pieces // 4)
    if n_pieces > MOST_PIECES:
        raise ValueError(f"more than {MOST_PIECES} pieces of {most} listed words occur in the texts")
    found = []
    for i in range(n_pieces):
        piece = held.where(F.pmod(F.xxhash64("token"), F.lit(n_pieces)) == i)
        rows = rows.join(F.broadcast(piece.withColumnRenamed("valence", f"valence{i}")), "token", "left")
        found.append(f"valence{i}")
    return rows.withColumn("valence", F.coalesce(*found)).drop(*found)


def review_sentiment(reviews: DataFrame, lexicon: DataFrame, keys: Sequence[str] = ("review_id", "order_id"),
                     negators: Sequence[str] = NEGATORS, word_break: str = WORD_BREAK,
                     most_words: int = MOST_WORDS) -> DataFrame:
    """Sentiment in [-1, 1] per review with a text. Reviews alike in keys, stars and text come as one row with
    their number in ``n_copies``; ``text_hash`` tells the texts of one key apart.

    Every word of every text is looked up in the word list (token, valence), one of more than ``most_words`` in pieces;
    words are summed per review where they are read, and one row per review is shuffled, never the words. Several
    negators in reach of a word count once, where the published rule turns it anew for each.
    """
    carried = [*keys, STARS, "text_hash"]
    texts = (reviews.where(F.col(TEXT).isNotNull()).withColumn("text_hash", text_hash())
             .select(*carried, words_of(TEXT, word_break).alias("token"),
                     F.array(F.lit(True)).alias("is_first")))
    behind = [f"back{k}" for k in range(1, NEGATION_REACH + 1)] if negators else []
    if negators:
        # Marks of negators, moved one to three places on, so that each word meets those before it. A text
        # without any gets none. Words and marks are columns of their own, so that each is computed once.
        texts = texts.withColumn("marks", F.when(
            F.arrays_overlap("token", F.array(*[F.lit(n) for n in negators])),
            F.transform("token", lambda word: word.isin(*negators))).otherwise(F.array().cast("array<boolean>")))
        texts = texts.withColumns({name: F.when(F.size("marks") > 0, F.concat(
            F.array_repeat(F.lit(False), k), "marks")).otherwise(F.col("marks"))
            for k, name in enumerate(behind, 1)})
    # The moved marks reach past the last word, where there is no token.
    rows = (texts.select(*carried, F.inline(F.arrays_zip("token", "is_first", *behind)))
            .where(F.col("token").isNotNull()))
    valence = F.coalesce(F.col("valence"), F.lit(0.0))
    if negators:
        valence = valence * F.when(reduce(or_, map(F.col, behind)), NEGATION).otherwise(1.0)
    total = F.col("_sum") / F.col("n_copies")
    return (with_valence(rows, lexicon, most_words)
            .groupBy(*carried).agg(F.sum(valence).alias("_sum"), F.count("is_first").alias("n_copies"))
            .select(*carried, "n_copies", (total / F.sqrt(total * total + NORMALISER)).alias("sentiment")))


def mismatch_flags(scored: DataFrame, limit: float = 0.3) -> DataFrame:
    """Adds a flag for five stars with negative words, and one for a single star with positive words."""
    stars, mood = F.col(STARS), F.col("sentiment")
    return scored.withColumns({"five_star_negative": (stars == 5) & (mood < -limit),
                               "one_star_positive": (stars == 1) & (mood > limit)})


def mismatch_counts(scored: DataFrame, limit: float = 0.3) -> DataFrame:
    def copies(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n_copies"))), F.lit(0))
    return mismatch_flags(scored, limit).agg(
        copies(F.col("five_star_negative")).alias("n_five_star_negative"),
        copies(F.col("one_star_positive")).alias("n_one_star_positive"),
        copies(F.lit(True)).alias("n_scored"))
