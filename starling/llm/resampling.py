"""Resampling of documents towards a target text collection, by importance weights over hashed word n-grams.

Features are runs of one and two words, hashed into buckets. A bucket's gain says how much more often the target uses it
than the documents do; a document's weight is the mean gain of its features, and documents are drawn by weight plus
a fixed noise of their own (the Gumbel form of weighted drawing without replacement).

Lines repeat: licences, menus, copies. A line break parts words, so texts are cut into lines, and each
distinct line of the corpus is taken apart once: its features count as often as it occurs, and the sum of its gains goes to
every document that holds it. Pairs of words on either side of a line break are the only features beyond, and
are added by document. Counts and weights are exact.

NULL and empty texts, and texts without a word, have no feature and weight 0. A NULL key hashes as the empty text. Every row
of the table is a document of its own, repeated rows and keys included; rows that tie in score and key are ranked in
an order that is left open. Without a target or without documents all counts are 0 and the formulas hold as they stand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from starling.llm.batches import stored
from starling.operators.ordered import running_totals

BUCKETS = 10_000
#: Documents of fewer words are weighed but never drawn.
LEAST_WORDS = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what parts words.
PARTS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def _bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("smallint" if buckets <= 2**15 else "int")


def _lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _lines(low: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(low, "\n", -1), lambda line: line.rlike(f"[^{PARTS}]"))


def _line_hash(line: Column) -> Column:
    """More bits than a corpus of any size needs."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def _seams(lines: Column, buckets: int) -> Column:
    """Buckets of the pairs of words that a line break parts: the last of a line and the first of the next."""
    def first_word(line):
        return F.regexp_extract(line, f"[^{PARTS}]+", 0)
    def last_word(line):
        return F.reverse(first_word(F.reverse(line)))
    n = F.greatest(F.size(lines) - 1, F.lit(0))
    return F.zip_with(F.transform(F.slice(lines, F.lit(1), n), last_word),
                      F.transform(F.slice(lines, F.lit(2), n), first_word),
                      lambda a, b: _bucket(F.concat(a, F.lit(" "), b), buckets))


def _distinct_lines(rows: DataFrame, buckets: int) -> DataFrame:
    """``h1``, ``h2``, ``n`` (occurrences), ``words`` and ``found`` (the buckets of all features) of every distinct line."""
    lines = (rows.select(F.explode("lines").alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))
             .select("line", "n", F.filter(F.split("line", f"[{PARTS}]+"), lambda w: w != "").alias("w")))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1),
                       lambda a, b: _bucket(F.concat(a, F.lit(" "), b), buckets))
    return lines.select(_line_hash(F.col("line")).alias("h"), "n", F.size("w").cast("bigint").alias("words"), F.concat(
        F.transform("w", lambda w: _bucket(w, buckets)), pairs).alias("found")).select("h.*", "n", "words", "found")


def _counts(lines: DataFrame, seams: DataFrame) -> DataFrame:
    """Occurrences per bucket, one row for each that occurs."""
    inside = lines.select(F.explode("found").alias("bucket"), "n").groupBy("bucket").agg(F.sum("n").alias("n"))
    across = seams.select(F.explode("seams").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return inside.unionByName(across).groupBy("bucket").agg(F.sum("n").alias("n"))


def text_counts(df: DataFrame, text: str, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``n`` over all texts of ``df``."""
    rows = df.select(_lines(_lowered(F.col(text))).alias("lines"))
    return _counts(_distinct_lines(rows, buckets), rows.select(_seams(F.col("lines"), buckets).alias("seams")))


def gains(counts: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Per bucket the floored thousandfold log ratio of its shares in ``target`` and ``counts``, each with one added to
    every bucket. One number a bucket comes to the driver, whatever the size of the tables."""
    total = {name: float(df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) for name, df in (("s", counts), ("t", target))}
    every = counts.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = (every.join(counts.select("bucket", F.col("n").alias("s")), "bucket", "left")
            .join(target.select("bucket", F.col("n").alias("t")), "bucket", "left"))
    t, s = (F.coalesce(F.col(c), F.lit(0)).cast("double") + 1 for c in ("t", "s"))
    ratio = (t * (total["s"] + buckets)) / (s * (total["t"] + buckets))
    rows = both.select("bucket", F.floor(F.log(ratio) * 1000).alias("gain")).collect()
    return [gain for _, gain in sorted(map(tuple, rows))]


def _floored_mean(total: Column, n: Column) -> Column:
    return F.when(n > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0))


def weights(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
            buckets: int = BUCKETS, seed: int = 7, carry: Sequence[str] = ()) -> DataFrame:
    """Per row of ``df``: ``_id`` (its key), ``n_words``, ``n_features``, ``weight``, ``score`` (weight plus noise), ``_at``
    (a number of the row) and ``_row`` with the columns named in ``carry``."""
    own = [F.struct(*carry).alias("_row")] if carry else []
    texts = df.select(F.col(key).alias("_id"), *own, _lines(_lowered(F.col(text))).alias("lines"))
    kept = ["_id", "_row"] if carry else ["_id"]
    lines = stored(_distinct_lines(texts, buckets), "lines")
    rows = stored(texts.select(
        F.monotonically_increasing_id().alias("_at"), *kept, F.transform("lines", _line_hash).alias("hashes"),
        _seams(F.col("lines"), buckets).alias("seams")), "rows")
    gain = gains(_counts(lines, rows), text_counts(target, target_text, buckets), buckets)
    # One literal, folded once: a number a bucket.
    gain = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")

    def summed(found: str) -> Column:
        return F.aggregate(found, F.lit(0).cast("bigint"), lambda total, bucket: total + F.get(gain, bucket))

    # A line that a third of the documents hold is split by the skew handling of this join.
    held = (rows.select("_at", F.explode("hashes").alias("h")).select("_at", "h.*")
            .join(lines.select("h1", "h2", "words", summed("found").alias("gain")), ["h1", "h2"])
            .groupBy("_at").agg(F.sum("words").alias("words"), F.sum("gain").alias("gain")))
    n_words = F.coalesce("words", F.lit(0))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256),
                               1, 8), 16, 10).cast("double")
    return (rows.select("_at", *kept, summed("seams").alias("seam_gain"))
            .join(held, "_at", "left")
            .withColumns({"n_words": n_words, "n_features": F.greatest(2 * n_words - 1, F.lit(0)).cast("bigint"),
                          "total": F.coalesce("gain", F.lit(0)) + F.col("seam_gain")})
            .withColumn("weight", _floored_mean(F.col("total"), F.col("n_features")).cast("bigint"))
            .withColumn("score", F.col("weight") + F.floor(F.log(-F.log((noise + 0.5) / 4294967296.0)) * -1000.0))
            .select("_at", *kept, "n_words", "n_features", "weight", "score"))


def ranked(df: DataFrame, target: DataFrame, key: str = "doc_id", percent: int = 25, least_words: int = LEAST_WORDS,
           **options) -> DataFrame:
    """One row per row of ``df``: key, ``n_features``, ``weight``, ``score`` and ``rank``, its place among the
    floor(percent * N / 100) best scores of the N documents of at least ``least_words`` words, ties to the smaller
    key; NULL for the others. ``options`` go to ``weights``; carried columns come in ``_row``."""
    scored = stored(weights(df, target, key, **options), "scores")
    fit = F.col("n_words") >= least_words
    drawn = percent * scored.where(fit).count() // 100
    # Ranks are running totals over parts of the order, so no task sorts all documents.
    place = F.struct((-F.col("score")).alias("score"), "_id", "_at")
    placed = running_totals(scored.where(fit).select("*", place.alias("_place"), F.lit(1).cast("bigint").alias("one")),
                            "_place", ["one"])
    rest = scored.where(~fit).withColumn("rank", F.lit(None).cast("bigint"))
    rank = F.when(F.col("one_upto") <= drawn, F.col("one_upto")).alias("rank")
    both = placed.select(*scored.columns, rank).unionByName(rest)
    return both.select(F.col("_id").alias(key), "n_features", "weight", "score", "rank",
                       *(["_row"] if "_row" in both.columns else []))


def resample(df: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of ``df`` with all their columns."""
    return ranked(df, target, key, carry=df.columns, **options).where("rank IS NOT NULL").select("_row.*")
