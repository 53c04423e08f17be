"""Removal of lines that repeat across a corpus, by overlapping windows of three lines.

Every three consecutive lines of a text are a window. A window that occurs more than once is kept where it occurs
first, in the order of key and line number, and all its other occurrences are covered: the lines they span go,
overlapping spans merged. Windows without anything but blanks do not count. DataFrame functions only.

A text of fewer than three lines has no window and stays as it is; NULL stays NULL. Rows with a NULL key come first.
Repeated rows (of one key and text) are treated alike, as one document. Of different texts that share a key, or have none,
the occurrence on the earlier line comes first, then that of the text with the smaller hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 3
#: Texts of one key that are told apart by place.
TEXTS = 1 << 23


def _windows(text: Column) -> Column:
    """Per window its place and two hashes of its lines; more hash bits than a corpus of any size needs."""
    lines = F.split(text, "\n", -1)
    def window(i):
        three = [F.get("_lines", i + k) for k in range(WINDOW)]
        return F.struct(i.alias("_at"), F.xxhash64(*three).alias("_w1"), F.xxhash64(F.lit(1), *three).alias("_w2"),
                        (F.length(F.trim(F.concat(*three))) > 0).alias("_said"))
    return lines, F.when(F.size("_lines") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size("_lines") - WINDOW), window))


def _place() -> Column:
    """Key, line number and part of the text's hash in one number, so that the first place is a plain minimum. 64, 31 and 23
    bits of them fit its 38 digits."""
    key = F.coalesce(F.col("_key"), F.lit(-2**63)).cast("decimal(20,0)")
    line = (key * F.lit(2**31).cast("decimal(10,0)") + F.col("_at")).cast("decimal(30,0)")
    return (line * F.lit(TEXTS).cast("decimal(7,0)") + F.pmod("_hash", F.lit(TEXTS))).cast("decimal(38,0)")


def later_windows(df: DataFrame, key: str, text: str) -> DataFrame:
    """_key, _hash (of the text) and _at of every window that has occurred before."""
    lines, windows = _windows(F.col("_text"))
    rows = (df.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text")).where("_text IS NOT NULL")
            .select("_key", F.xxhash64("_text").alias("_hash"), lines.alias("_lines"))
            .select("_key", "_hash", F.inline(windows)).where("_said").drop("_said")
            .withColumn("_place", _place()))
    repeated = (rows.groupBy("_w1", "_w2").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
                .where("_n > 1").drop("_n"))
    # A window that a third of the lines have is split by the skew handling of this join.
    return rows.join(repeated, ["_w1", "_w2"]).where("_place > _first").select("_key", "_hash", "_at")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text",
                   removed: str | None = "lines_removed") -> DataFrame:
    """``df`` with covered lines taken out of ``text``, and how many in ``removed`` (an existing column of that name
    is replaced)."""
    covered = (later_windows(df, key, text).groupBy("_key", "_hash")
               .agg(F.array_sort(F.collect_set("_at")).alias("_covered")))
    # All spans are equally long, so what stays lies between the end of one and the next start.
    starts = F.concat(F.array(F.lit(0)), F.transform("_covered", lambda at: at + WINDOW))
    ends = F.concat("_covered", F.array(F.size("_lines")))
    kept = F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda z: F.slice(
        F.col("_lines"), z["a"] + 1, F.greatest(z["b"] - z["a"], F.lit(0)))))
    # The whole row is one column meanwhile, so that no name of its own can clash with those used here.
    rows = df.select(F.struct(*df.columns).alias("_row"))
    own_text = F.col("_row")[text]
    lines = F.split(own_text, "\n", -1)
    joined = (rows.join(covered, F.col("_row")[key].cast("bigint").eqNullSafe(F.col("_key"))
                        & (F.xxhash64(own_text) == F.col("_hash")), "left")
              .withColumn("_lines", F.when(F.col("_covered").isNotNull(), lines))
              .withColumn("_kept", F.when(F.col("_covered").isNotNull(), kept)))
    touched = F.col("_covered").isNotNull()
    out = {c: F.col("_row")[c].alias(c) for c in df.columns}
    out[text] = F.when(touched, F.array_join("_kept", "\n")).otherwise(own_text).alias(text)
    if removed:
        out[removed] = (F.when(touched, F.size("_lines") - F.size("_kept")).otherwise(0)).cast("int").alias(removed)
    return joined.select(*out.values())
