"""Rows whose keys stand in another table or a long list, without moving the rows that surely do not qualify."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: Bits of the map of keys: 2**27 of them, 16 MB, however many keys; and bits of one of its rows, a fixed value of Spark's
#: bitmap functions.
MAP_BITS, BUCKET_BITS = 1 << 27, 1 << 15
#: A list of so many values stands in the plan; a longer one becomes a table.
MOST_INLINE = 1000


def maybe_in(rows: DataFrame, wanted: DataFrame, *keys: str, bits: int = MAP_BITS, inside: bool = True) -> DataFrame:
    """``rows`` without those whose keys are surely not among ``wanted``, by a map of hashed keys of a fixed size that goes
    to every task: what must be shuffled to an exact join is little more than what it finds. ``inside=False`` gives the
    others, which are surely not there. NULL keys hash like values. Columns of ``rows`` are kept; none may be named
    ``_asked``, ``_bucket`` or ``_map``."""
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    buckets = F.floor(place / BUCKET_BITS)
    # Rows of bitmaps: their size is bits / 8 bytes at most.
    held = (wanted.select(buckets.alias("_bucket"), F.pmod(place, F.lit(BUCKET_BITS)).alias("_bit")).groupBy("_bucket")
            .agg(F.bitmap_construct_agg("_bit").alias("_map")))
    byte = F.conv(F.hex(F.substring("_map", F.floor(F.pmod(place, F.lit(BUCKET_BITS)) / 8).cast("int") + 1, F.lit(1))), 16, 10)
    bit = F.getbit(byte.cast("int"), F.pmod(place, F.lit(8)).cast("int")) == 1
    marked = rows.withColumn("_asked", buckets).join(F.broadcast(held), F.col("_asked") == F.col("_bucket"), "left")
    hit = F.coalesce(bit, F.lit(False))
    return marked.where(hit if inside else ~hit).drop("_asked", "_bucket", "_map")


def in_table(rows: DataFrame, column: str, values: DataFrame, bits: int = MAP_BITS) -> DataFrame:
    """``rows`` whose ``column`` is among the first column of ``values``, a table of any size; NULL is never among them.

    The map leaves out most other rows where they are read, before anything is shuffled; the semi-join after it is exact.
    Spark broadcasts the values where they are few, and the map costs little then.
    """
    kind = rows.schema[column].dataType
    wanted = values.select(F.col(values.columns[0]).cast(kind).alias(column)).where(F.col(column).isNotNull())
    return maybe_in(rows, wanted, column, bits=bits).join(wanted, column, "left_semi").select(*rows.columns)


def in_list(rows: DataFrame, column: str, values: Sequence | DataFrame) -> DataFrame:
    """``rows`` whose ``column`` is one of ``values``. A list of up to ``MOST_INLINE`` values is a condition that reaches the
    scan; a longer one, or one given as a table, goes by ``in_table``."""
    if isinstance(values, DataFrame):
        return in_table(rows, column, values)
    if len(values) <= MOST_INLINE:
        return rows.where(F.col(column).isin(list(values)))
    kind = rows.schema[column].dataType.simpleString()
    return in_table(rows, column, rows.sparkSession.createDataFrame([(v,) for v in set(values)], f"`{column}` {kind}"))
