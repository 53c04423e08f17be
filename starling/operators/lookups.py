"""Left joins to reference tables, and filling a list of groups with whatever was measured for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def look_up(facts: DataFrame, reference: DataFrame, fact_key: str, reference_key: str,
            spread_by: str | None = None, salts: int = 1) -> DataFrame:
    """Left join of ``facts`` to ``reference``, whose key is unique. Keeps both key columns.

    No broadcast is forced: Spark broadcasts the reference side when its size is under
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise, where AQE splits a hot key's
    partition. ``salts`` above 1 spreads each key over that many tasks up front, at the price of as many
    copies of the reference rows; ``spread_by`` is the fact column that picks the copy.
    """
    if salts <= 1:
        return facts.join(reference, facts[fact_key] == reference[reference_key], "left")
    copies = reference.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    same = (salted[fact_key] == copies[reference_key]) & (salted["_salt"] == copies["_copy"])
    return salted.join(copies, same, "left").drop("_salt", "_copy")


def fill_groups(groups: DataFrame, measured: DataFrame, key: str) -> DataFrame:
    """Every group, with NULL measures where nothing was measured."""
    return groups.join(measured, key, "left")
