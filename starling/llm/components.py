"""Connected components by alternating stars, on tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from starling.session import settled

MOST_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One round. Large: every node ties its larger neighbours to the smallest it knows. Small: every node ties its
    smaller neighbours and itself to the smallest of them. A node's neighbours are never gathered: their minimum is
    aggregated and joined back, and the skew handling splits the rows of a node that has a great many."""
    if large:
        links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    if large:
        tied = (links.where("b > a").join(least, "a")
                .select(F.col("b").alias("a"), F.least("a", "least").alias("b")))
    else:
        tied = links.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        tied = tied.unionByName(least.select("a", F.col("least").alias("b")))
    return tied.where("a > b").distinct()


def components(links: DataFrame, one: str = "a", other: str = "b") -> DataFrame:
    """``node`` and ``component``, the smallest node it is connected to, for every linked node that is not the
    smallest itself. Each round is written to the shared checkpoint folder."""
    a, b = F.col(one), F.col(other)
    now = settled(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    print_of = None
    for _ in range(MOST_ROUNDS):
        now = settled(_star(_star(now, large=True), large=False))
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(row) == print_of:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        print_of = tuple(row)
    raise RuntimeError("components did not settle")
