"""Numbers cut into quantile bins, and rows that are then alike merged into one with their weights added."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def quantile_edges(df: DataFrame, columns: Sequence[str], bins: int, error: float = 1e-3) -> dict[str, tuple[float, ...]]:
    """Per column the upper edges of all bins but the last, which is open; fewer than ``bins`` where values repeat.

    One pass over ``df`` with a mergeable summary per column, whose ranks are off by at most ``error`` of the rows; missing
    values and NaN take no part. At most ``bins`` numbers a column come to the driver.
    """
    found = df.approxQuantile(list(columns), [i / bins for i in range(1, bins)], error)
    return {c: tuple(sorted(set(edges))) for c, edges in zip(columns, found)}


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """The number of edges below ``value``: 0 up to and including the first edge."""
    if not edges:
        return F.lit(0.0)
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda edge: edge < value)).cast("double")


def merged(df: DataFrame, keys: Sequence[str], **sums: Column) -> DataFrame:
    """One row for all rows alike in ``keys`` (NULL is a key like any other) with the given sums. Rows are reduced where they
    lie before anything is shuffled, so a combination that most rows have does no harm."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
