"""Column expressions used across the operators. All of them stay inside JVM code generation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


def whole_days(start: str, end: str) -> Column:
    """Days from ``start`` to ``end``, rounded towards minus infinity (nine hours early is -1).

    Subtracting gives an interval that knows no time zone; its day part is cut towards zero, so one more day
    comes off where something negative is left over.
    """
    gap = F.col(end) - F.col(start)
    days = F.extract(F.lit("DAY"), gap)
    return (days - flag(gap < F.make_dt_interval(days))).cast("long")


def bin_number(value: Column, edges: Sequence[float]) -> Column:
    """Number, from 0, of the right-closed bin ``(edges[i], edges[i+1]]`` holding ``value``; NULL outside."""
    found = F.when(value > edges[-1], F.lit(None).cast("int"))
    for number in reversed(range(len(edges) - 1)):
        found = found.when(value > edges[number], F.lit(number))
    return found


def name_of(number: Column, names: Sequence[str]) -> Column:
    """The name at a position counted from 0; NULL for NULL."""
    return F.get(F.array(*[F.lit(n) for n in names]), number)


def half_even(value: Column) -> Column:
    """Nearest integer, with halves going to the even neighbour."""
    return F.bround(value).cast("int")


def safe_ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, NULL where the bottom is zero (ANSI division would stop the job)."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def clip(value: Column, low: float, high: float) -> Column:
    """``value`` held inside ``[low, high]``; NULL stays NULL, which least/greatest alone would lose."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def flag(condition: Column) -> Column:
    return condition.cast("int")


def percent(share: Column) -> Column:
    return share * 100


def month_of(moment: str) -> Column:
    """First moment of the month. Goes through the date, so no time zone comes in."""
    return F.trunc(F.col(moment).cast("date"), "month").cast("timestamp_ntz")


def not_null(*names: str) -> Column:
    """One ``IS NOT NULL`` per column, AND-ed: the form that lets Catalyst turn outer joins inner."""
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])


# The limits and texts of the two gradings below.
def risk_tier(probability: Column) -> Column:
    return (F.when(probability > 0.5, "Likely bad review")
             .when(probability > 0.3, "Elevated risk")
             .when(probability.isNotNull(), "Low risk"))


def significance_text(p: Column) -> Column:
    shown = F.format_string("p = %.4f", p)
    return (F.when(p < 0.001, "p < 0.001 (extremely significant)")
             .when(p < 0.01, F.concat(shown, F.lit(" (highly significant)")))
             .when(p < 0.05, F.concat(shown, F.lit(" (significant)")))
             .when(p.isNotNull(), F.concat(shown, F.lit(" (NOT significant)"))))
