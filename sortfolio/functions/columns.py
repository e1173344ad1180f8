"""Column expressions shared by the operators; all run inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    """Missing is NaN in the inputs; Spark would order NaN above every number."""
    return F.when(~F.isnan(c), c)


def month_end(c: Column, fmt: str | None = None, strict: bool = True) -> Column:
    """Last day of the month of a date, or of text/number in the given format.

    Text that is no date is an error, or missing unless ``strict`` (lines of mixed files are
    told apart by a filter, but the optimizer may evaluate the date before it).
    """
    if fmt is None:
        return F.last_day(F.to_date(c))
    parse = F.to_date if strict else F.try_to_date
    return F.last_day(parse(c.cast("string"), fmt))


def formation_year(jdate: Column) -> Column:
    return F.year(jdate)


def guarded_ratio(num: Column, den: Column) -> Column:
    """Sum-over-sum ratio: an empty numerator counts as 0, an empty or zero denominator is missing."""
    return F.try_divide(F.coalesce(num, F.lit(0.0)), den)


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, rounded half-even to 4 decimals of the share."""
    return F.bround(F.try_divide(part.cast("double"), whole.cast("double")), 4) * 100


def two_way(flag: Column, x: Column, median: Column, low: str, high: str) -> Column:
    return F.when(flag == 1, F.when(x <= median, low).when(x > median, high))


def three_way(flag: Column, x: Column, lo: Column, hi: Column, labels: Sequence[str]) -> Column:
    """Low at or below ``lo``, middle strictly below ``hi``, high otherwise (needs ``x >= lo``)."""
    low, mid, high = labels
    return F.when(flag == 1, F.when(x <= lo, low).when(x < hi, mid).when(x >= lo, high))


def ntile_bucket(x: Column, edges: Column, n_edges: int) -> Column:
    """1-based right-closed bin of ``x``; missing when ``x`` or any edge is missing.

    A fold over the edges: written out edge by edge, the sorts' projections grow past the method size that the JVM compiles.
    """
    bucket = F.aggregate(edges, F.lit(1), lambda n, edge: n + (x > edge).cast("int"))
    return F.when(F.size(edges) == n_edges, bucket)


def any_not_null(cols: Sequence[str]) -> Column:
    out = F.col(cols[0]).isNotNull()
    for c in cols[1:]:
        out = out | F.col(c).isNotNull()
    return out


def all_not_null(cols: Sequence[str]) -> Column:
    out = F.col(cols[0]).isNotNull()
    for c in cols[1:]:
        out = out & F.col(c).isNotNull()
    return out
