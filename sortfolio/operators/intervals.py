"""Joins on time: a date inside an interval, and the last row as of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: parts that rows without a key are dealt to, so that they don't meet in one task
_LOOSE = 4096


def _no_clash(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    both = (set(left.columns) & set(right.columns)) - set(keys)
    if both:
        raise ValueError(f"columns on both sides: {sorted(both)}")


def _present(cols: list[str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull()
    return out


def dated_join(points: DataFrame, intervals: DataFrame, on: list[str], at: str, begin: str, end: str, how: str = "inner") -> DataFrame:
    """Every point with every interval of its key that holds its date; both ends belong to the interval.

    A missing end is open. Intervals are cut into the years of the points and joined on (key, year), so that the join is an
    equi-join whatever the sizes; a point has one year and meets an interval once. An interval that ends before it begins, a point
    without a date and missing keys match nothing (with ``how="left"`` such a point stays, without an interval).
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    _no_clash(points, intervals, on)
    first, last = (points.agg(f(F.year(at))).scalar() for f in (F.min, F.max))
    since, until = F.greatest(F.year(begin), first), F.least(F.year(end), last)  # both skip what is missing
    cut = (intervals.where(_present(on) & F.coalesce(F.col(begin) <= F.col(end), F.lit(True)))
           .withColumn("__year", F.explode(F.when(since <= until, F.sequence(since, until)))))
    inside = F.coalesce(F.col(at) >= F.col(begin), F.lit(True)) & F.coalesce(F.col(at) <= F.col(end), F.lit(True))
    p, c = points.withColumn("__year", F.year(at)).alias("p"), cut.alias("c")
    same = F.lit(True)
    for k in [*on, "__year"]:
        same = same & (F.col(f"p.{k}") == F.col(f"c.{k}"))
    return p.join(c, same & inside, how).select("p.*", *[f"c.{x}" for x in intervals.columns if x not in on]).drop("__year")


def as_of(points: DataFrame, history: DataFrame, on: list[str], at: str, seen: str, max_days: int | None = None, strict: bool = False) -> DataFrame:
    """Each point with the last row of its key's history on or before its date (``strict``: before it), missing if there is none.

    ``max_days`` bounds the age of that row. Of several rows of one date the greatest in the order of their columns counts.
    Points and history are stacked and shuffled once, by key, or with a bound by key and stretches of ``max_days``: a row lies in
    its own stretch and the next, so that a key with a long history is dealt out too. Rows without a key or a date match nothing.
    """
    if max_days is not None and max_days < 0:
        raise ValueError("max_days is not below zero")
    _no_clash(points, history, on)
    values = [c for c in history.columns if c not in on]
    width = None if max_days is None else max_days + 1
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    stretch = lambda c: F.floor(day(c) / width).cast("bigint") if width else F.lit(0).cast("bigint")
    keyed = _present([*on, at])
    loose = F.pmod(F.xxhash64(*[F.col(c) for c in points.columns]), F.lit(_LOOSE))
    left = points.select(*on, F.when(keyed, stretch(at)).otherwise(-1 - loose).alias("__part"), keyed.alias("__keyed"), F.col(at).alias("__at"),
                         F.lit(0 if strict else 1).alias("__side"), F.struct(*points.columns).alias("__point"))
    own = stretch(seen)
    parts = F.array(own, own + 1) if width else F.array(own)
    right = history.where(_present([*on, seen])).select(
        *on, F.explode(parts).alias("__part"), F.lit(True).alias("__keyed"), F.col(seen).alias("__at"), F.lit(1 if strict else 0).alias("__side"),
        F.struct(*values).alias("__row"))
    order = Window.partitionBy(*on, "__keyed", "__part").orderBy("__at", "__side", "__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.unionByName(right, allowMissingColumns=True).withColumn("__last", F.last("__row", ignorenulls=True).over(order))
    fresh = F.lit(True) if max_days is None else F.datediff(F.col("__at"), F.col(f"__last.{seen}")) <= max_days
    found = both.where(F.col("__point").isNotNull()).withColumn("__last", F.when(fresh, F.col("__last")))
    return found.select("__point.*", *[F.col(f"__last.{c}").alias(c) for c in values])
