"""Exact group quantiles with bounded work per task.

Equal values are counted first (combined on the map side), so no value is hot, and the counts are landed:
the rows themselves are read once.  Groups of at most ``CELL`` rows are ranked by one window.  The counts of larger groups are
range-partitioned by group and value and landed with their partition's number: such a group
lies in many partitions, each a run of its sorted values.  Summed counts per group and partition
are a small table, whose running sums tell which partitions hold a wanted rank; only those are
ranked by a window inside (group, partition).  No task holds more than ``CELL`` rows of a group or its
share of a partition, no row is dropped and nothing is approximated; both ways give the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sortfolio.landing import land

#: rows of a group that one task may rank
CELL = 1 << 16


def _rank_low(p: float, n: Column) -> Column:
    return F.floor(F.lit(p) * (n - 1))


def _rank_high(p: float, n: Column) -> Column:
    return F.ceil(F.lit(p) * (n - 1))


def _holds(rank: Column) -> Column:
    """The order statistic of this 0-based rank lies in the current run of rows."""
    return (F.col("before") <= rank) & (rank < F.col("before") + F.col("c"))


def _wanted(probs: Sequence[float]) -> Column:
    n = F.col("n")
    return reduce(lambda a, b: a | b, [_holds(rank(p, n)) for p in probs for rank in (_rank_low, _rank_high)])


def _interpolate(p: float) -> Column:
    """Linear interpolation between neighbouring order statistics, exact when they are tied."""
    pos = F.lit(p) * (F.col("n") - 1)
    frac = pos - F.floor(pos)
    lo, hi = F.col(f"lo_{_name(p)}"), F.col(f"hi_{_name(p)}")
    return F.when(lo == hi, lo).when(frac < 0.5, lo + (hi - lo) * frac).otherwise(hi - (hi - lo) * (1 - frac))


def _name(p: float) -> str:
    return str(p).replace(".", "_")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: Sequence[float], cell: int = CELL) -> DataFrame:
    """One row per key with ``n`` and a column ``q_<p>`` for every probability; keys are never missing."""
    v = df.select(*keys, F.col(value).alias("x")).filter(F.col("x").isNotNull())
    counts = land(v.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("c")), "values")
    large = land(counts.groupBy(*keys).agg(F.sum("c").alias("n")).filter(F.col("n") > cell).select(*keys), "large")
    if large.isEmpty():
        return _in_one_window(counts, keys, probs)
    whole = _in_one_window(counts.join(large, keys, "left_anti"), keys, probs)
    return whole.unionByName(_in_many_parts(counts.join(large, keys, "left_semi"), keys, probs))


def _in_one_window(counts: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    group = Window.partitionBy(*keys)
    upto = group.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"before": F.sum("c").over(upto) - F.col("c"), "n": F.sum("c").over(group)})
    return _picked(ranked, keys, probs)


def _in_many_parts(counts: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    dealt = land(counts.repartitionByRange(*keys, "x").withColumn("part", F.spark_partition_id()), "dealt")
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    parts = (dealt.groupBy(*keys, "part").agg(F.sum("c").alias("c"))
             .withColumn("before", F.sum("c").over(upto) - F.col("c")).withColumn("n", F.sum("c").over(whole))
             .filter(_wanted(probs)).select(*keys, "part", "n", F.col("before").alias("base")))
    inside = Window.partitionBy(*keys, "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return _picked(dealt.join(parts, [*keys, "part"]).withColumn(
        "before", F.col("base") + F.sum("c").over(inside) - F.col("c")), keys, probs)


def _picked(ranked: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """Quantiles from ranked values (``before``: rows of the group below, ``n``: all its rows)."""
    n = F.col("n")
    stats = []
    for p in probs:
        stats.append(F.max(F.when(_holds(_rank_low(p, n)), F.col("x"))).alias(f"lo_{_name(p)}"))
        stats.append(F.max(F.when(_holds(_rank_high(p, n)), F.col("x"))).alias(f"hi_{_name(p)}"))
    return _finish(ranked.filter(_wanted(probs)).groupBy(*keys).agg(F.max("n").alias("n"), *stats), keys, probs)


def _finish(stats: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    return stats.select(*keys, "n", *[_interpolate(p).alias(f"q_{_name(p)}") for p in probs])


def edges(probs: Sequence[float]) -> Column:
    """The quantile columns of :func:`exact_quantiles` as one array."""
    return F.array(*[F.col(f"q_{_name(p)}") for p in probs])


def quantile_col(p: float) -> Column:
    return F.col(f"q_{_name(p)}")
