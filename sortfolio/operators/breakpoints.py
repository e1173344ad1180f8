"""Breakpoints of every measure over the reference universe.

All measures of a panel go through one selection: their universe values are unpivoted into
(file, variable, June, value) rows, so a further measure is a further group, not a further job.
Panels carry the universe conditions as columns (:func:`universe.universe_flags`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortfolio.landing import land
from sortfolio.operators.quantiles import edges, exact_quantiles, quantile_col
from sortfolio.plans.config import (
    EDGE_EPSILON, HALF_PROBS, QUARTILE_PROBS, QUINTILE_PROBS, SET_PROBS, VALUE_COL,
)

CHAR_VARS = ("size", "bm", "inv", "op")


def universe_values(panel: DataFrame, variables: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Long rows (keys, var, x) of the values that set breakpoints."""
    cols = [F.when(F.col(f"u_{v}"), F.col(VALUE_COL[v])).alias(v) for v in variables]
    return (panel.select(*keys, *cols).unpivot(list(keys), list(variables), "var", "x")
            .filter(F.col("x").isNotNull()))


def _in_nf_universe() -> Column:
    return F.col("u_nf") & F.col("nf").isNotNull()


def _wide(long: DataFrame, keys: list[str], names: dict[str, Column]) -> DataFrame:
    """One row per key from (keys, var) rows; ``names`` maps output column to an expression by var."""
    return long.groupBy(*keys).agg(*[F.max(e).alias(c) for c, e in names.items()])


def char_edges(panel: DataFrame, variables: Sequence[str], probs: Sequence[float], keys: list[str]) -> DataFrame:
    """Array column ``<var>_edges`` of each variable per key."""
    q = exact_quantiles(universe_values(panel, variables, keys), keys + ["var"], "x", probs)
    return _wide(q, keys, {f"{v}_edges": F.when(F.col("var") == v, edges(probs)) for v in variables})


def size_median(panel: DataFrame) -> DataFrame:
    return char_edges(panel, ["size"], HALF_PROBS, ["source_file", "jdate"]).select(
        "source_file", "jdate", F.get("size_edges", F.lit(0)).alias("sizemedn"))


def char_breakpoints(panel: DataFrame) -> DataFrame:
    """Percentiles of bm, inv and op for all breakpoint sets."""
    return char_edges(panel, ["bm", "inv", "op"], SET_PROBS, ["source_file", "jdate"])


def char_medians(panel: DataFrame) -> DataFrame:
    wide = char_edges(panel, ["bm", "inv", "op"], HALF_PROBS, ["source_file", "jdate"])
    return wide.select("source_file", "jdate", *[
        F.get(f"{v}_edges", F.lit(0)).alias(f"{v}50") for v in ("bm", "inv", "op")])


NF_KEYS = ["source_file", "measure", "jdate"]


def nf_edges(panel: DataFrame, probs: Sequence[float], keys: list[str] = NF_KEYS) -> DataFrame:
    q = exact_quantiles(panel.filter(_in_nf_universe()), keys, "nf", probs)
    return q.select(*keys, edges(probs).alias("nf_edges"))


def nf_breakpoints(panel: DataFrame) -> DataFrame:
    return nf_edges(panel, SET_PROBS)


def nf_median(panel: DataFrame) -> DataFrame:
    return nf_edges(panel, HALF_PROBS).select(*NF_KEYS, F.get("nf_edges", F.lit(0)).alias("nf50"))


# everything the independent sorts need: the sets, the median, the quintiles, smallest and largest
INDEPENDENT_PROBS = sorted({*SET_PROBS, *HALF_PROBS, *QUINTILE_PROBS, 0.0, 1.0})
DEPENDENT_PROBS = sorted({*QUARTILE_PROBS, 0.0, 1.0})


def all_quantiles(
    panel: DataFrame, long: DataFrame, variables: Sequence[str], keys: list[str], probs: Sequence[float],
) -> DataFrame:
    """Landed quantiles of the characteristics (``measure`` empty) and of all candidates, one selection."""
    chars = universe_values(panel, variables, keys).withColumn("measure", F.lit(""))
    nf = (long.filter(_in_nf_universe())
          .select(*keys, F.lit("nf").alias("var"), F.col("nf").alias("x"), "measure"))
    return land(exact_quantiles(chars.unionByName(nf), ["measure", *keys, "var"], "x", probs), "breakpoints")


def factor_breakpoints(quantiles: DataFrame, two_by_two: bool) -> tuple[DataFrame, DataFrame]:
    """Breakpoints of the factor sorts from :func:`all_quantiles`.

    Returns (file, June) rows with ``sizemedn`` and ``bm/inv/op_edges``, and
    (file, measure, June) rows with ``nf_edges``.
    """
    probs = HALF_PROBS if two_by_two else SET_PROBS
    names = {"sizemedn": F.when(F.col("var") == "size", quantile_col(0.5))}
    names |= {f"{v}_edges": F.when(F.col("var") == v, edges(probs)) for v in ("bm", "inv", "op")}
    nf = quantiles.filter(F.col("var") == "nf").select(*NF_KEYS, edges(probs).alias("nf_edges"))
    return _wide(quantiles.filter(F.col("var") != "nf"), ["source_file", "jdate"], names), nf


def ntile_breakpoints(
    quantiles: DataFrame, variables: Sequence[str], probs: Sequence[float], keys: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Edges of the n-tile sorts from :func:`all_quantiles`; ``keys`` may include the size bucket.

    The candidate edges are lowered by epsilon and exist only for groups with two distinct
    values: the quantiles 0 and 1 differ.
    """
    names = {f"{v}_edges": F.when(F.col("var") == v, edges(probs)) for v in variables}
    nf = (quantiles.filter((F.col("var") == "nf") & (quantile_col(0.0) < quantile_col(1.0)))
          .select("measure", *keys, edges(probs).alias("nf_edges"))
          .withColumn("nf_edges", lowered("nf_edges", len(probs))))
    return _wide(quantiles.filter(F.col("var") != "nf"), keys, names), nf


def quintile_edges(panel: DataFrame) -> DataFrame:
    return char_edges(panel, CHAR_VARS, QUINTILE_PROBS, ["source_file", "jdate"])


def size_half_edges(panel: DataFrame) -> DataFrame:
    return char_edges(panel, ["size"], HALF_PROBS, ["source_file", "jdate"])


def conditional_quartile_edges(sized_panel: DataFrame) -> DataFrame:
    """Quartiles of bm, op and inv inside each size bucket."""
    return char_edges(sized_panel.filter(F.col("sizeport").isNotNull()), ["bm", "op", "inv"],
                      QUARTILE_PROBS, ["source_file", "jdate", "sizeport"])


def lowered(edge_col: str, n_edges: int) -> Column:
    """Edge ``i`` lowered by epsilon times the number of edges above it, so that ties increase."""
    return F.array(*[
        F.get(edge_col, F.lit(i)) - F.lit(EDGE_EPSILON) * (n_edges - 1 - i) for i in range(n_edges)])


def nf_edges_epsilon(panel: DataFrame, probs: Sequence[float], keys: list[str] = NF_KEYS) -> DataFrame:
    return nf_edges(panel, probs, keys).withColumn("nf_edges", lowered("nf_edges", len(probs)))
