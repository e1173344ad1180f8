"""Bucket assignment of every stock at its June formation date."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortfolio.functions.columns import ntile_bucket, three_way, two_way
from sortfolio.plans.config import (
    BP_SETS, DEFAULT_SET, FLAG_COL, LABELS2, LABELS3, MEASURES, SIZE_LABELS, SORT_MEASURES, VALUE_COL,
    ntile_port, port, set_prob_index,
)


def assign_size_2(panel: DataFrame) -> DataFrame:
    """Adds ``szport``; needs ``sizemedn`` and the flags."""
    return panel.withColumn(
        "szport", two_way(F.col("is_size_ok"), F.col("me"), F.col("sizemedn"), *SIZE_LABELS))


def assign_2way(panel: DataFrame, measures: Iterable[str]) -> DataFrame:
    """Median split; needs ``<m>_edges`` with the median as first element."""
    return panel.withColumns({
        port(m): two_way(F.col(FLAG_COL[m]), F.col(VALUE_COL[m]), F.get(f"{m}_edges", F.lit(0)), *LABELS2[m])
        for m in measures})


def assign_3way(panel: DataFrame, measures: Iterable[str], bp: str = DEFAULT_SET, suffix: str = "") -> DataFrame:
    """Low/middle/high at one breakpoint set; needs ``<m>_edges`` at all set percentiles."""
    lo, hi = set_prob_index(bp)
    return panel.withColumns({
        port(m) + suffix: three_way(
            F.col(FLAG_COL[m]), F.col(VALUE_COL[m]),
            F.get(f"{m}_edges", F.lit(lo)), F.get(f"{m}_edges", F.lit(hi)), LABELS3[m])
        for m in measures})


def assign_3way_robust(panel: DataFrame, measures: Iterable[str], robust: tuple[str, ...]) -> DataFrame:
    """All breakpoint sets for the robust measures (``<m>port_<lo>_<hi>``), the default for the others."""
    measures = list(measures)
    out = assign_3way(panel, [m for m in measures if m not in robust]) if set(measures) - set(robust) else panel
    for bp in BP_SETS:
        alternative = [m for m in measures if m in robust]
        if alternative:
            out = assign_3way(out, alternative, bp, f"_{bp}")
    return out


def factor_domains(robust: tuple[str, ...], two_by_two: bool) -> dict[str, tuple[str, ...]]:
    """Bucket columns of the factor sorts with their labels."""
    domains = {"szport": SIZE_LABELS}
    for m in MEASURES:
        names = [f"{port(m)}_{bp}" for bp in BP_SETS] if m in robust else [port(m)]
        domains |= {c: LABELS2[m] if two_by_two else LABELS3[m] for c in names}
    return domains


def ntile_domains(n_size: int, n_other: int) -> dict[str, range]:
    return {ntile_port(m): range(1, (n_size if m == "size" else n_other) + 1) for m in ("size", *SORT_MEASURES)}


def assign_ntile(panel: DataFrame, variables: Iterable[str], n: int) -> DataFrame:
    """Right-closed n-tile bins of the given variables, not gated by eligibility."""
    return panel.withColumns({
        ntile_port(v): ntile_bucket(F.col(VALUE_COL[v]), F.col(f"{v}_edges"), n - 1) for v in variables})


def assign_ntile_independent(panel: DataFrame, n: int = 5) -> DataFrame:
    return assign_ntile(panel, ["size", "bm", "op", "inv"], n)


def assign_size_half(panel: DataFrame) -> DataFrame:
    return assign_ntile(panel, ["size"], 2)


def assign_ntile_dependent(panel: DataFrame, n: int = 4) -> DataFrame:
    """Bins of bm, op, inv with the edges of the stock's own size bucket."""
    return assign_ntile(panel, ["bm", "op", "inv"], n)


def assign_nf_ntile(panel: DataFrame, n: int = 5) -> DataFrame:
    """Candidate bins; ``nf_edges`` are the lowered edges of groups that pass the two-value guard."""
    return assign_ntile(panel, ["nf"], n)


def assign_nf_ntile_dependent(panel: DataFrame, n: int = 4) -> DataFrame:
    """Candidate bins with the edges of the stock's own size bucket."""
    return assign_nf_ntile(panel, n)


def june_assignments(panel: DataFrame, buckets: list[str]) -> DataFrame:
    return panel.select("source_file", "measure", "permno", "ffyear", *buckets)
