"""Long-short factors as weighted sums of portfolio returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortfolio.functions.sums import exact_sum
from sortfolio.operators.align import SERIES, series_calendar
from sortfolio.operators.returns import completeness_check, wavg_market_return
from sortfolio.plans.config import (
    FIVE_CODES, LABELS2, LABELS3, PAIR_CODES_2, PAIR_CODES_3, five_way_weights, pair_weights,
)

FACTOR_KEYS = [*SERIES, "bp"]
FACTOR_COLUMNS = ["Mkt-RF", "SMB", "HML", "CMA", "RMW", "XMY"]


def _weighted(weights: dict[str, float]) -> Column:
    """Weight times return; missing for portfolios outside the factor."""
    by_weight: dict[float, list[str]] = {}
    for code, w in weights.items():
        by_weight.setdefault(w, []).append(code)
    value = F.lit(None).cast("double")
    for w, codes in by_weight.items():
        value = F.when(F.col("ptf_code").isin(codes), F.col("vwret") * w).otherwise(value)
    return value


def _spread_sums(ptfs: DataFrame, weights: dict[str, dict[str, float]], keys: list[str]) -> DataFrame:
    """Sums of weight times return; portfolios outside the factor and missing returns count as 0."""
    parts = ptfs.select(*keys, "jdate", *[_weighted(w).alias(f) for f, w in weights.items()])
    return parts.groupBy(*keys, "jdate").agg(*[F.coalesce(exact_sum(F.col(f)), F.lit(0.0)).alias(f) for f in weights])


def linear_spreads(ptfs: DataFrame, benchmark: DataFrame, weights: dict[str, dict[str, float]],
                   keys: list[str] = FACTOR_KEYS) -> DataFrame:
    """One column per factor for every published month and series; months without data are 0."""
    return (series_calendar(ptfs.select(*keys).distinct(), benchmark)
            .join(_spread_sums(ptfs, weights, keys), [*keys, "jdate"], "left").fillna(0.0, list(weights)))


def _pick(ptfs: DataFrame, benchmark: DataFrame, labels: dict, names: list[str]) -> DataFrame:
    weights = pair_weights(labels)
    return linear_spreads(ptfs, benchmark, {f: weights[f] for f in names})


def hml_2x3(ptfs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return _pick(ptfs, benchmark, LABELS3, ["HML"])


def cma_2x3(ptfs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return _pick(ptfs, benchmark, LABELS3, ["CMA"])


def rmw_2x3(ptfs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return _pick(ptfs, benchmark, LABELS3, ["RMW"])


def xmy_2x3(ptfs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return _pick(ptfs, benchmark, LABELS3, ["XMY"])


def smb_parts_2x3(ptfs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return _pick(ptfs, benchmark, LABELS3, ["SMB_BM", "SMB_INV", "SMB_OP", "SMB_NF"])


def smb_2x3(ptfs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return _pick(ptfs, benchmark, LABELS3, ["SMB"])


def hml_cma_rmw_xmy_2x2(ptfs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return _pick(ptfs, benchmark, LABELS2, ["HML", "CMA", "RMW", "XMY"])


def smb_2x2(ptfs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return _pick(ptfs, benchmark, LABELS2, ["SMB"])


def factors_2x2x2x2x2(ptfs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return linear_spreads(ptfs, benchmark, five_way_weights())


def factor_table(ptfs: DataFrame, cube: DataFrame, benchmark: DataFrame, kind: str) -> DataFrame:
    """Market and the five long-short factors for every complete series."""
    codes, weights = {
        "2x3": (PAIR_CODES_3, pair_weights(LABELS3)),
        "2x2": (PAIR_CODES_2, pair_weights(LABELS2)),
        "2x2x2x2x2": (FIVE_CODES, five_way_weights()),
    }[kind]
    weights = {f: weights[f] for f in FACTOR_COLUMNS[1:]}
    complete = completeness_check(ptfs, len(codes), FACTOR_KEYS)
    rf = benchmark.select(F.col("date").alias("jdate"), "RF")
    return (series_calendar(complete, benchmark)
            .join(_spread_sums(ptfs, weights, FACTOR_KEYS), [*FACTOR_KEYS, "jdate"], "left").fillna(0.0, list(weights))
            .join(wavg_market_return(cube), [*SERIES, "jdate"], "left").join(rf, "jdate")
            .withColumn("Mkt-RF", F.col("Mkt") - F.col("RF"))
            .select(F.col("jdate").alias("date"), *FACTOR_COLUMNS, *FACTOR_KEYS))
