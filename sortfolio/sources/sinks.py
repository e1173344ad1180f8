"""Output tables, one folder of CSV (or parquet) parts per measure file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def output_name(prefix: str, robust: Sequence[str] = ()) -> Column:
    """``measures_x`` becomes ``<prefix>x``; the list of alternative-breakpoint measures is appended."""
    suffix = f"_robust({'_'.join(robust)})" if robust else ""
    return F.concat(F.replace(F.col("source_file"), F.lit("measures_"), F.lit(prefix)), F.lit(suffix))


def _write(df: DataFrame, path: str, name: Column, digits: int | None, fmt: str) -> None:
    if digits is not None:
        df = df.withColumns({f.name: F.round(f.name, digits) for f in df.schema.fields
                             if isinstance(f.dataType, T.DoubleType)})
    out = df.withColumn("file", name).drop("source_file")
    # one writer per measure file and range of months; ranges split large files
    order = [c for c in ("date", "jdate") if c in out.columns]
    out.repartitionByRange("file", *order).write.partitionBy("file").mode("overwrite").format(fmt).option(
        "header", "true").save(path)


def write_factors(df: DataFrame, path: str, kind: str, robust: Sequence[str] = (), fmt: str = "csv") -> None:
    digits = 6 if kind == "2x3" else None
    _write(df, path, output_name(f"{kind}_factors_", robust), digits, fmt)


def write_factor_nfirms(df: DataFrame, path: str, kind: str, robust: Sequence[str] = (), fmt: str = "csv") -> None:
    _write(df, path, output_name(f"{kind}_factors_nfirms_", robust), None, fmt)


def _numbered(df: DataFrame) -> DataFrame:
    """The exported measure column is the measure's number in the legend."""
    return df.drop("measure").withColumnRenamed("measure_index", "measure")


def write_portfolios(df: DataFrame, path: str, kind: str, fmt: str = "csv") -> None:
    """``kind`` is ``bivariate`` or ``three_way``."""
    _write(_numbered(df), path, output_name(f"{kind}_sorts_test_portfolios_"), 6, fmt)


def write_portfolio_nfirms(df: DataFrame, path: str, kind: str, fmt: str = "csv") -> None:
    _write(_numbered(df), path, output_name(f"{kind}_sorts_test_portfolios_nfirms_"), 6, fmt)


def write_legend(df: DataFrame, path: str, kind: str, fmt: str = "csv") -> None:
    _write(df, path, output_name(f"measures_legend_{kind}_sorts_test_portfolios_"), None, fmt)
