"""Published portfolio tables in long form with the codes of the replicated portfolios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def code_replacements(n_size: int, n_other: int) -> list[tuple[str, str]]:
    """Fixed renamings of published column names, applied in order."""
    return [
        ("SMALL", "ME1"), ("BIG", f"ME{n_size}"),
        ("LoBM", "BM1"), ("HiBM", f"BM{n_other}"),
        ("LoINV", "INV1"), ("HiINV", f"INV{n_other}"),
        ("LoOP", "OP1"), ("HiOP", f"OP{n_other}"),
        (" ", "_"), ("ME", "size"), ("BM", "bm"), ("INV", "inv"), ("OP", "op"),
    ]


def normalise_portfolio_codes(df: DataFrame, n_size: int, n_other: int) -> DataFrame:
    code = F.col("ptf_code")
    for old, new in code_replacements(n_size, n_other):
        code = F.replace(code, F.lit(old), F.lit(new))
    return df.withColumn("ptf_code", code)


def benchmark_long(tables: dict[str, DataFrame]) -> DataFrame:
    """Wide published tables (date and one column per portfolio) by sort, as (date, ptf_code, ret, sort_on)."""
    parts = [
        wide.unpivot(["date"], [F.col(f"`{c}`") for c in wide.columns if c != "date"], "ptf_code", "ret")
        .withColumn("sort_on", F.lit(sort_on))
        for sort_on, wide in tables.items()]
    return reduce(DataFrame.unionByName, parts)
