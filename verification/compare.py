"""Runs queries and oracles side by side: ``python -m verification.compare <sf_dir> [names...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from sortfolio.session import build_session
from verification import oracles
from verification.queries import queries

TABLES = ["lineitem", "part", "orders"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def text_of(value: object) -> str:
    if value is None or value is pd.NaT or value != value:
        return "<null>"
    return str(value)[:10] if hasattr(value, "year") else str(value)


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, dates and text as text, numbers rounded, rows sorted."""
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].astype(float).round(9) if pd.api.types.is_numeric_dtype(df[c]) else df[c].map(text_of)
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = (~same).idxmax()
            return f"column {c}: {(~same).sum()} values differ, e.g. {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return ""


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    con, sqls, failed = connect(sf_dir), oracles.oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            got = df.toPandas()
            mid = time.time()
            problem = difference(got, con.execute(sqls[name]).df())
        except Exception as e:  # noqa: BLE001 - report and go on
            problem, mid, got = f"{type(e).__name__}: {str(e)[:600]}", time.time(), []
        failed += bool(problem)
        times = f"spark={mid - start:.1f}s sql={time.time() - mid:.1f}s"
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={len(got)} {times} {problem}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
