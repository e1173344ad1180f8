"""The registered queries that SQL can express, against that SQL."""

from __future__ import annotations

import duckdb
import pytest

from sortfolio.llm import queries


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_agrees_with_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want), key=str)
    assert len(want) > 0


def test_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
