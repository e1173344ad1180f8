"""Quantiles read the rows once, on hand-made rows."""

from __future__ import annotations

import pytest

from sortfolio.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("cell", [2, 100])
def test_quantiles_read_the_rows_once(spark, tmp_path, cell):
    """Sizes, small groups and large groups each went over the rows again, with all that makes them."""
    rows = [("a", float(x)) for x in (3, 1, 2, 2)] + [("b", 5.0), ("b", None)]
    spark.createDataFrame(rows, "g STRING, x DOUBLE").write.parquet(f"{tmp_path}/given")
    got = exact_quantiles(spark.read.parquet(f"{tmp_path}/given"), ["g"], "x", [0.0, 0.5, 1.0], cell)
    assert "/given" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [("a", 4, 1.0, 2.0, 3.0), ("b", 1, 5.0, 5.0, 5.0)]
