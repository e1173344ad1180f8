"""The input tables out of hand-made line items."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from verification import fixtures


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory) -> str:
    day, path = dt.date, str(tmp_path_factory.mktemp("lines"))
    rows = [(1, day(1995, 3, 1), 10.0, 100.0, "R"), (1, day(1996, 3, 1), 10.0, 150.0, "N"), (1, day(1998, 3, 1), 10.0, 300.0, None),
            (2, day(1995, 8, 1), 5.0, 40.0, "N"), (2, None, 5.0, 70.0, "R"), (None, day(1995, 3, 1), 1.0, 9.0, "R"), (2, day(1995, 9, 1), 5.0, 40.0, "N")]
    lines = spark.createDataFrame(rows, "l_partkey BIGINT, l_shipdate DATE, l_quantity DOUBLE, l_extendedprice DOUBLE, l_returnflag STRING")
    lines.select("*", F.lit(0.1).alias("l_discount"), F.lit(0.05).alias("l_tax"), F.lit("O").alias("l_linestatus")).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(1, 1, 9.0), (2, 2, 9.0), (2, 3, 9.0)], "p_partkey BIGINT, p_size INT, p_retailprice DOUBLE").write.parquet(f"{path}/part.parquet")
    return path


def test_growth_is_over_the_year_before_only(spark, folder):
    got = {(r.permno, r.jdate and r.jdate.year): (r.me, r.inv) for r in fixtures.chars(spark, folder).filter("permno = 1 OR shrcd = 12").collect()}
    assert got == {(1, 1995): (100.0, None), (1, 1996): (150.0, 0.5), (1, 1998): (300.0, None), (2, 1996): (80.0, None), (2, None): (70.0, None)}
    assert fixtures.chars(spark, folder).filter("permno = 2").count() == 4  # repeated parts repeat rows


def test_measure_files_are_projections_of_the_yearly_rows(spark, folder):
    files = fixtures.wide_measures(spark, folder)
    assert sorted(map(str, files["measures_beta"].collect())) == sorted(
        ["Row(permno=1, date=199506, m4=100.0)", "Row(permno=2, date=None, m4=70.0)", "Row(permno=None, date=199506, m4=9.0)"])
    assert files["measures_alpha"].count() == 6
    assert not any("Exchange" in f._jdf.queryExecution().toString() for f in files.values())
