"""Every query against the same result in SQL."""

from __future__ import annotations

import pytest

from verification import oracles
from verification.compare import connect, difference
from verification.queries import queries

SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(queries()) == set(SQL)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, sf_dir, con, name):
    got = queries()[name](spark, sf_dir).toPandas()
    assert difference(got, con.execute(SQL[name]).df()) == ""


@pytest.mark.parametrize("p", [0.1, 0.25, 0.3, 0.5, 0.8])
def test_interpolation_agrees_with_the_database(con, p):
    """The hand-written quantile of the oracles is the database's own continuous quantile."""
    text = (f"WITH t AS (SELECT l_partkey % 7 AS g, list(l_extendedprice ORDER BY l_extendedprice) AS xs, "
            f"quantile_cont(l_extendedprice, {p}) AS want FROM lineitem GROUP BY g) "
            f"SELECT max(abs({oracles.q('xs', p)} - want)) FROM t")
    assert con.execute(text).fetchone()[0] < 1e-9
