"""Hand-made panels, one per rule of the method."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from sortfolio.functions.columns import ntile_bucket, percent, three_way
from sortfolio.operators import align, assign, breakpoints, factors, returns, universe
from sortfolio.plans import config
from tests.conftest import day

NAN, INF = float("nan"), float("inf")
LABELS = config.LABELS3["bm"]


def labels(spark, rows):
    df = spark.createDataFrame(rows, "flag INT, x DOUBLE, lo DOUBLE, hi DOUBLE")
    return [r[0] for r in df.select(three_way(F.col("flag"), F.col("x"), F.col("lo"), F.col("hi"), LABELS)).collect()]


def test_three_way_edges(spark):
    rows = [(1, 1.0, 1.0, 2.0), (1, 1.5, 1.0, 2.0), (1, 2.0, 1.0, 2.0), (1, 3.0, 1.0, 2.0),
            (0, 0.5, 1.0, 2.0), (1, None, 1.0, 2.0), (1, 1.5, 1.0, None), (1, 1.0, 1.0, None), (1, 1.0, None, None)]
    assert labels(spark, rows) == ["L", "N", "H", "H", None, None, "H", "L", None]


def test_ntile_is_right_closed_and_guards_missing_edges(spark):
    df = spark.createDataFrame(
        [(1.0, [1.0, 2.0]), (1.5, [1.0, 2.0]), (2.0, [1.0, 2.0]), (9.0, [1.0, 2.0]), (-INF, [1.0, 2.0]), (INF, [1.0, 2.0]),
         (None, [1.0, 2.0]), (1.0, None), (1.0, [1.0, None]), (1.0, [1.0, 1.0]), (2.0, [1.0, 1.0])],
        "x DOUBLE, e ARRAY<DOUBLE>")
    got = [r[0] for r in df.select(ntile_bucket(F.col("x"), F.col("e"), 2)).collect()]
    assert got == [1, 2, 2, 3, 1, 3, None, None, None, 1, 3]


def test_percent_rounds_half_even(spark):
    df = spark.createDataFrame([(1, 8), (25, 200000), (35, 200000), (1, 0)], "a BIGINT, b BIGINT")
    got = [r[0] for r in df.select(percent(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 12.5 and got[1] == pytest.approx(0.01) and got[2] == pytest.approx(0.02) and got[3] is None


def test_epsilon_separates_small_ties_only(spark):
    df = spark.createDataFrame([([0.07, 0.07, 0.09, 0.09],), ([2e6] * 4,)], "e ARRAY<DOUBLE>")
    small, large = [r[0] for r in df.select(breakpoints.lowered("e", 4)).collect()]
    assert all(a < b for a, b in zip(small, small[1:])) and small[3] == 0.09
    assert large == [2e6] * 4


CHARS = ("permno BIGINT, jdate DATE, exchcd INT, shrcd INT, prc DOUBLE, shrout DOUBLE, me DOUBLE, dec_me DOUBLE, "
         "be DOUBLE, beme DOUBLE, inv DOUBLE, op DOUBLE, revt DOUBLE, cogs DOUBLE, xsga DOUBLE, xint DOUBLE")


def firm(permno, **kw):
    base = dict(permno=permno, jdate=day("2000-06-30"), exchcd=1, shrcd=10, prc=1.0, shrout=1.0, me=1.0, dec_me=1.0,
                be=1.0, beme=1.0, inv=0.1, op=0.1, revt=1.0, cogs=1.0, xsga=None, xint=None)
    base.update(kw)
    return tuple(base.values())


def test_flags_and_universe(spark):
    chars = spark.createDataFrame([
        firm(1), firm(2, shrcd=12), firm(3, me=None), firm(4, be=-1.0), firm(5, cogs=None), firm(6, cogs=None, xint=0.0),
        firm(7, exchcd=3), firm(8, prc=None), firm(9, me=0.0), firm(10, dec_me=None), firm(11, inv=None), firm(12, revt=None),
    ], CHARS)
    flags = {r.permno: (r.is_size_ok, r.is_beme_ok, r.is_inv_ok, r.is_op_ok)
             for r in universe.eligibility_flags(chars).collect()}
    assert flags == {1: (1, 1, 1, 1), 2: (0, 0, 0, 0), 3: (0, 0, 0, 0), 4: (1, 0, 1, 0), 5: (1, 1, 1, 0), 6: (1, 1, 1, 1),
                     7: (1, 1, 1, 1), 8: (1, 1, 1, 1), 9: (0, 0, 0, 0), 10: (1, 0, 1, 1), 11: (1, 1, 0, 1), 12: (1, 1, 1, 0)}
    def ids(df):
        return sorted(r.permno for r in df.collect())
    assert ids(universe.nyse_universe_size(chars)) == [1, 3, 4, 5, 6, 9, 10, 11, 12]
    assert ids(universe.nyse_universe_bm(chars)) == [1, 3, 5, 6, 8, 9, 11, 12]
    assert ids(universe.nyse_universe_inv(chars)) == [1, 3, 4, 5, 6, 8, 9, 10, 12]
    assert ids(universe.nyse_universe_op(chars)) == [1, 3, 6, 8, 9, 10, 11]
    flagged = universe.universe_flags(chars)
    for v in ("size", "bm", "inv", "op"):
        assert ids(flagged.filter(F.col(f"u_{v}"))) == ids(chars.filter(universe.universe_condition(v)))


def test_degenerate_and_single_valued_measures(spark):
    rows = [("f", "zero", day("2000-06-30"), 0.0, True), ("f", "zero", day("2001-06-30"), None, True),
            ("f", "null", day("2000-06-30"), None, True),
            ("f", "good", day("2000-06-30"), 1.0, True), ("f", "good", day("2000-06-30"), 1.0, True),
            ("f", "good", day("2000-06-30"), 2.0, False), ("f", "good", day("2001-06-30"), 1.0, True),
            ("f", "good", day("2001-06-30"), -1.0, True), ("f", "good", day("2001-06-30"), None, True)]
    long = spark.createDataFrame([(*r, 1) for r in rows],
                                 "source_file STRING, measure STRING, jdate DATE, nf DOUBLE, u_nf BOOLEAN, index INT")
    assert {r.measure for r in universe.drop_degenerate_measures(long).collect()} == {"good"}
    kept = universe.min_distinct_guard(long, breakpoints.NF_KEYS).collect()
    assert sorted((r.jdate.year, r.nf) for r in kept) == [(2001, -1.0), (2001, 1.0)]


def test_duplicate_pairs_are_rejected(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "permno BIGINT, jdate STRING")
    with pytest.raises(ValueError, match="more than once"):
        universe.require_unique(df, ["permno", "jdate"], "characteristics")
    universe.require_unique(df.distinct(), ["permno", "jdate"], "characteristics")


DOMAINS = assign.ntile_domains(5, 5)
JUNE = "source_file STRING, measure STRING, permno BIGINT, ffyear INT, sizeport INT, bmport INT, opport INT, invport INT, nfport INT"
RETURNS = "date STRING, permno BIGINT, retadj DOUBLE, wt DOUBLE, ffyear INT, jdate DATE"
BENCH = "date DATE, RF DOUBLE"


def rets(spark, rows):
    return spark.createDataFrame([("", p, r, w, 2000, day(d)) for p, r, w, d in rows], RETURNS)


def test_weights_of_missing_returns_count(spark):
    """The weight of a missing return stays in the denominator; a missing weight contributes nothing."""
    june = spark.createDataFrame([("f", "m", p, 2000, 1, 1, 1, 1, 1) for p in (1, 2, 3)], JUNE)
    monthly = rets(spark, [(1, 0.1, 2.0, "2000-07-31"), (2, None, 2.0, "2000-07-31"), (3, 0.5, None, "2000-07-31")])
    cube = returns.monthly_cube(monthly, june, DOMAINS)
    row = cube.first()
    assert (row.n_rows, row.n_ret, row.n_wt, row.n_both) == (3, 2, 2, 1)
    assert returns.wavg_market_return(cube).first().Mkt == pytest.approx(0.2 / 4.0)


@pytest.mark.parametrize("rows, want", [
    ([(1, 0.1, 1.0), (2, 0.3, -1.0)], None),  # zero total weight
    ([(1, 0.1, None), (2, 0.3, None)], None),  # no weight at all
    ([(1, None, 1.0), (2, None, 3.0)], 0.0),  # weights but no return
])
def test_degenerate_cells(spark, rows, want):
    june = spark.createDataFrame([("f", "m", p, 2000, 1, 1, 1, 1, 1) for p in (1, 2)], JUNE)
    cube = returns.monthly_cube(rets(spark, [(*r, "2000-07-31") for r in rows]), june, DOMAINS)
    assert returns.wavg_market_return(cube).first().Mkt == want


def test_full_grid_and_months_without_data(spark):
    """Every month with any bucket has all 25 cells; empty cells earn minus the risk-free rate."""
    june = spark.createDataFrame([
        ("f", "m", 1, 2000, 1, 1, None, None, None), ("f", "m", 2, 2000, 3, None, None, None, None),
        ("f", "m", 3, 2000, None, None, None, None, None)], JUNE)
    monthly = rets(spark, [(1, 0.1, 1.0, "2000-07-31"), (2, 0.2, 1.0, "2000-08-31"), (3, 0.2, 1.0, "2000-09-30")])
    cube = returns.monthly_cube(monthly, june, DOMAINS)
    sorts = returns.vw_return_sorts(cube, [("size", "bm")], 5, 5)
    by_month = {r["jdate"]: r["count"] for r in sorts.groupBy("jdate").count().collect()}
    assert by_month == {day("2000-07-31"): 25, day("2000-08-31"): 25}
    bench = spark.createDataFrame([(day("2000-07-31"), 0.01), (day("2000-08-31"), 0.02), (day("2000-10-31"), 0.03)], BENCH)
    got = {(r.date, r.ptf_code): r.ret for r in returns.excess_returns(sorts, bench).collect()}
    assert len(got) == 75
    assert got[day("2000-07-31"), "size1_bm1"] == pytest.approx(0.09)
    assert got[day("2000-07-31"), "size5_bm5"] == pytest.approx(-0.01)
    assert got[day("2000-08-31"), "size3_bm1"] == pytest.approx(-0.02)
    assert got[day("2000-10-31"), "size1_bm1"] is None


def test_months_without_returns_in_factors(spark):
    """Published months without data: spreads are 0, the market is missing."""
    vw = spark.createDataFrame(
        [("f", "m", "", day("2000-07-31"), c, 0.01 * i) for i, c in enumerate(config.PAIR_CODES_2)],
        "source_file STRING, measure STRING, bp STRING, jdate DATE, ptf_code STRING, vwret DOUBLE")
    cube = spark.createDataFrame([("f", "m", day("2000-07-31"), 0.5, 2.0)],
                                 "source_file STRING, measure STRING, jdate DATE, retadj_x_wt DOUBLE, wt DOUBLE")
    bench = spark.createDataFrame([(day("2000-07-31"), 0.01), (day("2000-08-31"), 0.02)], BENCH)
    rows = {r.date: r for r in factors.factor_table(vw, cube, bench, "2x2").collect()}
    ret = {c: 0.01 * i for i, c in enumerate(config.PAIR_CODES_2)}
    july = rows[day("2000-07-31")]
    assert july["Mkt-RF"] == pytest.approx(0.24)
    assert july["HML"] == pytest.approx(
        (ret["BH_bmport"] + ret["SH_bmport"]) / 2 - (ret["BL_bmport"] + ret["SL_bmport"]) / 2)
    small, big = [sum(v for c, v in ret.items() if c[0] == s) / 8 for s in "SB"]
    assert july["SMB"] == pytest.approx(small - big)
    august = rows[day("2000-08-31")]
    assert august["Mkt-RF"] is None and [august[f] for f in ("SMB", "HML", "CMA", "RMW", "XMY")] == [0.0] * 5


def test_incomplete_series_is_left_out(spark):
    rows = [("f", "full", "", day("2000-07-31"), c, 0.0) for c in config.PAIR_CODES_2]
    rows += [("f", "short", "", day("2000-07-31"), c, 0.0) for c in config.PAIR_CODES_2[1:]]
    vw = spark.createDataFrame(rows, "source_file STRING, measure STRING, bp STRING, jdate DATE, ptf_code STRING, vwret DOUBLE")
    kept = returns.completeness_check(vw, 16, factors.FACTOR_KEYS).collect()
    assert [r.measure for r in kept] == ["full"]


@pytest.mark.parametrize("weights", [
    config.pair_weights(config.LABELS3), config.pair_weights(config.LABELS2), config.five_way_weights()])
def test_factor_weights_sum_to_zero(weights):
    for name, w in weights.items():
        assert math.fsum(w.values()) == pytest.approx(0, abs=1e-12), name
        assert math.fsum(abs(v) for v in w.values()) == pytest.approx(2), name


def test_codes_and_sets():
    assert len(set(config.PAIR_CODES_3)) == 24 and len(set(config.PAIR_CODES_2)) == 16 and len(set(config.FIVE_CODES)) == 32
    assert [len(config.bivariate_sorts()), len(config.threeway_sorts())] == [10, 6]
    assert config.evaluated_sets(()) == ("30_70",) and config.evaluated_sets(("nf",)) == ("10_90", "20_80", "40_60")
    assert config.set_prob_index("30_70") == (2, 5)


def test_buckets_survive_packing(spark):
    domains = assign.factor_domains(config.MEASURES, False)
    row = {c: list(labels)[i % len(labels)] if i % 4 else None for i, (c, labels) in enumerate(domains.items())}
    june = spark.createDataFrame([("f", "m", 1, 2000, *row.values())], "source_file STRING, measure STRING, permno BIGINT, "
                                 "ffyear INT, " + ", ".join(f"{c} STRING" for c in domains))
    back = returns.unpack_buckets(returns.pack_buckets(june, domains), domains).first()
    assert {c: back[c] for c in domains} == row


def test_compare_portfolios_keeps_published_rows(spark):
    left = spark.createDataFrame([(day("2000-07-31"), "size1_bm1", 0.1, "size_bm")], "date DATE, ptf_code STRING, ret DOUBLE, sort_on STRING")
    right = spark.createDataFrame([(day("2000-07-31"), "size1_bm1", 0.2, "size_bm"), (day("2000-07-31"), "x", 0.3, "size_bm")],
                                  "date DATE, ptf_code STRING, ret DOUBLE, sort_on STRING")
    rows = align.compare_portfolios(left, right).orderBy("ptf_code").collect()
    assert [(r.ret_x, r.ret_y, r.sort_on_x) for r in rows] == [(0.1, 0.2, "size_bm"), (None, 0.3, None)]


def test_packing_of_ten_bins(spark):
    """Widths follow the domains: every label of ten bins, next to a missing bucket, comes back as it was."""
    domains = assign.ntile_domains(5, 10)
    names = list(domains)
    rows = [("f", "m", 1, 2000, *[(i + k) % len(domains[c]) + 1 if (i + k) % 4 else None for k, c in enumerate(names)]) for i in range(12)]
    june = spark.createDataFrame(rows, "source_file STRING, measure STRING, permno BIGINT, ffyear INT, " + ", ".join(f"{c} INT" for c in names))
    back = returns.unpack_buckets(returns.pack_buckets(june, domains), domains).select(*names)
    assert sorted(map(str, back.collect())) == sorted(map(str, june.select(*names).collect()))


def test_packing_refuses_unknown_labels_and_too_many_bits(spark):
    domains = assign.ntile_domains(5, 5)
    names = list(domains)
    june = spark.createDataFrame([("f", "m", 1, 2000, *[6] * len(names))],
                                 "source_file STRING, measure STRING, permno BIGINT, ffyear INT, " + ", ".join(f"{c} INT" for c in names))
    with pytest.raises(Exception, match="has no bucket 6"):
        returns.pack_buckets(june, domains).collect()
    with pytest.raises(ValueError, match="63"):
        returns.cell_layout({f"c{i}": range(1, 256) for i in range(8)})


def test_packing_compiles_to_methods_that_the_jvm_compiles(spark, capsys):
    """The JVM interprets methods of more than 8,000 bytes, which made a packed row many times as dear."""
    domains = assign.ntile_domains(5, 5)
    values = {"size": "me", "bm": "beme", "op": "op", "inv": "inv", "nf": "nf"}
    panel = spark.createDataFrame([], "source_file STRING, measure STRING, permno BIGINT, ffyear INT, "
                                  + ", ".join(f"{c} DOUBLE, {v}_edges ARRAY<DOUBLE>" for v, c in values.items()))
    monthly = spark.createDataFrame([], "permno BIGINT, ffyear INT, jdate DATE, retadj DOUBLE, wt DOUBLE")
    cube = returns.monthly_cube(monthly, assign.assign_ntile(panel, values, 5), domains)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cube.explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:\s*(\d+)", capsys.readouterr().out)]
    print(sizes)
    assert sizes and max(sizes) <= 8000
