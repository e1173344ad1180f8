from __future__ import annotations

import pytest

from sortfolio.plans import config
from sortfolio.sources import calendar, codes, sinks, tables, text
from tests.conftest import day

FACTORS = "a\nb\nc\n,Mkt-RF,SMB,HML,RMW,CMA,RF\n" + "".join(
    f"2000{m:02d},  {m}.00, -0.41, 0.10, 0.20, 0.30, 0.05\n" for m in range(1, 13)
) + "200101, 1.0, , 0.1, 0.2, 0.3, 0.05\n200102, 1.0, 1.0, 0.1, 0.2, 0.3, 0.05\n" + (
    "\n Annual Factors: January-December\n,Mkt-RF,SMB,HML,RMW,CMA,RF\n  2000, 10.0, 1.0, 1.0, 1.0, 1.0, 5.0\n")


def test_factor_text(spark, tmp_path):
    path = tmp_path / "factors.csv"
    path.write_text(FACTORS)
    rows = text.parse_benchmark_factors(text.read_lines(spark, str(path))).orderBy("date").collect()
    assert [r.date for r in rows[:2]] == [day("2000-01-31"), day("2000-02-29")]
    assert len(rows) == 12  # the first incomplete month ends the table
    assert rows[2]["Mkt-RF"] == pytest.approx(0.03) and rows[0]["SMB"] == pytest.approx(-0.0041)


def portfolio_text() -> str:
    header = ",SMALL LoBM,ME1 BM2,BIG HiBM\n"
    body = "200001,   1.0000,  2.0000, -99.99\n200002,   3.0000,  4.0000,  5.0000\n"
    other = "200001,   9.0,  9.0,  9.0\n"
    return ("preamble\n\n  Average Equal Weighted Returns -- Annual\n" + header + other + "\n\n"
            + "  Average Value Weighted Returns -- Monthly\n" + header + body + "\n\n"
            + "  Average Equal Weighted Returns -- Monthly\n" + header + other)


@pytest.mark.parametrize("mask", [False, True])
def test_portfolio_text(spark, tmp_path, mask):
    path = tmp_path / "p.csv"
    path.write_text(portfolio_text().replace("\n", "\r\n"))
    parsed = text.parse_benchmark_portfolios(text.read_lines(spark, str(path)), mask_missing=mask)
    got = {(r.date, r.ptf_code): r.ret for r in codes.normalise_portfolio_codes(parsed, 5, 5).collect()}
    assert len(got) == 6
    assert got[day("2000-01-31"), "size1_bm1"] == pytest.approx(0.01)
    assert got[day("2000-02-29"), "size5_bm5"] == pytest.approx(0.05)
    first = got[day("2000-01-31"), "size5_bm5"]
    assert first is None if mask else first == pytest.approx(-0.9999)


def test_code_names_for_both_grids(spark):
    df = spark.createDataFrame([("SMALL LoOP",), ("BIG HiINV",), ("ME1 BM4 OP2",)], "ptf_code STRING")
    def names(n_size, n_other):
        return [r.ptf_code for r in codes.normalise_portfolio_codes(df, n_size, n_other).collect()]
    assert names(5, 5) == ["size1_op1", "size5_inv5", "size1_bm4_op2"]
    assert names(2, 4) == ["size1_op1", "size2_inv4", "size1_bm4_op2"]


def test_csv_numbers_and_stale_flags(spark, tmp_path):
    path = tmp_path / "chars.csv"
    path.write_text("permno,jdate,is_size_ok,exchcd,shrcd,prc,shrout,me,dec_me,be,beme,inv,op,revt,cogs,xsga,xint,extra\n"
                    "1,2000-06-30,1,1,10,1.5,2,nan,,inf,-inf,0.1,0.2,1,2,3,4,x\n")
    df = tables.read_characteristics(spark, str(path))
    assert "is_size_ok" not in df.columns and "extra" not in df.columns
    row = df.first()
    assert row.me is None and row.dec_me is None and row.be == float("inf") and row.beme == float("-inf")


def test_measure_files_with_different_headers(spark, tmp_path):
    (tmp_path / "measures_a.csv").write_text("permno,date,m1,m2\n1,200006,1.0,nan\n2,200006,,inf\n")
    (tmp_path / "measures_b.csv").write_text("permno,date,z\n1,200106,5\n")
    (tmp_path / "measures_c.csv").write_text("permno,date,z\n3,200106,6\n")
    df = tables.read_measures(spark, str(tmp_path / "*.csv"))
    got = {(r.source_file, r.measure, r.permno, r.jdate): r.nf for r in tables.measures_long(df).collect()}
    assert got == {
        ("measures_a", "m1", 1, day("2000-06-30")): 1.0, ("measures_a", "m2", 1, day("2000-06-30")): None,
        ("measures_a", "m1", 2, day("2000-06-30")): None, ("measures_a", "m2", 2, day("2000-06-30")): float("inf"),
        ("measures_b", "z", 1, day("2001-06-30")): 5.0, ("measures_c", "z", 3, day("2001-06-30")): 6.0}


@pytest.mark.parametrize("header", ["permno,date,me", "permno,date,nf", "permno,date,a,A", "permno,a"])
def test_bad_measure_headers(spark, tmp_path, header):
    path = tmp_path / "measures_x.csv"
    path.write_text(header + "\n" + ",".join(["1", "200006", "1", "2"][:header.count(",") + 1]) + "\n")
    with pytest.raises(ValueError):
        tables.read_measures(spark, [str(path)])


def test_calendar(spark):
    bench = spark.createDataFrame([(day(d),) for d in ("2000-06-30", "2000-07-31", "2000-08-31", "2001-07-31")], "date DATE")
    assert sorted(r.jdate for r in calendar.formation_calendar(bench).collect()) == [day("2000-06-30"), day("2001-06-30")]
    rets = spark.createDataFrame([("2000-08-30",), ("2000-07-31",)], "date STRING")
    clipped = calendar.clip_to_returns(bench, rets)
    assert [r.date for r in clipped.orderBy("date").collect()] == [day("2000-06-30"), day("2000-07-31")]
    ptfs = spark.createDataFrame([(day("2000-05-31"),), (day("2000-07-31"),), (day("2000-08-31"),)], "date DATE")
    assert [r.date for r in calendar.clip_to_window(ptfs, clipped).collect()] == [day("2000-07-31")]


def test_output_names_and_digits(spark, tmp_path):
    df = spark.createDataFrame([(day("2000-07-31"), 0.123456789, "measures_a"), (day("2000-07-31"), 0.5, "measures_b")],
                               "date DATE, SMB DOUBLE, source_file STRING")
    out = str(tmp_path / "out")
    sinks.write_factors(df, out, "2x3", ("nf",))
    back = {r.file: r.SMB for r in spark.read.option("header", True).option("inferSchema", True).csv(out).collect()}
    assert back == {"2x3_factors_a_robust(nf)": 0.123457, "2x3_factors_b_robust(nf)": 0.5}
    sinks.write_factors(df, out, "2x2", ())
    back = {r.file: r.SMB for r in spark.read.option("header", True).option("inferSchema", True).csv(out).collect()}
    assert back == {"2x2_factors_a": 0.123456789, "2x2_factors_b": 0.5}


def test_published_tables_long(spark):
    wide = spark.createDataFrame([(day("2000-07-31"), 0.1, None)], "date DATE, `SMALL LoBM` DOUBLE, `ME1 BM2` DOUBLE")
    rows = codes.benchmark_long({"size_bm": wide}).collect()
    assert sorted((r.ptf_code, r.ret, r.sort_on) for r in rows) == [("ME1 BM2", None, "size_bm"), ("SMALL LoBM", 0.1, "size_bm")]


def test_marker_is_the_value_weighted_monthly_block():
    assert config.VW_MONTHLY_MARKER == "Average Value Weighted Returns -- Monthly"


def _parts(folder, orders, rows):
    folder.mkdir()
    for i, names in enumerate(orders):
        lines = [",".join(names)] + [",".join(str(r[n]) for n in names) for r in rows]
        (folder / f"part-{i}.csv").write_text("\n".join(lines) + "\n")
    return str(folder)


@pytest.mark.parametrize("swapped", [False, True])
def test_parts_with_another_column_order_are_never_read_by_position(spark, tmp_path, swapped):
    rows = [{"date": "2000-07-31", "permno": 1, "retadj": 0.2, "wt": 7.0, "ffyear": 2000, "jdate": "2000-07-31"}]
    first = list(tables.RETURNS_FIELDS)
    other = ["date", "permno", "wt", "retadj", "ffyear", "jdate"] if swapped else first
    read = tables.read_returns(spark, _parts(tmp_path / "r", [first, other], rows))
    if swapped:
        with pytest.raises(Exception, match="CSV header"):
            read.collect()
    else:
        assert {(r.retadj, r.wt) for r in read.collect()} == {(0.2, 7.0)}


def test_measure_files_with_several_orders_keep_their_names(spark, tmp_path):
    rows = [{"permno": 1, "date": 200006, "a": 1.5, "b": 2.5}]
    paths = []
    for i, names in enumerate([["permno", "date", "a", "b"], ["date", "b", "a", "permno"]]):
        _parts(tmp_path / f"m{i}", [names], rows)
        paths.append(str(tmp_path / f"m{i}" / "part-0.csv"))
    got = tables.measures_long(tables.read_measures(spark, paths)).collect()
    assert sorted((r.measure, r.nf) for r in got) == [("a", 1.5), ("a", 1.5), ("b", 2.5), ("b", 2.5)]


def test_parquet_folder_without_suffix(spark, tmp_path):
    path = str(tmp_path / "returns_folder")
    row = spark.createDataFrame([("2000-07-31", 1, 0.1, 2.0, 2000, day("2000-07-31"))],
                                "date STRING, permno BIGINT, retadj DOUBLE, wt DOUBLE, ffyear INT, jdate DATE")
    row.write.parquet(path)
    assert tables.read_returns(spark, path).collect() == row.collect()
