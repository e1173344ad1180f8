"""Construction of the June panel: hand-made cases and plain Python."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sortfolio.operators import accounting, annual, firms, intervals, links
from sortfolio.plans import panel
from tests.conftest import day


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def month_end(year: int, month: int) -> dt.date:
    return dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)


# --- dated joins ------------------------------------------------------------------------------

POINTS, INTERVALS = "permno BIGINT, date DATE, n INT", "permno BIGINT, gvkey BIGINT, begin DATE, until DATE"


def joined(spark, points, spans, how="inner"):
    p, i = spark.createDataFrame(points, POINTS), spark.createDataFrame(spans, INTERVALS)
    return intervals.dated_join(p, i, ["permno"], "date", "begin", "until", how)


def test_dated_join_with_open_overlapping_and_empty_intervals(spark):
    points = [(1, day("2000-06-30"), 0), (1, day("1999-12-31"), 1), (1, day("2030-01-01"), 2), (2, day("2000-06-30"), 3), (None, day("2000-06-30"), 4),
              (1, None, 5), (1, day("2000-06-30"), 6)]
    spans = [(1, 10, day("2000-01-01"), day("2000-06-30")), (1, 11, day("2000-06-30"), None), (1, 12, None, day("1999-12-31")), (1, 13, None, None),
             (1, 14, day("2001-01-01"), day("2000-01-01")), (1, 15, day("1900-01-01"), day("1900-12-31")), (None, 16, None, None), (3, 17, None, None),
             (1, 10, day("2000-01-01"), day("2000-06-30")), (2, 18, day("2000-07-01"), None)]
    got = Counter((r.n, r.gvkey) for r in joined(spark, points, spans).collect())
    assert got == Counter({(0, 10): 2, (6, 10): 2, (0, 11): 1, (6, 11): 1, (2, 11): 1, (1, 12): 1, (0, 13): 1, (1, 13): 1, (2, 13): 1, (6, 13): 1})
    left = Counter((r.n, r.gvkey) for r in joined(spark, points, spans, "left").collect())
    assert left == got + Counter({(3, None): 1, (4, None): 1, (5, None): 1})


def test_dated_join_equals_brute_force(spark):
    r = random.Random(3)
    some = lambda: dt.date(1995, 1, 1) + dt.timedelta(r.randrange(3000))
    points = [(r.randrange(5), some(), k) for k in range(200)]
    spans = [(r.randrange(5), k, some() if r.random() < 0.8 else None, some() if r.random() < 0.8 else None) for k in range(60)]
    want = Counter((n, g) for p, d, n in points for q, g, b, e in spans if p == q and (b is None or b <= d) and (e is None or d <= e))
    assert Counter((x.n, x.gvkey) for x in joined(spark, points, spans).collect()) == want and sum(want.values()) > 100


def test_dated_join_is_an_equi_join_and_empty_tables_work(spark):
    text = plan(joined(spark, [(1, day("2000-01-01"), 1)], [(1, 2, None, None)]))
    assert "NestedLoop" not in text and "Cartesian" not in text
    for how, n in (("inner", 0), ("left", 1)):
        assert joined(spark, [], [(1, 2, None, None)], how).count() == 0
        assert joined(spark, [(1, day("2000-01-01"), 1)], [], how).count() == n
    with pytest.raises(ValueError, match="both sides"):
        intervals.dated_join(spark.createDataFrame([], "k INT, d DATE, x INT"), spark.createDataFrame([], "k INT, x INT, b DATE, e DATE"), ["k"], "d", "b", "e")


SEEN = "permno BIGINT, seen DATE, me DOUBLE"


def last_seen(points, history, max_days, strict):
    out = []
    for p, d, n in points:
        best = [(s, m) for q, s, m in history if p is not None and q == p and s is not None and d is not None and (s < d if strict else s <= d)
                and (max_days is None or (d - s).days <= max_days)]
        s, m = max(best, key=lambda x: (x[0], -1 if x[1] is None else x[1]), default=(None, None))
        out.append((n, s, m))
    return sorted(out)


@pytest.mark.parametrize("max_days", [None, 0, 1, 31, 400])
@pytest.mark.parametrize("strict", [False, True])
def test_as_of_equals_brute_force(spark, max_days, strict):
    r = random.Random(8)
    some = lambda: dt.date(1969, 6, 1) + dt.timedelta(r.randrange(1200))
    points = [(r.choice([1, 2, 3, None]), some() if r.random() < 0.95 else None, k) for k in range(150)]
    history = [(r.choice([1, 1, 1, 2, 4, None]), some() if r.random() < 0.95 else None, float(r.randrange(9)) if r.random() < 0.9 else None) for _ in range(300)]
    history += [(1, d, 5.5) for _, d, _ in points[:40] if d] * 2  # equal dates and repeated rows
    got = intervals.as_of(spark.createDataFrame(points, POINTS), spark.createDataFrame(history, SEEN), ["permno"], "date", "seen", max_days, strict)
    assert sorted((x.n, x.seen, x.me) for x in got.collect()) == last_seen(points, history, max_days, strict)
    assert got.columns == ["permno", "date", "n", "seen", "me"]


def test_as_of_shuffles_once_and_deals_out_a_long_history(spark):
    p, h = spark.createDataFrame([(1, day("2000-01-31"), 1)], POINTS), spark.createDataFrame([(1, day("2000-01-30"), 1.0)], SEEN)
    got = intervals.as_of(p, h, ["permno"], "date", "seen", 31)
    assert plan(got).count("Exchange hashpartitioning") == 1 and "__part" in plan(got).split("Exchange hashpartitioning")[1][:60]
    assert intervals.as_of(p.limit(0), h, ["permno"], "date", "seen").count() == 0
    assert [r.me for r in intervals.as_of(p, h.limit(0), ["permno"], "date", "seen").collect()] == [None]


# --- firms ------------------------------------------------------------------------------------

CLASSES = "permco BIGINT, permno BIGINT, date DATE, me DOUBLE, years INT, shrcd INT"


def test_firm_equity_goes_to_one_class_and_is_conserved(spark):
    d = day("2000-06-30")
    rows = [(1, 1, d, 5.0, 2, 10), (1, 2, d, 7.0, 1, 12), (1, 3, d, None, 9, 11), (2, 4, d, 3.0, 1, 10), (2, 5, d, 3.0, 4, 11), (2, 6, d, 3.0, None, 11),
            (3, 7, d, None, 1, 10), (None, 8, d, 1.0, 1, 10), (None, 9, d, 2.0, 1, 10), (4, 10, d, 2.0, 1, 10), (4, 11, d, 2.0, 1, 10)]
    df = spark.createDataFrame(rows, CLASSES)
    got = {(r.permco, r.permno): (r.me, r.class_me, r.n_classes, r.shrcd) for r in firms.firm_market_equity(df, years="years", carry=("shrcd",)).collect()}
    drawn = next(p for c, p in got if c == 4)
    assert got == {(1, 2): (12.0, 7.0, 3, 12), (2, 5): (9.0, 3.0, 3, 11), (3, 7): (None, None, 1, 10), (None, 8): (1.0, 1.0, 1, 10),
                   (None, 9): (2.0, 2.0, 1, 10), (4, drawn): (4.0, 2.0, 2, 10)}
    assert sum(v[0] or 0 for v in got.values()) == sum(r[3] or 0 for r in rows)
    text = plan(firms.firm_market_equity(df, years="years"))
    assert text.count("Exchange hashpartitioning") == 1 and "Window" not in text and "partial_max_by" in text
    assert firms.firm_market_equity(df.limit(0)).count() == 0


def test_the_draw_depends_on_the_key_alone(spark):
    rows = [(1, p, day("2000-06-30"), 1.0, 1, 10) for p in range(40)]
    pick = lambda x, key="firm": firms.firm_market_equity(spark.createDataFrame(x, CLASSES).repartition(5), key=key).first().permno
    assert pick(rows) == pick(rows[::-1]) and len({pick(rows, k) for k in "abcdefgh"}) > 1


def test_market_equity_takes_quotes_as_prices(spark):
    df = spark.createDataFrame([(-2.0, 3.0), (2.0, None), (float("nan"), 1.0)], "prc DOUBLE, shrout DOUBLE")
    assert [r.me for r in firms.market_equity(df).collect()] == [6.0, None, None]


# --- links ------------------------------------------------------------------------------------

LINKS = "gvkey BIGINT, permno BIGINT, date DATE, prim BOOLEAN, age INT"


def matched(rows):
    """The greedy matching in the order of the rules, one row after the other."""
    small = lambda x: (x is not None, x if x is not None else 0)
    rank = lambda x: (small(x[3]), small(x[4]), x[0], x[1])
    best = {}
    for x in rows:
        key = x[:3]
        if None not in key and (key not in best or rank(x) > rank(best[key])):
            best[key] = x
    taken, out = set(), set()
    for x in sorted(best.values(), key=rank, reverse=True):
        sides = {("g", x[0], x[2]), ("p", x[1], x[2])}
        if not sides & taken:
            taken |= sides
            out.add(x[:3])
    return out


def judged(spark, rows, n=3):
    df = spark.createDataFrame(rows, LINKS).repartition(n)
    return links.resolve_links(df, {"primary": F.col("prim"), "age": F.col("age")})


def test_links_become_one_to_one_in_the_order_of_the_rules(spark):
    d, e = day("2000-06-30"), day("2001-06-30")
    rows = [(1, 1, d, True, 1), (1, 2, d, False, 9), (2, 2, d, False, 3), (3, 2, d, None, 9), (3, 3, d, None, None), (1, 1, e, False, 1), (2, 1, e, False, 5),
            (2, 1, e, False, 5), (5, None, d, True, 1), (None, 5, d, True, 1), (6, 6, None, True, 1), (8, 8, d, True, 1), (9, 8, d, True, 1)]
    got = judged(spark, rows).collect()
    assert {(r.gvkey, r.permno, r.date) for r in got if r.rule is None} == matched(rows)
    assert len(got) == len(rows)
    rules = Counter((r.gvkey, r.permno, r.date, r.rule) for r in got)
    assert rules[1, 2, d, "primary"] and rules[3, 2, d, "primary"] and rules[1, 1, e, "age"] and rules[2, 1, e, "repeated"] and rules[8, 8, d, "order"]
    assert {r.n for r in links.link_drop_counts(judged(spark, rows)).collect() if r.rule == "missing"} == {3}


def test_links_over_many_rounds_whatever_the_order(spark):
    d = day("2000-06-30")
    chain = [(k // 2, (k + 1) // 2, d, None, k) for k in range(30)]  # every row waits for the next one
    r = random.Random(5)
    dense = [(r.randrange(12), r.randrange(12), month_end(2000, 1 + k % 3), r.choice([True, False, None]), r.choice([1, 2, None])) for k in range(300)]
    for rows in (chain, dense):
        want = matched(rows)
        for n in (1, 4):
            r.shuffle(rows)
            got = judged(spark, rows, n).collect()
            assert {(x.gvkey, x.permno, x.date) for x in got if x.rule is None} == want and len(got) == len(rows)
    assert links.kept_links(judged(spark, [])).count() == 0


# --- annual accounts --------------------------------------------------------------------------

ACCOUNTS = "gvkey BIGINT, datadate DATE, at DOUBLE"


def test_last_record_of_a_year_and_changed_fiscal_years(spark):
    """Two records in a year, a skipped year, a fifteen-month year, repeated ends."""
    rows = [(1, month_end(1999, 12), 1.0), (1, month_end(2000, 6), 2.0), (1, month_end(2000, 12), 3.0), (1, month_end(2002, 12), 4.0),
            (1, month_end(2004, 3), 5.0), (2, month_end(2000, 12), 1.0), (2, month_end(2000, 12), 2.0), (2, month_end(2000, 12), None),
            (None, month_end(2000, 12), 1.0), (3, None, 1.0)]
    got = {(r.gvkey, r.cal_year): (r.at, r.months, r.changed, r.n_records)
           for r in annual.last_annual_record(spark.createDataFrame(rows, ACCOUNTS).repartition(4)).collect()}
    assert got == {(1, 1999): (1.0, None, None, 1), (1, 2000): (3.0, 6, True, 2), (1, 2002): (4.0, 24, False, 1), (1, 2004): (5.0, 15, True, 1),
                   (2, 2000): (2.0, None, None, 1)}
    text = plan(annual.years_on_file(annual.last_annual_record(spark.createDataFrame(rows, ACCOUNTS))))
    assert annual.last_annual_record(spark.createDataFrame([], ACCOUNTS)).count() == 0
    assert plan(annual.last_annual_record(spark.createDataFrame(rows, ACCOUNTS))).count("Exchange hashpartitioning") == 1 and text


def test_years_on_file_equal_a_count(spark):
    r = random.Random(6)
    rows = [(r.randrange(8), r.choice([None, *range(1990, 2005)])) for _ in range(90)] + [(None, 1999), (None, 1999)]
    got = Counter((x.gvkey, x.cal_year, x.years_on_file, x.run_years, x.restarts)
                  for x in annual.years_on_file(spark.createDataFrame(rows, "gvkey BIGINT, cal_year INT")).collect())
    on_file = defaultdict(set)
    for g, y in rows:
        on_file[g].add(y)
    want = Counter()
    for g, y in rows:
        if g is None or y is None:
            want[g, y, None, None, None] += 1
            continue
        run = 1
        while y - run in on_file[g]:
            run += 1
        past = sorted(x for x in on_file[g] if x is not None and x <= y)
        want[g, y, len(past), run, sum(b > a + 1 for a, b in zip(past, past[1:]))] += 1
    assert got == want
    assert annual.seasoned(annual.years_on_file(spark.createDataFrame([(1, 2000), (1, 2001), (1, 2003)], "gvkey BIGINT, cal_year INT")),
                           by="run_years").select("cal_year").first()[0] == 2001
    assert annual.years_on_file(spark.createDataFrame([], "gvkey BIGINT, cal_year INT")).count() == 0


def test_growth_over_a_gap_is_missing(spark):
    rows = [(1, 2000, 2.0), (1, 2001, 3.0), (1, 2003, 9.0), (1, 2004, 0.0), (1, 2005, 4.0), (2, 2001, 5.0), (None, 2001, 1.0), (None, 2000, 1.0),
            (3, None, 1.0), (3, 2000, 2.0), (1, 2006, None)]
    got = {(r.gvkey, r.cal_year): r.inv for r in annual.growth(spark.createDataFrame(rows, "gvkey BIGINT, cal_year INT, at DOUBLE"), "at", "inv").collect()}
    assert got == {(1, 2000): None, (1, 2001): 0.5, (1, 2003): None, (1, 2004): -1.0, (1, 2005): None, (2, 2001): None, (None, 2001): None,
                   (None, 2000): None, (3, None): None, (3, 2000): None, (1, 2006): None}


# --- accounting items -------------------------------------------------------------------------

ITEMS = ["pstkrv", "pstkl", "pstk", "txditc", "seq", "ceq", "at", "lt"]


def plain_book_equity(x: dict) -> tuple:
    first = lambda *named: next(((v, n) for n, v in named if v is not None), (None, "none"))
    both = lambda a, b, s: None if a is None or b is None else a + s * b
    preferred, by = first(("redemption", x["pstkrv"]), ("liquidation", x["pstkl"]), ("par", x["pstk"]))
    equity, eq_by = first(("reported", x["seq"]), ("common", both(x["ceq"], x["pstk"], 1)), ("assets", both(x["at"], x["lt"], -1)))
    be = None if equity is None else equity + (x["txditc"] or 0) - (preferred or 0)
    return be, "none" if be is None else "book", preferred or 0.0, by, equity, eq_by, x["txditc"] or 0.0


def test_book_equity_reaches_every_branch(spark):
    """All ways to be there or not; NaN is missing."""
    rows = []
    for mask in range(256):
        rows.append(tuple(float(2 ** i) if mask >> i & 1 else (float("nan") if (mask + i) % 5 == 0 else None) for i in range(8)))
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "n INT, " + ", ".join(f"{c} DOUBLE" for c in ITEMS))
    out = accounting.book_equity(df)
    got = {r.n: (r.be, r.be_branch, r.preferred, r.preferred_branch, r.equity, r.equity_branch, r.deferred) for r in out.collect()}
    for k, x in enumerate(rows):
        assert got[k] == plain_book_equity({c: None if v is None or v != v else v for c, v in zip(ITEMS, x)})
    assert {g[5] for g in got.values()} == {"reported", "common", "assets", "none"} and {g[3] for g in got.values()} == {"redemption", "liquidation", "par", "none"}
    assert plan(accounting.book_equity(spark.range(9).selectExpr("id AS n", *[f"rand() AS {c}" for c in ITEMS]))).count("Project [") == 2
    assert plan(out).count("Project [") == 1


def test_fallback_tables_are_checked(spark):
    df = spark.createDataFrame([(1, 2)], "a INT, b INT")
    item = accounting.Item
    branch = accounting.Branch
    two = accounting.with_items(df, [item("y", (branch("x", ("x", "b")),)), item("x", (branch("sum", ("a",), ("b",)),))]).first()
    assert (two.x, two.y, two.y_branch) == (-1.0, 1.0, "x")
    for bad in ([item("x", (branch("y", ("y",)),)), item("y", (branch("x", ("x",)),))], [item("x", (branch("z", ("z",)),))], [item("a", (branch("b", ("b",)),))],
                [item("x", (branch("a", ("a",)),))] * 2):
        with pytest.raises(ValueError):
            accounting.with_items(df, bad)


def test_operating_profitability_needs_revenues_and_an_expense(spark):
    rows = [(10.0, 1.0, None, 2.0, 2.0, 1.5), (10.0, None, None, None, 2.0, None), (None, 1.0, None, None, 2.0, None), (10.0, 4.0, None, None, 3.0, None),
            (10.0, 4.0, None, None, 0.0, 0.0), (10.0, float("nan"), 1.0, None, None, 1.0)]
    df = spark.createDataFrame(rows, "revt DOUBLE, cogs DOUBLE, xsga DOUBLE, xint DOUBLE, be DOUBLE, mib DOUBLE")
    assert [r.op for r in accounting.operating_profitability(df).collect()] == [2.0, None, None, 2.0, None, None]


# --- the whole panel --------------------------------------------------------------------------

def test_panel_of_two_firms(spark):
    """A firm with two classes, of which the larger is no common share; a firm with one account too young; a stale December."""
    june, december = month_end(2002, 6), month_end(2001, 12)
    securities = [(1, 100, june, -10.0, 2.0, 1, 10), (1, 100, december, 10.0, 1.0, 1, 10), (2, 100, december, 4.0, 1.0, 1, 12), (2, 100, june, 3.0, 1.0, 1, 12),
                  (3, None, june, 5.0, 1.0, 3, 11), (3, None, month_end(2001, 11), 6.0, 1.0, 3, 11), (4, 400, june, 5.0, 1.0, 4, 11), (5, 500, june, 5.0, 1.0, 2, 11)]
    items = dict(seq=8.0, ceq=None, pstk=1.0, at=10.0, lt=2.0, txditc=None, pstkrv=None, pstkl=None, mib=None, revt=9.0, cogs=1.0, xsga=None, xint=None)
    accounts = [(g, month_end(y, 12), *(items | {"at": 10.0 * (y - 1999)}).values()) for g in (7, 8, 9, 10) for y in (2000, 2001) if not (g == 10 and y == 2000)]
    held = [(7, 1, "P", None, None), (11, 1, "C", None, None), (8, 3, "C", day("2000-01-01"), None), (9, 4, "P", None, None), (10, 5, "P", None, None)]
    raw = panel.Raw(
        spark.createDataFrame(securities, "permno BIGINT, permco BIGINT, date DATE, prc DOUBLE, shrout DOUBLE, exchcd INT, shrcd INT"),
        spark.createDataFrame(accounts, "gvkey BIGINT, datadate DATE, " + ", ".join(f"{c} DOUBLE" for c in items)),
        spark.createDataFrame(held, "gvkey BIGINT, permno BIGINT, linkprim STRING, linkdt DATE, linkenddt DATE"))
    got = {r.permno: r for r in panel.june_panel(raw).collect()}
    assert set(got) == {1, 3}
    one, three = got[1], got[3]
    assert (one.me, one.dec_me, one.be, one.beme, one.inv, one.n_classes, one.gvkey, one.years_on_file) == (23.0, 14.0, 7.0, 0.5, 1.0, 2, 7, 2)
    assert one.op == pytest.approx(8 / 7) and one.jdate == june and one.prc == -10.0
    assert (three.me, three.dec_me, three.beme) == (5.0, None, None)
    assert {r.permno: r.dec_me for r in panel.june_panel(raw, max_days=40).collect()}[3] == 6.0
    empty = panel.Raw(raw.securities.limit(0), raw.accounts.limit(0), raw.links.limit(0))
    assert panel.june_panel(empty).count() == 0
