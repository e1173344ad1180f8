"""SQL of the June panel's construction over the driver's tables, written independently of the Spark code."""

from __future__ import annotations

STALE = 200
ROUNDS = 5
ITEM = {
    "seq": "CASE WHEN u % 3 <> 0 THEN u * 2.0::DOUBLE END", "ceq": "CASE WHEN u % 2 = 0 THEN u * 1.75::DOUBLE END",
    "pstk": "CASE WHEN k % 2 = 0 THEN k * 4.0::DOUBLE END", "at": "CASE WHEN u % 11 <> 0 THEN u * 8.0::DOUBLE END",
    "lt": "CASE WHEN k % 5 <> 0 THEN k * 16.0::DOUBLE END", "txditc": "CASE WHEN u % 5 = 0 THEN u * 0.25::DOUBLE END",
    "pstkrv": "CASE WHEN u % 7 = 0 THEN k * 2.0::DOUBLE END", "pstkl": "CASE WHEN u % 4 = 0 THEN k * 3.0::DOUBLE END",
    "mib": "CASE WHEN k % 4 = 0 THEN k * 0.5::DOUBLE END", "revt": "CASE WHEN u % 13 <> 0 THEN u * 3.0::DOUBLE END",
    "cogs": "CASE WHEN u % 2 = 1 THEN u * 1.25::DOUBLE END", "xsga": "CASE WHEN k % 3 = 0 THEN u * 0.5::DOUBLE END",
    "xint": "CASE WHEN k % 7 = 0 THEN k * 1.0::DOUBLE END"}

CTES: dict[str, str] = {}
CTES["p_li"] = """
  SELECT l_partkey AS permno, CAST(1 + (l_partkey // 2) * 3 + l_suppkey % 3 AS BIGINT) AS gvkey, CAST(l_shipdate AS DATE) AS d,
         CAST(l_quantity AS BIGINT) AS qty, l_extendedprice AS price FROM lineitem"""
CTES["p_sec"] = """
  SELECT permno, CAST(CASE WHEN permno % 41 <> 0 THEN permno // 3 + 1 END AS BIGINT) AS permco, last_day(d) AS date,
         CASE WHEN sum(qty) % 17 <> 0 THEN floor(max(price)) * CASE WHEN permno % 5 = 0 THEN -1 ELSE 1 END END AS prc,
         CAST(sum(qty) AS DOUBLE) AS shrout, CAST(permno % 4 + 1 AS INTEGER) AS exchcd, CAST(permno % 3 + 10 AS INTEGER) AS shrcd
  FROM p_li GROUP BY permno, last_day(d)"""
CTES["p_mon"] = "SELECT *, abs(prc) * shrout AS me, coalesce(permco, -permno) AS firm FROM p_sec"
CTES["p_acc"] = f"""
  SELECT gvkey, datadate, {', '.join(f'{sql} AS "{name}"' for name, sql in ITEM.items())} FROM (
    SELECT gvkey, last_day(max(d)) AS datadate, CAST(sum(qty) AS BIGINT) AS u, count(*) AS k FROM p_li
    GROUP BY gvkey, year(d), CASE WHEN gvkey % 7 = 0 AND month(d) > 6 THEN 1 ELSE 0 END)"""
CTES["p_pair"] = "SELECT permno, gvkey, min(d) AS lo, max(d) AS hi FROM p_li GROUP BY permno, gvkey"
CTES["p_lnk"] = """
  SELECT gvkey, permno, CASE (permno * 7 + gvkey) % 4 WHEN 0 THEN 'P' WHEN 1 THEN 'C' WHEN 2 THEN 'J' END AS linkprim,
         CASE WHEN (permno + gvkey) % 13 <> 0 THEN lo END AS linkdt,
         CASE WHEN (permno + gvkey) % 17 = 0 THEN lo - 1 WHEN (permno + gvkey) % 3 <> 0 THEN hi + 400 END AS linkenddt FROM p_pair
  UNION ALL SELECT gvkey, permno, 'C', lo, hi FROM p_pair WHERE permno % 9 = 0"""
# annual accounts
CTES["p_ann"] = """
  SELECT * FROM (
    SELECT *, year(datadate) AS cal_year, date_diff('month', lag(datadate) OVER w, datadate) AS months,
           month(datadate) <> month(lag(datadate) OVER w) AS changed, count(*) OVER (PARTITION BY gvkey, year(datadate)) AS n_records,
           row_number() OVER (PARTITION BY gvkey, year(datadate) ORDER BY datadate DESC) AS place
    FROM p_acc WINDOW w AS (PARTITION BY gvkey ORDER BY datadate)) WHERE place = 1"""
CTES["p_yof"] = """
  SELECT a.*, (SELECT count(*) FROM p_ann b WHERE b.gvkey = a.gvkey AND b.cal_year <= a.cal_year) AS years_on_file FROM p_ann a"""
# the last year of a firm without a record the year before begins its run
CTES["p_run"] = """
  SELECT gvkey, cal_year, max(CASE WHEN before IS DISTINCT FROM cal_year - 1 THEN cal_year END) OVER w AS begun,
         count(*) FILTER (WHERE before < cal_year - 1) OVER w AS restarts
  FROM (SELECT gvkey, cal_year, lag(cal_year) OVER (PARTITION BY gvkey ORDER BY cal_year) AS before FROM p_ann)
  WINDOW w AS (PARTITION BY gvkey ORDER BY cal_year)"""
_PREFERRED = "coalesce(pstkrv, pstkl, pstk, 0)"
_EQUITY = "coalesce(seq, ceq + pstk, \"at\" - lt)"
CTES["p_be"] = f"""
  SELECT *, {_PREFERRED} AS preferred, coalesce(txditc, 0) AS deferred, {_EQUITY} AS equity, {_EQUITY} + coalesce(txditc, 0) - {_PREFERRED} AS be FROM p_yof"""
CTES["p_year"] = """
  SELECT a.*, CASE WHEN coalesce(a.cogs, a.xsga, a.xint) IS NOT NULL THEN
           (a.revt - (coalesce(a.cogs, 0) + coalesce(a.xsga, 0) + coalesce(a.xint, 0))) / nullif(a.be + coalesce(a.mib, 0), 0) END AS op,
         (a."at" - b."at") / nullif(b."at", 0) AS inv
  FROM p_be a LEFT JOIN p_ann b ON b.gvkey = a.gvkey AND b.cal_year = a.cal_year - 1"""
# links of each June, the same pair once, ranked within the date
CTES["p_held"] = """
  SELECT k.gvkey, s.permno, s.date, k.linkprim, k.linkdt, k.linkenddt, y.years_on_file, md5(k.gvkey || ':' || s.permno) AS draw, k.linkprim = 'P' AS prim
  FROM p_sec s JOIN p_lnk k ON k.permno = s.permno AND (k.linkdt IS NULL OR k.linkdt <= s.date) AND (k.linkenddt IS NULL OR k.linkenddt >= s.date)
    AND (k.linkdt IS NULL OR k.linkenddt IS NULL OR k.linkdt <= k.linkenddt)
  LEFT JOIN p_yof y ON y.gvkey = k.gvkey AND y.cal_year = year(s.date) - 1 WHERE month(s.date) = 6"""
CTES["p_one"] = """
  SELECT *, row_number() OVER (PARTITION BY gvkey, permno, date ORDER BY prim DESC NULLS LAST, years_on_file DESC NULLS LAST,
                               linkprim DESC NULLS LAST, linkdt DESC NULLS LAST, linkenddt DESC NULLS LAST) AS copy FROM p_held"""
CTES["p_r0"] = """
  SELECT gvkey, permno, date, prim, years_on_file, draw,
         row_number() OVER (PARTITION BY date ORDER BY prim NULLS FIRST, years_on_file NULLS FIRST, draw, gvkey, permno) AS rk
  FROM p_one WHERE copy = 1"""
for _i in range(1, ROUNDS + 1):
    CTES[f"p_k{_i}"] = f"""
  SELECT *, CASE WHEN rk = max(rk) OVER (PARTITION BY gvkey, date) AND rk = max(rk) OVER (PARTITION BY permno, date) THEN rk END AS won FROM p_r{_i - 1}"""
    CTES[f"p_j{_i}"] = f"""
  SELECT *, greatest(max(won) OVER (PARTITION BY gvkey, date), max(won) OVER (PARTITION BY permno, date)) AS rival FROM p_k{_i}"""
    CTES[f"p_r{_i}"] = f"SELECT gvkey, permno, date, prim, years_on_file, draw, rk FROM p_j{_i} WHERE rival IS NULL"
CTES["p_judged"] = " UNION ALL ".join([
    f"SELECT j.gvkey, j.permno, j.date, j.years_on_file, CASE WHEN j.won IS NOT NULL THEN NULL WHEN j.prim IS DISTINCT FROM v.prim THEN 'primary' "
    f"WHEN j.years_on_file IS DISTINCT FROM v.years_on_file THEN 'age' WHEN j.draw <> v.draw THEN 'draw' ELSE 'order' END AS rule, {i} AS round "
    f"FROM p_j{i} j JOIN p_r0 v ON v.date = j.date AND v.rk = j.rival" for i in range(1, ROUNDS + 1)]
    # what the written-out rounds leave open has no rule, and would show as a difference
    + [f"SELECT gvkey, permno, date, years_on_file, 'open' AS rule, {ROUNDS + 1} AS round FROM p_r{ROUNDS}",
       "SELECT gvkey, permno, date, years_on_file, 'repeated' AS rule, 0 AS round FROM p_one WHERE copy > 1"])
# firms
_CHOSEN = "ORDER BY me DESC NULLS LAST, {years} md5('firm:' || permno) DESC, permno DESC"


def _firms(table: str, firm: str, years: str = "") -> str:
    order = _CHOSEN.format(years=years)
    return f"""
  SELECT *, CASE WHEN count(me) OVER g > 0 THEN sum(me) OVER g END AS firm_me, count(*) OVER g AS n_classes, row_number() OVER (
           PARTITION BY {firm}, CASE WHEN {firm} IS NULL THEN permno END, date {order}) AS place
  FROM {table} WINDOW g AS (PARTITION BY {firm}, CASE WHEN {firm} IS NULL THEN permno END, date)"""


CTES["p_firm"] = _firms("p_mon", "permco")
CTES["p_tot"] = "SELECT firm, date, sum(me) AS me FROM p_mon GROUP BY firm, date HAVING count(me) > 0"
CTES["p_june"] = """
  SELECT m.*, k.gvkey, k.years_on_file FROM p_mon m
  LEFT JOIN p_judged k ON k.permno = m.permno AND k.date = m.date AND k.rule IS NULL WHERE month(m.date) = 6"""
CTES["p_pick"] = _firms("p_june", "firm", "years_on_file DESC NULLS LAST,")
CTES["p_dec"] = """
  SELECT f.firm, f.date, t.date AS dec_date, t.me AS dec_me
  FROM (SELECT DISTINCT firm, date, make_date(year(date) - 1, 12, 31) AS december FROM p_mon WHERE month(date) = 6) f
  ASOF LEFT JOIN p_tot t ON t.firm = f.firm AND t.date <= f.december"""


def queries() -> dict[str, str]:
    o: dict[str, str] = {}
    o["dated_link_join"] = """
SELECT s.permno, s.date, k.gvkey, k.linkprim, k.linkdt, k.linkenddt FROM p_sec s LEFT JOIN p_lnk k ON k.permno = s.permno
  AND (k.linkdt IS NULL OR k.linkdt <= s.date) AND (k.linkenddt IS NULL OR k.linkenddt >= s.date)"""
    fresh = f"date_diff('day', dec_date, make_date(year(date) - 1, 12, 31)) <= {STALE}"
    june = "SELECT f.firm, f.date, f.me, {0} AS dec_date, {1} AS dec_me, {2} AS bound FROM ({3}) f JOIN p_dec d ON d.firm = f.firm AND d.date = f.date"
    every = "SELECT firm, date, sum(me) AS me FROM p_mon WHERE month(date) = 6 GROUP BY firm, date"
    fresh = fresh.replace("year(date)", "year(d.date)")
    o["december_market_equity"] = (
        june.format(f"CASE WHEN {fresh} THEN d.dec_date END", f"CASE WHEN {fresh} THEN d.dec_me END", STALE, every)
        + " UNION ALL " + june.format("d.dec_date", "d.dec_me", "NULL", every))
    o["firm_market_equity"] = ("SELECT permco, date, permno, exchcd, shrcd, me AS class_me, firm_me AS me, n_classes FROM p_firm WHERE place = 1")
    o["resolve_links"] = "SELECT gvkey, permno, date, rule, round, count(*) AS n FROM p_judged GROUP BY ALL"
    o["link_drop_counts"] = "SELECT coalesce(rule, 'kept') AS rule, count(*) AS n FROM p_judged GROUP BY ALL"
    o["years_on_file"] = """
SELECT a.gvkey, a.cal_year, a.years_on_file, CAST(a.cal_year - x.begun + 1 AS INTEGER) AS run_years, x.restarts, a.years_on_file >= 2 AS in_years_on_file,
       a.cal_year - x.begun >= 1 AS in_run_years FROM p_yof a JOIN p_run x ON x.gvkey = a.gvkey AND x.cal_year = a.cal_year"""
    o["last_annual_record"] = "SELECT gvkey, datadate, cal_year, months, CAST(changed AS INTEGER) AS changed, n_records, \"at\" FROM p_ann"
    o["book_equity"] = f"""
SELECT gvkey, datadate, {_PREFERRED} AS preferred, coalesce(txditc, 0) AS deferred, {_EQUITY} AS equity, {_EQUITY} + coalesce(txditc, 0) - {_PREFERRED} AS be,
       CASE WHEN pstkrv IS NOT NULL THEN 'redemption' WHEN pstkl IS NOT NULL THEN 'liquidation' WHEN pstk IS NOT NULL THEN 'par' ELSE 'none' END AS preferred_branch,
       CASE WHEN txditc IS NULL THEN 'none' ELSE 'reported' END AS deferred_branch,
       CASE WHEN seq IS NOT NULL THEN 'reported' WHEN ceq + pstk IS NOT NULL THEN 'common' WHEN "at" - lt IS NOT NULL THEN 'assets' ELSE 'none' END AS equity_branch,
       CASE WHEN {_EQUITY} IS NULL THEN 'none' ELSE 'book' END AS be_branch FROM p_acc"""
    o["operating_profitability"] = f"""
SELECT gvkey, datadate, be, CASE WHEN coalesce(cogs, xsga, xint) IS NOT NULL THEN
         (revt - (coalesce(cogs, 0) + coalesce(xsga, 0) + coalesce(xint, 0))) / nullif(be + coalesce(mib, 0), 0) END AS op
FROM (SELECT *, {_EQUITY} + coalesce(txditc, 0) - {_PREFERRED} AS be FROM p_acc)"""
    o["asset_growth"] = "SELECT gvkey, cal_year, \"at\", inv FROM p_year"
    o["job_june_panel"] = f"""
SELECT f.permno, f.date AS jdate, f.exchcd, f.shrcd, f.prc, f.shrout, f.firm_me AS me, CASE WHEN {fresh} THEN d.dec_me END AS dec_me, y.be,
       y.be / nullif(CASE WHEN {fresh} THEN d.dec_me END, 0) AS beme, y.inv, y.op, y.revt, y.cogs, y.xsga, y.xint, f.gvkey, y.years_on_file, f.n_classes
FROM p_pick f JOIN p_dec d ON d.firm = f.firm AND d.date = f.date JOIN p_year y ON y.gvkey = f.gvkey AND y.cal_year = year(f.date) - 1
WHERE f.place = 1 AND f.exchcd IN (1, 2, 3) AND f.shrcd IN (10, 11) AND y.years_on_file >= 2"""
    return o
