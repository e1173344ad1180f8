"""The same results in plain SQL over the driver's tables, written independently of the Spark code.

Each oracle is a final SELECT over named common table expressions; only those it needs are emitted.
"""

from __future__ import annotations

import re
from itertools import combinations, product

from verification import panel_oracles

SETS = ["10_90", "20_80", "30_70", "40_60"]
ROBUST_SETS = ["10_90", "20_80", "40_60"]
PCTS = [0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9]
LOW = {"bm": "L", "op": "W", "inv": "C", "nf": "Y"}
HIGH = {"bm": "H", "op": "R", "inv": "A", "nf": "X"}
COL = {"size": "me", "bm": "beme", "inv": "inv", "op": "op", "nf": "nf"}
FLAG = {"size": "is_size_ok", "bm": "is_beme_ok", "inv": "is_inv_ok", "op": "is_op_ok", "nf": "is_nf_ok"}
MEAS = ["bm", "inv", "op", "nf"]
S = "source_file, measure"
CTES: dict[str, str] = dict(panel_oracles.CTES)
MATERIALIZED = {"chars", "meas", "pan", "lng0", "p_ann", "p_yof", "p_r0", "p_judged", "p_mon"}  # computed once, so that no join order can go astray


# --- input tables ---------------------------------------------------------------------------
CTES["li"] = """
  SELECT l_partkey AS permno, CAST(l_shipdate AS DATE) AS d,
         CAST(year(l_shipdate) + CASE WHEN month(l_shipdate) > 6 THEN 1 ELSE 0 END AS INTEGER) AS fy,
         l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_tax AS tax,
         l_returnflag AS rf, l_linestatus AS ls
  FROM lineitem"""
CTES["rets"] = """
  SELECT strftime(max(d), '%Y-%m-%d') AS date, permno,
         CASE WHEN CAST(sum(qty) AS BIGINT) % 11 <> 0 THEN round(avg(disc) - avg(tax), 6) END AS retadj,
         CASE WHEN count(*) % 3 <> 0 THEN round(sum(price), 2) END AS wt,
         CAST(year(last_day(d)) - CASE WHEN month(last_day(d)) < 7 THEN 1 ELSE 0 END AS INTEGER) AS ffyear,
         last_day(d) AS jdate
  FROM li GROUP BY permno, last_day(d)"""
CTES["yearly"] = """
  SELECT permno, fy, round(sum(price), 2) AS me,
         round(sum(price) FILTER (WHERE month(d) > 6), 2) AS dec_me,
         round(sum(qty) * 100 * (avg(tax) * 25 - 0.2::DOUBLE), 6) AS be,
         CASE WHEN CAST(sum(qty) AS BIGINT) % 13 <> 0 THEN round(sum(price * (1 - disc)), 4) END AS revt,
         round(sum(price * 0.5::DOUBLE) FILTER (WHERE rf = 'R'), 4) AS cogs,
         round(sum(price * 0.2::DOUBLE) FILTER (WHERE rf = 'A'), 4) AS xsga,
         round(sum(price * tax) FILTER (WHERE ls = 'O'), 4) AS xint, sum(qty) AS shrout
  FROM li GROUP BY permno, fy"""
CTES["chars"] = """
  SELECT y.permno, make_date(y.fy, 6, 30) AS jdate, CAST(1 + y.permno % 3 AS INTEGER) AS exchcd,
         CAST(10 + p.p_size % 4 AS INTEGER) AS shrcd,
         CASE WHEN y.permno % 37 <> 0 THEN p.p_retailprice END AS prc, y.shrout, y.me, y.dec_me, y.be,
         y.be / nullif(y.dec_me, 0) AS beme,
         (y.me - b.me) / nullif(b.me, 0) AS inv,
         (y.revt - (coalesce(y.cogs, 0) + coalesce(y.xsga, 0) + coalesce(y.xint, 0))) / nullif(y.be, 0) AS op,
         y.revt, y.cogs, y.xsga, y.xint
  FROM yearly y JOIN part p ON p.p_partkey = y.permno
  LEFT JOIN yearly b ON b.permno = y.permno AND b.fy = y.fy - 1"""
CTES["m_alpha"] = """
  SELECT permno, fy * 100 + 6 AS date, round(avg(qty), 6) AS m1, round(max(disc), 6) AS m2, 0.0::DOUBLE AS m3
  FROM li GROUP BY permno, fy"""
CTES["m_beta"] = """
  SELECT permno, fy * 100 + 6 AS date, round(min(price), 2) AS m4 FROM li WHERE rf = 'R' GROUP BY permno, fy"""
CTES["meas"] = "\n  UNION ALL ".join(
    f"SELECT '{f}' AS source_file, '{m}' AS measure, {i} AS idx, permno, make_date(date // 100, 6, 30) AS jdate, "
    f"{m} AS nf FROM {t}"
    for f, t, m, i in [("measures_alpha", "m_alpha", "m1", 1), ("measures_alpha", "m_alpha", "m2", 2),
                       ("measures_alpha", "m_alpha", "m3", 3), ("measures_beta", "m_beta", "m4", 1)])
CTES["legend"] = "SELECT DISTINCT source_file, measure, idx AS measure_index FROM meas"
_PRIO = {"Mkt-RF": "1", "SMB": "2", "HML": "3", "RMW": "4", "CMA": "5"}
CTES["bench"] = "SELECT last_day(CAST(o_orderdate AS DATE)) AS date, " + ", ".join(
    f"round(coalesce(avg(o_totalprice) FILTER (WHERE o_orderpriority LIKE '{p}%'), avg(o_totalprice)) / 1000000, 6) AS \"{f}\"" for f, p in _PRIO.items()
) + (", round(0.001::DOUBLE + 0.0001::DOUBLE * max(month(o_orderdate)), 4) AS RF"
     " FROM orders GROUP BY last_day(CAST(o_orderdate AS DATE))")
PUBLISHED = [("size", "bm"), ("size", "inv"), ("size", "op"), ("bm", "inv"), ("bm", "op"), ("op", "inv")]
CTES["pub_biv"] = " UNION ALL ".join(
    f"SELECT last_day(CAST(o_orderdate AS DATE)) AS date, '{a}' || left(o_orderpriority, 1) || '_{b}' || "
    f"CAST(1 + o_custkey % 5 AS VARCHAR) AS ptf_code, round(avg(o_totalprice) / 1000000, 6) AS ret, '{a}_{b}' AS sort_on "
    "FROM orders GROUP BY ALL"
    for a, b in PUBLISHED)
CTES["pub_thr"] = " UNION ALL ".join(
    f"SELECT last_day(CAST(o_orderdate AS DATE)) AS date, 'size' || CASE WHEN o_orderstatus = 'O' THEN '1' ELSE '2' END || "
    f"'_{a}' || CAST(1 + o_custkey % 4 AS VARCHAR) || '_{b}' || CAST(1 + o_custkey % 3 + "
    f"CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS VARCHAR) AS ptf_code, "
    f"round(avg(o_totalprice) / 1000000, 6) AS ret, 'size_{a}_{b}' AS sort_on FROM orders GROUP BY ALL"
    for a, b in [("bm", "op"), ("bm", "inv"), ("op", "inv")])

# --- panel ----------------------------------------------------------------------------------
_EXP = "(cogs IS NOT NULL OR xsga IS NOT NULL OR xint IS NOT NULL)"
U = {
    "size": "exchcd = 1 AND shrcd IN (10, 11) AND prc IS NOT NULL AND shrout IS NOT NULL",
    "bm": "exchcd = 1 AND shrcd IN (10, 11) AND dec_me IS NOT NULL AND be > 0",
    "inv": "exchcd = 1 AND shrcd IN (10, 11) AND inv IS NOT NULL",
    "op": f"exchcd = 1 AND shrcd IN (10, 11) AND be > 0 AND revt IS NOT NULL AND {_EXP}",
    "nf": "exchcd = 1 AND shrcd IN (10, 11) AND nf IS NOT NULL",
}
OK = {
    "is_size_ok": "me > 0 AND shrcd IN (10, 11)",
    "is_beme_ok": "be > 0 AND dec_me IS NOT NULL AND shrcd IN (10, 11) AND me > 0",
    "is_inv_ok": "inv IS NOT NULL AND shrcd IN (10, 11) AND me > 0",
    "is_op_ok": f"be > 0 AND revt IS NOT NULL AND {_EXP} AND shrcd IN (10, 11) AND me > 0",
}
FLAGS_SQL = ", ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END AS {n}" for n, c in OK.items())
NF_FLAG_SQL = "CASE WHEN nf IS NOT NULL AND shrcd IN (10, 11) AND me > 0 THEN 1 ELSE 0 END AS is_nf_ok"
CTES["prs"] = ("SELECT DISTINCT m.source_file, m.permno, m.jdate FROM meas m "
               "JOIN chars c ON c.permno = m.permno AND c.jdate = m.jdate")
CTES["pan"] = f"SELECT p.source_file, c.*, {FLAGS_SQL} FROM prs p JOIN chars c ON c.permno = p.permno AND c.jdate = p.jdate"
CTES["lng0"] = (f"SELECT p.*, m.measure, m.idx, m.nf, {NF_FLAG_SQL} FROM pan p JOIN meas m "
                "ON m.source_file = p.source_file AND m.permno = p.permno AND m.jdate = p.jdate")
CTES["lng"] = (f"SELECT * FROM lng0 WHERE ({S}) IN (SELECT ({S}) FROM lng0 GROUP BY {S} HAVING sum(abs(nf)) <> 0)")


def q(xs: str, p: float) -> str:
    """Linear-interpolation quantile of a sorted list."""
    pos = f"({p}::DOUBLE * (len({xs}) - 1))"
    lo, hi = f"{xs}[CAST(floor({pos}) AS INTEGER) + 1]", f"{xs}[CAST(ceil({pos}) AS INTEGER) + 1]"
    t = f"({pos} - floor({pos}))"
    return (f"CASE WHEN {lo} = {hi} THEN {lo} WHEN {t} < 0.5 THEN {lo} + ({hi} - {lo}) * {t} "
            f"ELSE {hi} - ({hi} - {lo}) * (1 - {t}) END")


def lists(variables: list[str], keys: str, table: str) -> str:
    cols = ", ".join(f"list({COL[v]} ORDER BY {COL[v]}) FILTER (WHERE {U[v]} AND {COL[v]} IS NOT NULL) AS l_{v}" for v in variables)
    return f"SELECT {keys}, {cols} FROM {table} GROUP BY {keys}"


def edge_cols(variables: list[str], probs: list[float]) -> str:
    return ", ".join(f"{q('l_' + v, p)} AS {v}{round(p * 100)}" for v in variables for p in probs)


def has_any(variables: list[str]) -> str:
    return " OR ".join(f"l_{v} IS NOT NULL" for v in variables)


CTES["lc"] = lists(["size", "bm", "inv", "op"], "source_file, jdate", "pan")
CTES["ln"] = lists(["nf"], f"{S}, jdate", "lng")
CTES["junes"] = "SELECT DISTINCT CAST(last_day(date - INTERVAL 1 MONTH) AS DATE) AS jdate FROM bench WHERE month(date) = 7"
CTES["bp3"] = (f"SELECT source_file, jdate, {q('l_size', 0.5)} AS sizemedn, {edge_cols(['bm', 'inv', 'op'], PCTS)} "
               f"FROM lc WHERE jdate IN (SELECT jdate FROM junes)")
CTES["bp2"] = (f"SELECT source_file, jdate, {q('l_size', 0.5)} AS sizemedn, {edge_cols(['bm', 'inv', 'op'], [0.5])} "
               f"FROM lc WHERE jdate IN (SELECT jdate FROM junes)")
CTES["nbp"] = f"SELECT {S}, jdate, {edge_cols(['nf'], PCTS + [0.5])} FROM ln WHERE l_nf IS NOT NULL"


def two(m: str) -> str:
    x, e, lo, hi = COL[m], f"{m}50", LOW[m], HIGH[m]
    return f"CASE WHEN {FLAG[m]} = 1 THEN CASE WHEN {x} <= {e} THEN '{lo}' WHEN {x} > {e} THEN '{hi}' END END"


def three(m: str, bp: str) -> str:
    a, b = bp.split("_")
    x = COL[m]
    return (f"CASE WHEN {FLAG[m]} = 1 THEN CASE WHEN {x} <= {m}{a} THEN '{LOW[m]}' WHEN {x} < {m}{b} THEN 'N' "
            f"WHEN {x} >= {m}{a} THEN '{HIGH[m]}' END END")


SZ = "CASE WHEN is_size_ok = 1 THEN CASE WHEN me <= sizemedn THEN 'S' WHEN me > sizemedn THEN 'B' END END AS szport"
_J = "LEFT JOIN {0} USING (source_file, jdate) LEFT JOIN nbp USING (source_file, measure, jdate)"
CTES["as2"] = (f"SELECT lng.*, CAST(year(jdate) AS INTEGER) AS ffyear, {SZ}, " + ", ".join(f"{two(m)} AS {m}port" for m in MEAS)
               + " FROM lng " + _J.format("bp2"))
CTES["as3"] = (f"SELECT lng.*, CAST(year(jdate) AS INTEGER) AS ffyear, {SZ}, "
               + ", ".join(f"{three(m, '30_70')} AS {m}port" for m in MEAS) + ", "
               + ", ".join(f"{three(m, bp)} AS {m}port_{bp}" for m in MEAS for bp in SETS)
               + " FROM lng " + _J.format("bp3"))

# --- n-tile sorts -----------------------------------------------------------------------------
Q5, Q4 = [0.2, 0.4, 0.6, 0.8], [0.25, 0.5, 0.75]


def ntile(x: str, edges: list[str]) -> str:
    total = " + ".join(f"CASE WHEN {x} > {e} THEN 1 ELSE 0 END" for e in edges)
    present = " AND ".join(f"{e} IS NOT NULL" for e in edges)
    return f"CASE WHEN {x} IS NOT NULL AND {present} THEN CAST(1 + {total} AS INTEGER) END"


def names(v: str, probs: list[float]) -> list[str]:
    return [f"{v}{round(p * 100)}" for p in probs]


def lowered(probs: list[float]) -> str:
    k = len(probs)
    return ", ".join(f"{q('l_nf', p)} - 0.00000000001::DOUBLE * {k - 1 - i} AS nf{round(p * 100)}" for i, p in enumerate(probs))


CTES["bp5"] = f"SELECT source_file, jdate, {edge_cols(['size', 'bm', 'op', 'inv'], Q5)} FROM lc"
CTES["nbp5"] = f"SELECT {S}, jdate, {lowered(Q5)} FROM ln WHERE len(list_distinct(l_nf)) >= 2"
CTES["as5"] = ("SELECT lng.*, CAST(year(jdate) AS INTEGER) AS ffyear, "
               + ", ".join(f"{ntile(COL[v], names(v, Q5))} AS {v}port" for v in ["size", "bm", "op", "inv", "nf"])
               + " FROM lng LEFT JOIN bp5 USING (source_file, jdate) LEFT JOIN nbp5 USING (source_file, measure, jdate)")
CTES["bph"] = f"SELECT source_file, jdate, {q('l_size', 0.5)} AS size50 FROM lc"
CTES["szd"] = f"SELECT pan.*, {ntile('me', ['size50'])} AS sizeport FROM pan LEFT JOIN bph USING (source_file, jdate)"
CTES["szl"] = f"SELECT lng.*, {ntile('me', ['size50'])} AS sizeport FROM lng LEFT JOIN bph USING (source_file, jdate)"
CTES["lcd"] = lists(["bm", "op", "inv"], "source_file, jdate, sizeport", "(SELECT * FROM szd WHERE sizeport IS NOT NULL)")
CTES["lnd"] = lists(["nf"], f"{S}, jdate, sizeport", "(SELECT * FROM szl WHERE sizeport IS NOT NULL)")
CTES["bp4"] = f"SELECT source_file, jdate, sizeport, {edge_cols(['bm', 'op', 'inv'], Q4)} FROM lcd WHERE {has_any(['bm', 'op', 'inv'])}"
CTES["nbp4"] = f"SELECT {S}, jdate, sizeport, {lowered(Q4)} FROM lnd WHERE len(list_distinct(l_nf)) >= 2"
CTES["as4"] = ("SELECT szl.*, CAST(year(jdate) AS INTEGER) AS ffyear, "
               + ", ".join(f"{ntile(COL[v], names(v, Q4))} AS {v}port" for v in ["bm", "op", "inv", "nf"])
               + " FROM szl LEFT JOIN bp4 USING (source_file, jdate, sizeport)"
               + " LEFT JOIN nbp4 USING (source_file, measure, jdate, sizeport)")

# --- monthly rows -------------------------------------------------------------------------------
P5 = ["szport", "bmport", "opport", "invport", "nfport"]
N5 = ["sizeport", "bmport", "opport", "invport", "nfport"]
RPORTS = ["szport", "bmport", "opport", "invport"] + [f"nfport_{bp}" for bp in SETS]


def monthly(asg: str, ports: list[str]) -> str:
    return (f"SELECT a.{', a.'.join(['source_file', 'measure', *ports])}, r.permno, r.jdate, r.ffyear, r.retadj, r.wt "
            f"FROM rets r JOIN {asg} a ON a.permno = r.permno AND a.ffyear = r.ffyear "
            f"WHERE coalesce({', '.join(f'CAST(a.{p} AS VARCHAR)' for p in ports)}) IS NOT NULL")


ALLPORTS = ["szport"] + [f"{m}port_{bp}" for m in MEAS for bp in SETS]
CTES["mo2"] = monthly("as2", P5)
CTES["mo3"] = monthly("as3", P5)
CTES["mo3r"] = monthly("as3", RPORTS)
CTES["mo3a"] = monthly("as3", ALLPORTS)
CTES["mo5"] = monthly("as5", N5)
CTES["mo4"] = monthly("as4", N5)

AGG = ("sum(retadj * wt) AS retadj_x_wt, sum(wt) AS wt, count(retadj) AS n_ret, count(wt) AS n_wt, "
       "count(retadj * wt) AS n_both, count(*) AS n_rows")
VW = "coalesce(sum(retadj * wt), 0) / nullif(sum(wt), 0)"


def melted(mo: str, sets: dict[str, list[tuple[str, str]]]) -> str:
    """Rows per bucket column: ``sets`` maps the set to (measure, column) pairs."""
    return " UNION ALL ".join(
        f"SELECT {S}, '{bp}' AS bp, jdate, szport, '{m}port' AS variable, {c} AS value, retadj, wt FROM {mo} "
        f"WHERE szport IS NOT NULL AND {c} IS NOT NULL"
        for bp, cols in sets.items() for m, c in cols)


CTES["me2"] = melted("mo2", {"": [(m, f"{m}port") for m in MEAS]})
CTES["me3"] = melted("mo3", {"30_70": [(m, f"{m}port") for m in MEAS]})
CTES["me3r"] = melted("mo3r", {bp: [(m, f"{m}port" if m != "nf" else f"nfport_{bp}") for m in MEAS] for bp in ROBUST_SETS})
CTES["me3a"] = melted("mo3a", {bp: [(m, f"{m}port_{bp}") for m in MEAS] for bp in ROBUST_SETS})
for k in ("2", "3", "3r", "3a"):
    CTES[f"vw{k}"] = (f"SELECT {S}, bp, jdate, szport, value, variable, sum(retadj * wt) AS retadj_x_wt, sum(wt) AS wt, "
                      f"{VW} AS vwret, szport || value || '_' || variable AS ptf_code FROM me{k} GROUP BY ALL")
CTES["vwf"] = (f"SELECT {S}, '' AS bp, jdate, szport, bmport, opport, invport, nfport, sum(retadj * wt) AS retadj_x_wt, "
               f"sum(wt) AS wt, {VW} AS vwret, szport || bmport || opport || invport || nfport AS ptf_code FROM mo2 WHERE "
               + " AND ".join(f"{p} IS NOT NULL" for p in P5) + " GROUP BY ALL")


def sorted_cells(mo: str, sorts: list[tuple[str, ...]], n_size: int, n_other: int) -> tuple[str, str]:
    """Grid of all cells of all months, and the rows in each cell."""
    cells = ", ".join(
        f"('{'_'.join(s)}', '{'_'.join(f'{m}{i}' for m, i in zip(s, c))}')"
        for s in sorts for c in product(*[range(1, (n_size if m == "size" else n_other) + 1) for m in s]))
    grid = (f"SELECT * FROM (SELECT DISTINCT {S}, jdate FROM {mo}) t CROSS JOIN (VALUES {cells}) c(sort_on, ptf_code)")
    rows = " UNION ALL ".join(
        f"SELECT {S}, jdate, '{'_'.join(s)}' AS sort_on, "
        + " || '_' || ".join(f"'{m}' || CAST({m}port AS VARCHAR)" for m in s)
        + f" AS ptf_code, retadj, wt FROM {mo} WHERE " + " AND ".join(f"{m}port IS NOT NULL" for m in s)
        for s in sorts)
    return grid, rows


ORDER = ["bm", "op", "inv", "nf"]
BIV = list(combinations(["size", *ORDER], 2))
THR = [("size", *c) for c in combinations(ORDER, 2)]
for tag, mo, sorts, a, b in (("b", "mo5", BIV, 5, 5), ("t", "mo4", THR, 2, 4)):
    CTES[f"grid{tag}"], CTES[f"rows{tag}"] = sorted_cells(mo, sorts, a, b)
    CTES[f"cell{tag}"] = f"SELECT {S}, jdate, sort_on, ptf_code, {AGG} FROM rows{tag} GROUP BY ALL"
    CTES[f"srt{tag}"] = (
        f"SELECT {S}, jdate, sort_on, ptf_code, coalesce(retadj_x_wt, 0.0) AS retadj_x_wt, coalesce(wt, 0.0) AS wt, "
        f"coalesce(n_both, 0) AS n_both, coalesce(n_rows, 0) AS n_rows, "
        f"coalesce(coalesce(retadj_x_wt, 0) / nullif(wt, 0), 0) AS vwret "
        f"FROM grid{tag} LEFT JOIN cell{tag} USING (source_file, measure, jdate, sort_on, ptf_code)")
    CTES[f"exc{tag}"] = (
        f"SELECT b.date, k.ptf_code, s.vwret - b.RF AS ret, k.sort_on, k.source_file, k.measure "
        f"FROM (SELECT DISTINCT {S}, sort_on, ptf_code FROM srt{tag}) k CROSS JOIN bench b "
        f"LEFT JOIN srt{tag} s ON s.jdate = b.date AND s.source_file = k.source_file AND s.measure = k.measure "
        f"AND s.sort_on = k.sort_on AND s.ptf_code = k.ptf_code")

# --- factors --------------------------------------------------------------------------------
F_OF = {"bm": "HML", "inv": "CMA", "op": "RMW", "nf": "XMY"}
LONG = {"bm": ("H", "L"), "inv": ("C", "A"), "op": ("R", "W"), "nf": ("X", "Y")}


def ptf(code: str) -> str:
    return f"coalesce(max(vwret) FILTER (WHERE ptf_code = '{code}'), 0)"


def mean(cs: list[str]) -> str:
    return "(" + " + ".join(ptf(c) for c in cs) + f") / {len(cs)}"


def hedge(m: str) -> str:
    lo, sh = LONG[m]
    return (f"{mean([f'B{lo}_{m}port', f'S{lo}_{m}port'])} - {mean([f'B{sh}_{m}port', f'S{sh}_{m}port'])}")


def smb_part(m: str) -> str:
    labels = [LOW[m], "N", HIGH[m]]
    return f"({mean([f'S{v}_{m}port' for v in labels])} - {mean([f'B{v}_{m}port' for v in labels])})"


def smb_all(labels_n: bool) -> str:
    if labels_n:
        return "(" + " + ".join(smb_part(m) for m in MEAS) + ") / 4"
    codes = [f"{v}_{m}port" for m in MEAS for v in (LOW[m], HIGH[m])]
    return f"{mean(['S' + c for c in codes])} - {mean(['B' + c for c in codes])}"


FIVE = ["".join(p) for p in product("SB", "LH", "WR", "CA", "YX")]


def five_factor(pos: int, long: str) -> str:
    sides = [[c for c in FIVE if (c[pos] == long) == side] for side in (True, False)]
    return "((" + " + ".join(ptf(c) for c in sides[0]) + ") - (" + " + ".join(ptf(c) for c in sides[1]) + ")) / 16"


def spreads(vw: str, cols: dict[str, str], complete: int | None = None) -> str:
    """Spread columns on the published calendar for every series of the portfolio table."""
    having = f" HAVING count(DISTINCT ptf_code) = {complete}" if complete else ""
    exprs = ", ".join(f"{e} AS \"{n}\"" for n, e in cols.items())
    outer = ", ".join(f"coalesce(v.\"{n}\", 0) AS \"{n}\"" for n in cols)
    return (f"SELECT k.source_file, k.measure, k.bp, b.date AS jdate, {outer} "
            f"FROM (SELECT {S}, bp FROM {vw} GROUP BY {S}, bp{having}) k CROSS JOIN bench b "
            f"LEFT JOIN (SELECT {S}, bp, jdate, {exprs} FROM {vw} GROUP BY {S}, bp, jdate) v "
            f"ON v.source_file = k.source_file AND v.measure = k.measure AND v.bp = k.bp AND v.jdate = b.date")


COLS3 = {"SMB": smb_all(True), **{F_OF[m]: hedge(m) for m in MEAS}}
COLS2 = {"SMB": smb_all(False), **{F_OF[m]: hedge(m) for m in MEAS}}
COLSF = {"SMB": five_factor(0, "S"), "HML": five_factor(1, "H"), "RMW": five_factor(2, "R"),
         "CMA": five_factor(3, "C"), "XMY": five_factor(4, "X")}
TABLE = ["Mkt-RF", "SMB", "HML", "CMA", "RMW", "XMY"]
for k, mo, vw, cols, n in (("2", "mo2", "vw2", COLS2, 16), ("3", "mo3", "vw3", COLS3, 24), ("3r", "mo3r", "vw3r", COLS3, 24),
                           ("3a", "mo3a", "vw3a", COLS3, 24), ("f", "mo2", "vwf", COLSF, 32)):
    CTES.setdefault(f"mk{mo[2:]}", f"SELECT {S}, jdate, {VW} AS Mkt FROM {mo} GROUP BY {S}, jdate")
    CTES[f"sp{k}"] = spreads(vw, cols, n)
    CTES[f"ft{k}"] = (
        f"SELECT s.jdate AS date, m.Mkt - b.RF AS \"Mkt-RF\", s.SMB, s.HML, s.CMA, s.RMW, s.XMY, s.bp, s.source_file, s.measure "
        f"FROM sp{k} s JOIN bench b ON b.date = s.jdate LEFT JOIN mk{mo[2:]} m "
        f"ON m.source_file = s.source_file AND m.measure = s.measure AND m.jdate = s.jdate")

# --- firm counts ----------------------------------------------------------------------------
_ports = {"2": {"": {m: f"{m}port" for m in MEAS}},
          "3r": {bp: {m: f"{m}port" if m != "nf" else f"nfport_{bp}" for m in MEAS} for bp in ROBUST_SETS}}


def nfirms(k: str, mo: str, smb: list[str]) -> str:
    parts = []
    for bp, cols in _ports[k].items():
        anyof = " OR ".join(f"{cols[m]} IS NOT NULL" for m in smb)
        per = ", ".join(f"count(wt) FILTER (WHERE szport IS NOT NULL AND {cols[m]} IS NOT NULL) AS {F_OF[m]}" for m in MEAS)
        parts.append(f"SELECT {S}, '{bp}' AS bp, jdate, count(retadj) AS \"Mkt-RF\", "
                     f"count(*) FILTER (WHERE {anyof}) AS SMB, {per} FROM {mo} GROUP BY {S}, jdate")
    return " UNION ALL ".join(parts)


def on_calendar(counts: str, cols: list[str]) -> str:
    filled = ", ".join(f"coalesce(n.\"{c}\", 0) AS \"{c}\"" for c in cols)
    return (f"SELECT k.source_file, k.measure, k.bp, b.date AS jdate, {filled} "
            f"FROM (SELECT DISTINCT {S}, bp FROM {counts}) k CROSS JOIN bench b LEFT JOIN {counts} n "
            f"ON n.source_file = k.source_file AND n.measure = k.measure AND n.bp = k.bp AND n.jdate = b.date")


CTES["nf3c"] = nfirms("3r", "mo3r", ["bm", "inv", "nf"])
CTES["nf2c"] = nfirms("2", "mo2", MEAS)
CTES["nf5c"] = (f"SELECT {S}, '' AS bp, jdate, count(retadj) AS \"Mkt-RF\", " + ", ".join(
    "count(*) FILTER (WHERE " + " AND ".join(f"{p} IS NOT NULL" for p in P5) + f") AS {c}" for c in TABLE[1:])
    + f" FROM mo2 GROUP BY {S}, jdate")
CTES["nf3"] = on_calendar("nf3c", TABLE)
CTES["nf2"] = on_calendar("nf2c", TABLE[1:])
CTES["nf5"] = on_calendar("nf5c", TABLE)


def sql(body: str) -> str:
    """``body`` preceded by the common table expressions it needs, directly or not."""
    needed: set[str] = set()
    stack = [body]
    while stack:
        words = set(re.findall(r"\b[a-z][a-z0-9_]*\b", stack.pop()))
        for name in CTES.keys() & words - needed:
            needed.add(name)
            stack.append(CTES[name])
    ctes = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in MATERIALIZED else ''}({CTES[n]})" for n in CTES if n in needed)
    return f"WITH {ctes}\n{body}" if ctes else body


def r(cols: list[str], digits: int = 9) -> str:
    return ", ".join(f"round(\"{c}\", {digits}) AS \"{c}\"" for c in cols)


def pct(part: str, whole: str) -> str:
    """Percent with the share rounded half-even to four decimals."""
    return f"round_even(({part})::DOUBLE / ({whole}), 4) * 100"


SP = f"{S}, permno, jdate"
COMPLETE = (f"WHERE ({S}, bp) IN (SELECT ({S}, bp) FROM vw3r GROUP BY {S}, bp "
            "HAVING count(DISTINCT ptf_code) = 24)")
_CH16 = "permno, jdate, exchcd, shrcd, prc, shrout, me, dec_me, be, beme, inv, op, revt, cogs, xsga, xint"


def _job(k: str, robust: str) -> str:
    return f"SELECT date, {r(TABLE)}, '{robust}' AS measures_robust_bp, bp, {S} FROM ft{k}"


def _spread_query(vw: str, cols: dict[str, str]) -> str:
    return f"SELECT {S}, bp, jdate, {r(list(cols))} FROM ({spreads(vw, cols)})"


def _exc(tag: str) -> str:
    return f"SELECT date, ptf_code, round(ret, 9) AS ret, sort_on, {S}, measure_index FROM exc{tag} JOIN legend USING ({S})"


def _month_codes() -> str:
    five = " AND ".join(f"{p} IS NOT NULL" for p in P5)
    return (f"SELECT {S}, jdate, ptf_code, count(*) AS n_rows FROM ("
            f"SELECT {S}, jdate, szport || value || '_' || variable AS ptf_code FROM me2 UNION ALL "
            f"SELECT {S}, jdate, szport || bmport || opport || invport || nfport AS ptf_code FROM mo2 WHERE {five} UNION ALL "
            f"SELECT {S}, jdate, ptf_code FROM rowsb UNION ALL SELECT {S}, jdate, ptf_code FROM rowst) GROUP BY ALL")


def _flat(table: str, variables: list[str], probs: list[float], keys: str, extra: str = "") -> str:
    cols = [f"{v}{round(p * 100)}" for v in variables for p in probs]
    return f"SELECT {keys}{extra}, {r(cols)} FROM {table}"


def _filled() -> str:
    after_codes = ", ".join(f"('{s}{v}_{m}port')" for m in MEAS for v in (LOW[m], HIGH[m]) for s in "SB")
    before_codes = ", ".join(f"('{c}')" for c in FIVE)

    def part(vw: str, codes: str, value: str) -> str:
        return (f"SELECT k.source_file, k.measure, b.date AS jdate, c.ptf_code, {value} AS vwret "
                f"FROM (SELECT DISTINCT {S} FROM {vw}) k CROSS JOIN bench b CROSS JOIN (VALUES {codes}) c(ptf_code) "
                f"LEFT JOIN {vw} v ON v.source_file = k.source_file AND v.measure = k.measure AND v.jdate = b.date "
                f"AND v.ptf_code = c.ptf_code LEFT JOIN (SELECT DISTINCT {S}, jdate FROM {vw}) t "
                f"ON t.source_file = k.source_file AND t.measure = k.measure AND t.jdate = b.date")

    return (f"SELECT {S}, jdate, ptf_code, round(vwret, 9) AS vwret FROM ("
            + part("vw2", after_codes, "coalesce(v.vwret, 0)") + " UNION ALL "
            + part("vwf", before_codes, "CASE WHEN t.jdate IS NOT NULL THEN coalesce(v.vwret, 0) END") + ")")


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    # sources
    o["read_returns"] = "SELECT date, permno, retadj, wt, ffyear, jdate FROM rets"
    o["read_characteristics"] = f"SELECT {_CH16} FROM chars"
    o["read_measures"] = f"SELECT {SP}, nf FROM meas"
    gap = " OR ".join(f"\"{f}\" IS NULL" for f in _PRIO)
    o["parse_benchmark_factors"] = (
        f"SELECT date, {r(['Mkt-RF', 'SMB', 'HML', 'RMW', 'CMA', 'RF'])} FROM bench "
        f"WHERE date < coalesce((SELECT min(date) FROM bench WHERE {gap}), DATE '9999-12-31')")
    cell_names = []
    for a, b in PUBLISHED:
        for i in range(1, 6):
            for j in range(1, 6):
                corner, raw = i in (1, 5) and j in (1, 5), []
                for m, k in ((a, i), (b, j)):
                    if m == "size":
                        raw.append({1: "SMALL", 5: "BIG"}[k] if corner else f"ME{k}")
                    else:
                        raw.append(f"{'Lo' if k == 1 else 'Hi'}{m.upper()}" if corner else f"{m.upper()}{k}")
                cell_names.append(f"('{a}_{b}', '{a}{i}_{b}{j}', '{' '.join(raw)}')")
    cells = f"(VALUES {', '.join(cell_names)}) c(sort_on, code, raw)"
    months = "(SELECT DISTINCT date FROM pub_biv)"
    o["parse_benchmark_portfolios"] = (
        f"SELECT m.date, c.raw AS ptf_code, round(p.ret, 9) AS ret, c.sort_on FROM {months} m CROSS JOIN {cells} "
        "LEFT JOIN pub_biv p ON p.date = m.date AND p.ptf_code = c.code AND p.sort_on = c.sort_on")
    o["clip_to_window"] = ("SELECT jdate AS date, permno, retadj FROM rets, (SELECT min(date) AS a, max(date) AS z FROM bench "
                           "WHERE date <= (SELECT CAST(max(date) AS DATE) FROM rets)) WHERE jdate BETWEEN a AND z")
    grid = ", ".join(f"('{a}_{b}', '{a}{i}_{b}{j}')" for a, b in PUBLISHED for i in range(1, 6) for j in range(1, 6))
    o["benchmark_long"] = (
        f"SELECT m.date, g.ptf_code, p.ret, g.sort_on FROM {months} m CROSS JOIN (VALUES {grid}) g(sort_on, ptf_code) "
        "LEFT JOIN pub_biv p ON p.date = m.date AND p.ptf_code = g.ptf_code AND p.sort_on = g.sort_on")
    o["normalise_portfolio_codes"] = o["benchmark_long"]
    o["month_end"] = " UNION ALL ".join(
        f"SELECT 'measures_{t}' AS source_file, permno, date, make_date(date // 100, 6, 30) AS jdate FROM m_{t}" for t in ("alpha", "beta"))
    o["formation_calendar"] = "SELECT jdate FROM junes"
    o["formation_year"] = "SELECT permno, jdate, CAST(year(jdate) AS INTEGER) AS ffyear FROM chars"
    # sinks
    median = (("2x2", "ft2", "nf2"), ("2x2x2x2x2", "ftf", "nf5"))
    o["write_factors"] = " UNION ALL ".join(
        [f"SELECT replace(source_file, 'measures_', '2x3_factors_') || '_robust(nf)' AS file, date, {r(TABLE, 6)}, "
         "'nf' AS measures_robust_bp, bp, measure FROM ft3r"]
        + [f"SELECT replace(source_file, 'measures_', '{kind}_factors_'), date, {r(TABLE)}, '', bp, measure FROM {ft}" for kind, ft, _ in median])
    quoted = lambda cols: ", ".join(f"\"{c}\"" for c in cols)
    o["write_factor_nfirms"] = " UNION ALL ".join(
        [f"SELECT replace(source_file, 'measures_', '2x3_factors_nfirms_') || '_robust(nf)' AS file, jdate, {quoted(TABLE)}, "
         f"'nf' AS measures_robust_bp, bp, measure FROM nf3 {COMPLETE}"]
        + [f"SELECT replace(source_file, 'measures_', '{kind}_factors_nfirms_'), jdate, "
           f"{quoted(TABLE) if kind != '2x2' else 'NULL, ' + quoted(TABLE[1:])}, '', bp, measure FROM {nf}" for kind, _, nf in median])
    kinds = (("bivariate", "b"), ("three_way", "t"))
    o["write_portfolios"] = " UNION ALL ".join(
        f"SELECT replace(source_file, 'measures_', '{kind}_sorts_test_portfolios_') AS file, date, ptf_code, "
        f"round(ret, 6) AS ret, sort_on, measure_index AS measure FROM exc{t} JOIN legend USING ({S})" for kind, t in kinds)
    o["write_portfolio_nfirms"] = " UNION ALL ".join(
        f"SELECT replace(source_file, 'measures_', '{kind}_sorts_test_portfolios_nfirms_') AS file, jdate AS date, ptf_code, "
        f"n_both AS nfirms, sort_on, measure_index AS measure FROM srt{t} JOIN legend USING ({S})" for kind, t in kinds)
    o["write_legend"] = " UNION ALL ".join(
        f"SELECT replace(source_file, 'measures_', 'measures_legend_{kind}_sorts_test_portfolios_') AS file, "
        "measure, measure_index AS \"index\" FROM legend" for kind, _ in kinds)
    # filters and flags
    for v in ("size", "bm", "inv", "op"):
        o[f"nyse_universe_{v}"] = f"SELECT permno, jdate FROM chars WHERE {U[v]}"
    o["nyse_universe_nf"] = f"SELECT {SP} FROM lng0 WHERE {U['nf']}"
    o["eligibility_flags"] = f"SELECT permno, jdate, {FLAGS_SQL} FROM chars"
    o["nf_eligibility_flag"] = f"SELECT {SP}, is_nf_ok FROM lng0"
    o["drop_degenerate_measures"] = f"SELECT {SP}, nf FROM lng"
    o["min_distinct_guard"] = (
        f"SELECT {SP}, nf FROM lng WHERE nf IS NOT NULL AND ({S}, jdate) IN (SELECT ({S}, jdate) FROM lng "
        f"WHERE {U['nf']} GROUP BY {S}, jdate HAVING count(DISTINCT nf) >= 2)")
    o["drop_unassigned"] = f"SELECT {SP}, {', '.join(P5)} FROM mo2"
    o["require_all_assigned"] = f"SELECT {SP}, {', '.join(P5)} FROM mo2 WHERE " + " AND ".join(f"{p} IS NOT NULL" for p in P5)
    o["null_label_cleanup"] = f"SELECT {SP}, {', '.join(P5)} FROM as2"
    # joins
    o["align_measures"] = f"SELECT {SP}, nf FROM lng0"
    o["common_pairs"] = "SELECT source_file, permno, jdate, exchcd, me, be, op FROM pan"
    o["attach_measure"] = f"SELECT {SP}, me, beme, nf FROM lng0"
    o["combine_breakpoints"] = _flat("bp3", ["bm", "inv", "op"], PCTS, "source_file, jdate", ", round(sizemedn, 9) AS sizemedn")
    o["align_breakpoints"] = f"SELECT {SP}, me, round(size50, 9) AS sizemedn FROM lng LEFT JOIN bph USING (source_file, jdate)"
    o["merge_assignments"] = (
        "SELECT source_file, permno, jdate, " + ", ".join(f"{ntile(COL[v], names(v, Q5))} AS {v}port" for v in ("size", "bm", "op", "inv"))
        + " FROM pan LEFT JOIN bp5 USING (source_file, jdate)")
    o["carry_forward"] = (f"SELECT {S}, r.permno, r.jdate, r.ffyear, r.retadj, r.wt, {', '.join(P5)} FROM rets r LEFT JOIN "
                          "as2 a ON a.permno = r.permno AND a.ffyear = r.ffyear")
    o["on_calendar"] = (f"SELECT k.source_file, k.measure, b.date AS jdate, round(m.Mkt, 9) AS \"Mkt\" FROM "
                        f"(SELECT DISTINCT {S} FROM mk2) k CROSS JOIN bench b LEFT JOIN mk2 m ON m.jdate = b.date "
                        "AND m.source_file = k.source_file AND m.measure = k.measure")
    pub = ["Mkt-RF", "SMB", "HML", "RMW", "CMA"]
    factor_kinds = (("2x3", "ft3r"), ("2x2", "ft2"), ("2x2x2x2x2", "ftf"))
    o["compare_factors"] = " UNION ALL ".join(
        "SELECT f.date, " + ", ".join(f"round(f.\"{c}\", 9) AS \"{c}\"" for c in TABLE) + ", "
        + ", ".join(f"round(b.\"{c}\", 9) AS \"{c}_orig\"" for c in pub)
        + f", b.RF, f.bp, f.source_file, f.measure, '{kind}' AS kind FROM {ft} f JOIN bench b ON b.date = f.date" for kind, ft in factor_kinds)
    cmp_sql = ("SELECT p.date, p.ptf_code, e.source_file, e.measure, {0}, e.sort_on AS sort_on_x, p.sort_on AS sort_on_y "
               "FROM pub_{2} p LEFT JOIN exc{1} e ON e.date = p.date AND e.ptf_code = p.ptf_code")
    o["compare_portfolios"] = " UNION ALL ".join(cmp_sql.format("round(e.ret, 9) AS ret_x, p.ret AS ret_y", *x) for x in (("b", "biv"), ("t", "thr")))
    # breakpoints
    o["size_median"] = f"SELECT source_file, jdate, round(size50, 9) AS sizemedn FROM bph"
    o["char_breakpoints"] = (f"SELECT source_file, jdate, {r([f'{v}{round(p * 100)}' for v in ('bm', 'inv', 'op') for p in PCTS])} "
                             f"FROM (SELECT source_file, jdate, {edge_cols(['bm', 'inv', 'op'], PCTS)} FROM lc "
                             f"WHERE {has_any(['bm', 'inv', 'op'])})")
    o["nf_breakpoints"] = _flat("nbp", ["nf"], PCTS, f"{S}, jdate")
    o["char_medians"] = (f"SELECT source_file, jdate, {r(['bm50', 'inv50', 'op50'])} FROM (SELECT source_file, jdate, "
                         f"{edge_cols(['bm', 'inv', 'op'], [0.5])} FROM lc WHERE {has_any(['bm', 'inv', 'op'])})")
    o["nf_median"] = f"SELECT {S}, jdate, round(nf50, 9) AS nf50 FROM nbp"
    o["quintile_edges"] = _flat("bp5", ["size", "bm", "op", "inv"], Q5, "source_file, jdate")
    o["size_half_edges"] = "SELECT source_file, jdate, round(size50, 9) AS size50 FROM bph"
    o["conditional_quartile_edges"] = _flat("bp4", ["bm", "inv", "op"], Q4, "source_file, jdate, sizeport")
    o["nf_edges_epsilon"] = f"SELECT {S}, jdate, " + ", ".join(
        f"round(nf{round(p * 100)}, 13) AS nf{round(p * 100)}" for p in Q5) + f" FROM (SELECT {S}, jdate, {lowered(Q5)} FROM ln WHERE l_nf IS NOT NULL)"
    # assignment
    o["assign_size_2"] = f"SELECT {SP}, szport FROM as3"
    o["assign_2way"] = f"SELECT {SP}, {', '.join(P5[1:])} FROM as2"
    o["assign_3way"] = f"SELECT {SP}, {', '.join(P5[1:])} FROM as3"
    o["assign_3way_robust"] = f"SELECT {SP}, {', '.join(RPORTS)} FROM as3"
    o["assign_ntile_independent"] = f"SELECT {SP}, {', '.join(N5[:4])} FROM as5"
    o["assign_nf_ntile"] = f"SELECT {SP}, nfport FROM as5"
    o["assign_size_half"] = "SELECT source_file, permno, jdate, sizeport FROM szd"
    o["assign_ntile_dependent"] = f"SELECT {SP}, {', '.join(N5[:4])} FROM as4"
    o["assign_nf_ntile_dependent"] = f"SELECT {SP}, nfport FROM as4"
    o["june_assignments"] = f"SELECT {S}, permno, ffyear, {', '.join(P5)} FROM as2"
    # portfolios
    o["sort_combinations"] = " UNION ALL ".join(
        "SELECT sort_on, CAST(sum(n_rows) AS BIGINT) AS n_rows, count(DISTINCT ptf_code) AS n_cells "
        f"FROM {t} GROUP BY sort_on" for t in ("srtb", "srtt"))
    by = ", ".join(RPORTS)
    o["select_bp_columns"] = " UNION ALL ".join(
        f"SELECT {S}, '{bp}' AS bp, jdate, szport, bmport, opport, invport, nfport_{bp} AS nfport, n_rows, n_ret FROM "
        f"(SELECT {S}, jdate, {by}, count(*) AS n_rows, count(retadj) AS n_ret FROM mo3r GROUP BY {S}, jdate, {by}) "
        f"WHERE coalesce(szport, bmport, opport, invport, nfport_{bp}) IS NOT NULL" for bp in ROBUST_SETS)
    cube2 = f"(SELECT {S}, jdate, {', '.join(P5)}, count(*) AS n_rows, count(wt) AS n_wt FROM mo2 GROUP BY ALL)"
    o["melt_buckets"] = " UNION ALL ".join(
        f"SELECT {S}, jdate, szport, '{m}port' AS variable, {m}port AS value, n_rows, n_wt FROM {cube2} "
        f"WHERE szport IS NOT NULL AND {m}port IS NOT NULL" for m in MEAS)
    money = "round(retadj_x_wt, 8) AS retadj_x_wt, round(wt, 4) AS wt, round(vwret, 9) AS vwret"
    o["vw_return_2x3"] = f"SELECT {S}, bp, jdate, szport, value, variable, ptf_code, {money} FROM vw3r"
    o["vw_return_2x2"] = f"SELECT {S}, jdate, szport, value, variable, ptf_code, {money} FROM vw2"
    o["vw_return_5way"] = f"SELECT {S}, jdate, {', '.join(P5)}, ptf_code, {money} FROM vwf"
    o["vw_return_bivariate"] = f"SELECT {S}, sort_on, jdate, ptf_code, {money} FROM srtb"
    o["vw_return_threeway"] = f"SELECT {S}, sort_on, jdate, ptf_code, {money} FROM srtt"
    o["portfolio_code"] = _month_codes()
    o["pivot_portfolios"] = f"SELECT {S}, jdate, " + ", ".join(
        f"round(max(vwret) FILTER (WHERE ptf_code = '{c}'), 9) AS {c}" for c in FIVE) + f" FROM vwf GROUP BY {S}, jdate"
    o["completeness_check"] = " UNION ALL ".join(
        f"SELECT {S}, bp, '{kind}' AS kind FROM {vw} GROUP BY {S}, bp HAVING count(DISTINCT ptf_code) = {n}"
        for kind, vw, n in (("2x3", "vw3r", 24), ("2x2", "vw2", 16), ("2x2x2x2x2", "vwf", 32)))
    o["fill_missing_cells"] = _filled()
    o["excess_returns"] = f"SELECT date, ptf_code, round(ret, 9) AS ret, sort_on, {S} FROM excb"
    o["wavg_market_return"] = f"SELECT {S}, jdate, round(Mkt, 9) AS \"Mkt\" FROM mk2"
    o["market_excess"] = (f"SELECT k.source_file, k.measure, b.date AS jdate, round(m.Mkt - b.RF, 9) AS \"Mkt-RF\" FROM "
                          f"(SELECT DISTINCT {S} FROM mk2) k CROSS JOIN bench b LEFT JOIN mk2 m ON m.jdate = b.date "
                          "AND m.source_file = k.source_file AND m.measure = k.measure")
    o["portfolios_long"] = " UNION ALL ".join(
        f"SELECT {S}, jdate, ptf_code, round(vwret, 9) AS ret, sort_on, measure_index FROM srt{t} JOIN legend USING ({S})" for t in "bt")
    # factors
    for name, m in (("hml", "bm"), ("cma", "inv"), ("rmw", "op"), ("xmy", "nf")):
        o[f"{name}_2x3"] = _spread_query("vw3r", {F_OF[m]: hedge(m)})
    o["smb_parts_2x3"] = _spread_query("vw3r", {f"SMB_{m.upper()}": smb_part(m) for m in ("bm", "inv", "op", "nf")})
    o["smb_2x3"] = _spread_query("vw3r", {"SMB": smb_all(True)})
    o["hml_cma_rmw_xmy_2x2"] = _spread_query("vw2", {F_OF[m]: hedge(m) for m in MEAS})
    o["smb_2x2"] = _spread_query("vw2", {"SMB": smb_all(False)})
    o["factors_2x2x2x2x2"] = _spread_query("vwf", COLSF)
    o["factor_table"] = f"SELECT date, {r(TABLE)}, {S} FROM ftf"
    # diagnostics
    o["measure_coverage_summary"] = (
        f"SELECT {S}, min(n) AS min, max(n) AS max, CAST(floor(avg(n)) AS BIGINT) AS mean FROM "
        f"(SELECT {S}, jdate, count(nf) AS n FROM lng0 GROUP BY {S}, jdate) GROUP BY {S}")
    o["common_pair_count"] = "SELECT source_file, count(*) AS n_pairs FROM pan GROUP BY source_file"
    o["missing_pct"] = f"SELECT {S}, " + ", ".join(
        f"round({pct(f'count(*) FILTER (WHERE {c} IS NULL)', 'count(*)')}, 9) AS {c}" for c in ("beme", "inv", "op", "nf")
    ) + f" FROM lng GROUP BY {S}"
    flags = list(FLAG.values())
    o["good_measure_counts"] = f"SELECT {S}, jdate, " + ", ".join(
        f"CAST(sum({f}) AS BIGINT) AS {f}" for f in flags) + f", count(*) AS n_rows FROM lng GROUP BY {S}, jdate"
    o["good_measure_pct"] = f"SELECT {S}, jdate, " + ", ".join(
        f"round({pct(f'sum({f})', 'count(*)')}, 9) AS {f}" for f in flags) + f" FROM lng GROUP BY {S}, jdate"
    o["size_nf_cell_counts"] = f"SELECT {S}, ffyear, " + ", ".join(
        f"nullif(count(*) FILTER (WHERE szport = '{s}' AND nfport = '{v}'), 0) AS {s}_{v}"
        for s in "SB" for v in "YNX") + f" FROM as3 GROUP BY {S}, ffyear"
    o["portfolio_group_count"] = (f"SELECT {S}, count(DISTINCT szport || bmport || opport || invport || nfport) AS n_groups "
                                  f"FROM as2 GROUP BY {S}")
    o["portfolios_per_date"] = f"SELECT {S}, sort_on, jdate, count(DISTINCT ptf_code) AS n_portfolios FROM srtb GROUP BY {S}, sort_on, jdate"
    o["misassigned_check"] = " UNION ALL ".join(f"SELECT {S}, '{kind}' AS kind, " + ", ".join(
        f"CAST(count(DISTINCT CASE WHEN {FLAG[m]} = 0 THEN {m}port END) AS INTEGER) AS {m}_misassigned"
        for m in ("size", "bm", "op", "inv")) + f" FROM {t} GROUP BY {S}" for kind, t in (("bivariate", "as5"), ("three_way", "as4")))
    tq = ", ".join(f"\"{c}\"" for c in TABLE)
    o["factor_nfirms_2x3"] = f"SELECT {S}, bp, jdate, {tq} FROM nf3"
    o["factor_nfirms_2x2"] = f"SELECT {S}, jdate, {', '.join(TABLE[1:])} FROM nf2"
    o["factor_nfirms_5way"] = f"SELECT {S}, jdate, {tq} FROM nf5"
    o["factor_coverage_pct"] = " UNION ALL ".join(
        f"SELECT n.source_file, n.measure, n.bp, '{kind}' AS kind, " + ", ".join(
            f"round(avg({pct('n.' + chr(34) + c + chr(34), 't.month_rows')}), 6) AS \"{c}\"" if kind != "2x2" or c != TABLE[0] else f"NULL AS \"{c}\""
            for c in TABLE)
        + f" FROM {nf} n JOIN (SELECT {S}, jdate, count(*) AS month_rows FROM {mo} GROUP BY {S}, jdate) t "
        "ON t.source_file = n.source_file AND t.measure = n.measure AND t.jdate = n.jdate GROUP BY 1, 2, 3"
        for kind, nf, mo in (("2x3", "nf3", "mo3r"), ("2x2", "nf2", "mo2"), ("2x2x2x2x2", "nf5", "mo2")))
    o["portfolio_nfirms"] = " UNION ALL ".join(
        f"SELECT jdate AS date, ptf_code, n_both AS nfirms, sort_on, {S} FROM srt{t}" for t in "bt")
    o["portfolio_coverage_pct"] = " UNION ALL ".join(
        f"SELECT {S}, sort_on, round(avg(share), 6) AS coverage_pct FROM (SELECT {S}, sort_on, jdate, "
        f"sum({pct('n_both', 'month_rows')}) AS share FROM srt{t} JOIN (SELECT {S}, jdate, count(*) AS month_rows "
        f"FROM {mo} GROUP BY {S}, jdate) USING ({S}, jdate) GROUP BY {S}, sort_on, jdate) GROUP BY {S}, sort_on"
        for t, mo in (("b", "mo5"), ("t", "mo4")))
    o["factor_correlations"] = " UNION ALL ".join(f"SELECT f.source_file, f.measure, f.bp, '{kind}' AS kind, " + ", ".join(
        f"round(corr(b.\"{c}\", f.\"{c}\"), 8) AS \"{c}\"" for c in pub)
        + f" FROM {ft} f JOIN bench b ON b.date = f.date GROUP BY 1, 2, 3" for kind, ft in factor_kinds)
    o["portfolio_correlations"] = " UNION ALL ".join(
        f"SELECT {S}, sort_on_x AS sort_on, round(corr(ret_x, ret_y), 8) AS corr FROM ("
        + cmp_sql.format("e.ret AS ret_x, p.ret AS ret_y", t, p) + f") WHERE sort_on_x IS NOT NULL GROUP BY {S}, sort_on_x"
        for t, p in (("b", "biv"), ("t", "thr")))
    o["date_range_summary"] = " UNION ALL ".join(
        f"SELECT {S}, sort_on, count(DISTINCT date) AS n_dates, count(DISTINCT ptf_code) AS n_series, "
        f"min(date) AS min_date, max(date) AS max_date FROM exc{t} GROUP BY {S}, sort_on" for t in "bt")
    # assembly and jobs
    o["tag_and_union_factors"] = _job("3r", "nf")
    o["tag_and_union_nfirms"] = f"SELECT {S}, bp, jdate, {tq}, 'nf' AS measures_robust_bp FROM nf3 {COMPLETE}"
    o["measures_legend"] = "SELECT source_file, measure, measure_index AS \"index\" FROM legend"
    o["stack_portfolios"] = _exc("t")
    o["job_factors_2x3"] = _job("3r", "nf")
    o["job_factors_2x3_default_sets"] = _job("3", "")
    o["job_factors_2x3_all_robust"] = _job("3a", "bm_inv_op_nf")
    o["job_factors_2x2"] = _job("2", "")
    o["job_factors_2x2x2x2x2"] = _job("f", "")
    o["job_factors_2x2_colocated"] = o["job_factors_2x2"]
    o["job_factors_2x3_increments"] = o["job_factors_2x3"]
    o["job_bivariate_portfolios_colocated"] = _exc("b")
    paid = "sum(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 0.7390851332151607::DOUBLE)"
    o["exact_sums"] = (f"SELECT l_partkey, round({paid}, 5) AS paid, count(*) AS n FROM lineitem GROUP BY l_partkey "
                       f"UNION ALL SELECT NULL, round({paid}, 5), count(*) FROM lineitem")
    o["job_bivariate_portfolios"] = _exc("b")
    o["job_threeway_portfolios"] = _exc("t")
    return {name: sql(body) for name, body in (o | panel_oracles.queries()).items()}
