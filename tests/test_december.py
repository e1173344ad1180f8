"""December equity over hand-made histories."""

from __future__ import annotations

import datetime as dt

from sortfolio.operators import intervals
from sortfolio.plans import panel
from tests.conftest import day


def test_december_equity_sorts_one_row_a_year(spark, monkeypatch):
    """Only the last row of a year can be the one as of its end; equal dates, missing equity, keys and dates among the rows."""
    monthly = [(1, day("2000-11-30"), 4.0), (1, day("2000-12-31"), 7.0), (1, day("2000-12-31"), 9.0), (1, day("2001-10-31"), 3.0), (1, day("2001-12-31"), None),
               (2, day("1999-03-31"), 5.0), (None, day("2000-12-31"), 8.0), (3, None, 8.0), (3, day("2001-01-31"), 2.0), (3, day("2001-02-28"), float("nan"))]
    june = [(f, day(f"{y}-06-30")) for f in (1, 2, 3, None) for y in (2000, 2001, 2002)] * 2 + [(1, None)]
    histories, as_of = [], intervals.as_of
    monkeypatch.setattr(panel.intervals, "as_of", lambda points, history, *more: (histories.append(history), as_of(points, history, *more))[1])
    for bound in (None, 0, 70):
        got = panel.december_equity(spark.createDataFrame(june, "firm BIGINT, date DATE"), spark.createDataFrame(monthly, "firm BIGINT, date DATE, me DOUBLE"), bound)
        assert got.columns == ["firm", "date", "dec_date", "dec_me"]
        want = []
        for firm, date in june:
            end = date and dt.date(date.year - 1, 12, 31)
            known = [(d, m) for f, d, m in monthly if firm is not None and f == firm and d and end and m is not None and d <= end and (bound is None or (end - d).days <= bound)]
            want.append((firm, date, *max(known, key=lambda x: (x[0], x[1] != x[1], x[1]), default=(None, None))))
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    dated = [r for r in histories[0].collect() if r.firm is not None and r.dec_date is not None]
    assert len(dated) == len({(r.firm, r.dec_date.year) for r in dated}) == 4
