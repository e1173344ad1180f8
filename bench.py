"""Headline jobs on ``$BENCH_SF_DIR`` with ``$BENCH_CPUS`` cores; prints one JSON line.

The input tables are derived and landed first (reported as ``inputs``, not part of the total).
``panel`` aligns them once for all jobs, as the runner does; a job's time covers breakpoints,
assignment, the monthly join and the collected output.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from sortfolio.plans import jobs
from sortfolio.session import build_session
from verification import fixtures

JOBS = {
    "job_factors_2x3": lambda i, p: jobs.job_factors_2x3(i, panel=p).factors,
    "job_factors_2x2": lambda i, p: jobs.job_factors_2x2(i, panel=p).factors,
    "job_factors_2x2x2x2x2": lambda i, p: jobs.job_factors_2x2x2x2x2(i, panel=p).factors,
    "job_bivariate_portfolios": lambda i, p: jobs.job_bivariate_portfolios(i, panel=p).portfolios,
    "job_threeway_portfolios": lambda i, p: jobs.job_threeway_portfolios(i, panel=p).portfolios,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="bench-")})
    start = time.time()
    inputs = fixtures.inputs(spark, sf_dir)
    prepared = round(time.time() - start, 3)
    times, rows = {}, {}
    start = time.time()
    panel = jobs.prepare_panel(inputs)
    times["panel"] = round(time.time() - start, 3)
    for name, job in JOBS.items():
        start = time.time()
        rows[name] = len(job(inputs, panel).toPandas())
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_jobs_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "inputs": prepared, "rows": rows, "sf": sf_dir.rstrip("/").split("sf")[-1], "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
