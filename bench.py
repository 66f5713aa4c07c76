"""Benchmark: seed the stored tables once, then time the headline queries on them.

Prints one JSON line. ``seed_sources`` maps the test tables to stored finance tables,
``seed_derived`` computes and stores the derived tables; both count toward the total.
Queries whose name starts with ``raw_`` start from the unseeded test tables.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from yardbook.plans.registry import QUERIES  # noqa: E402
from yardbook.session import local_session  # noqa: E402
from yardbook.sources.testdata import finance_catalog  # noqa: E402
from yardbook.sources.writers import materialise, store_sources  # noqa: E402

HEADLINE = [
    "revenue_by_month_type",
    "top_jobs_revenue",
    "wip_over_threshold",
    "underbilled",
    "overbilled",
    "job_margin_report",
    "asset_utilisation",
    "rain_off_impact",
    "float_share",
    "gst_recon",
    "withholding_summary",
    "bas_summary",
    "super_compliance",
    "payroll_tax",
    "ftc_summary",
    "open_exceptions",
    "mom_trend",
    "customer_ranking",
    "cost_mix",
    "operator_hours",
    "journal_pack",
    "job_profit_period",
    "myob_recon",
    "exception_scan",
    "float_required_by_site",
    "overview_kpis",
    "forecast_variance",
]
RAW = ["revenue_engine", "wip_summary", "job_profit_table"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("yardbook-bench")
    seconds: dict[str, float] = {}

    def timed(name, work):
        start = time.perf_counter()
        result = work()
        seconds[name] = round(time.perf_counter() - start, 3)
        return result

    raw = finance_catalog(spark, sf_dir)
    run(raw["rate_card"])  # start the session's workers before the clock runs
    base = os.environ.get("BENCH_FOLDER")  # a shared folder where the session is not local
    with tempfile.TemporaryDirectory(prefix="yardbook-bench-", dir=base) as folder:
        tables = timed("seed_sources", lambda: store_sources(raw, folder))
        tables = timed("seed_derived", lambda: materialise(tables, folder))
        for name in HEADLINE:
            timed(name, lambda name=name: run(QUERIES[name](tables)))
        for name in RAW:
            timed(f"raw_{name}", lambda name=name: run(QUERIES[name](finance_catalog(spark, sf_dir))))
        spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
