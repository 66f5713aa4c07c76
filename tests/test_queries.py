"""Every registered query against independent SQL over the same tables."""

import os

import pytest
from compare import differences

import __spark_entry__ as entry_points
from yardbook.plans.oracle import statements
from yardbook.plans.registry import QUERIES

SQL = statements()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_stored_sources(name, stored, sql):
    assert differences(QUERIES[name](stored), sql, SQL[name]) == []


@pytest.mark.parametrize(
    "name",
    [
        "asset_utilisation", "bas_summary", "customer_ranking", "exception_scan_period", "gst_recon",
        "job_margin_report", "job_profit_period", "journal_pack", "mom_trend", "open_exceptions",
        "rain_off_impact", "revenue_detail", "wip_summary",
    ],
)
def test_query_on_stored_derived_tables(name, seeded, sql):
    assert differences(QUERIES[name](seeded), sql, SQL[name]) == []


@pytest.mark.parametrize("name", ["revenue_engine", "wip_by_job", "top_jobs_revenue", "payroll_compliance"])
def test_entry_point_on_test_tables(name, spark, sql):
    df = entry_points.queries()[name](spark, SF_DIR)
    assert differences(df, sql, SQL[name]) == []


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() > 0
