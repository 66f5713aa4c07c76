"""Summary reports that draw on several areas."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardbook.config import DEFAULT_RULES, Rules
from yardbook.functions import money
from yardbook.functions.periods import in_period
from yardbook.functions.scalars import side_by_side
from yardbook.operators.billing import wip_ageing
from yardbook.operators.exceptions import dashboard_exceptions, exception_scan
from yardbook.operators.forecast import forecast_variance_scenario
from yardbook.operators.journals import balance_of, journal_pack_period, journal_wide
from yardbook.operators.profit import asset_unit_economics, job_profit, job_profit_lines
from yardbook.operators.tax import bas_period, ftc_period, payg_register, payroll_compliance
from yardbook.sources.catalog import Catalog


def period_bundle(
    tables: Catalog, period: str | date, as_of: str | date, **scenario
) -> dict[str, DataFrame]:
    """All frames of the period dashboard, lazy, under their names.

    ``scenario`` takes the forecast assumptions of ``forecast_variance_scenario``.
    """
    return {
        "revenue": in_period(tables["revenue_engine"], "usage_date", period),
        "invoices": in_period(tables["invoice_myob"], "invoice_date", period),
        "wip": wip_ageing(tables, as_of),
        "job_profit": job_profit(tables),
        "asset_profit": asset_unit_economics(tables),
        "bas": bas_period(tables, period),
        "payg": payg_register(tables, period),
        "payroll": payroll_compliance(tables, period),
        "ftc": ftc_period(tables, period),
        "journals": journal_wide(tables, period),
        "exceptions": dashboard_exceptions(tables, period, as_of),
        "forecast_variance": forecast_variance_scenario(tables, period, **scenario),
    }


def overview_kpis(
    tables: Catalog, period: str | date, as_of: str | date, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """Headline figures of one month as one row; unbilled revenue covers all dates."""

    def total(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.agg(money.cents(F.sum(column)).alias(name))

    positive = tables["wip_summary"].select(F.greatest("wip_cents", F.lit(0).cast("bigint")).alias("wip"))
    issues = dashboard_exceptions(tables, period, as_of, rules)
    revenue, profit = F.col("revenue_cents"), F.col("profit_cents")
    return (
        side_by_side(
            total(in_period(tables["revenue_engine"], "usage_date", period), "total_revenue_cents", "revenue_cents"),
            total(in_period(tables["invoice_myob"], "invoice_date", period), "amount_ex_gst_cents", "invoiced_cents"),
            total(positive, "wip", "wip_cents"),
            total(in_period(tables["costs"], "cost_date", period), "amount_cents", "cost_cents"),
            issues.agg(F.count_if(F.col("severity") == "HIGH").alias("high_exceptions")),
            bas_period(tables, period).select(F.col("Net GST").alias("net_gst_cents")),
            balance_of(journal_pack_period(tables, period, rules)).select("balanced"),
        )
        .withColumn("profit_cents", revenue - F.col("cost_cents"))
        .select(
            "revenue_cents",
            "invoiced_cents",
            "wip_cents",
            "cost_cents",
            "profit_cents",
            money.margin(profit, revenue, 2).alias("margin_pct"),
            "high_exceptions",
            F.when(F.col("balanced"), "BALANCED").otherwise("CHECK").alias("journal_status"),
            F.when(F.col("net_gst_cents") >= 0, "OK").otherwise("CHECK").alias("bas_status"),
        )
    )


def period_summary(
    tables: Catalog, period: str | date, as_of: str | date, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """Ten labelled figures of one month (cents, except the margin and the exception count)."""
    profit = job_profit_lines(tables, period).agg(
        *[money.cents(F.sum(c)).alias(c) for c in ("revenue", "total", "profit")]
    )
    open_count = exception_scan(tables, period, as_of, rules).agg(F.count("*").alias("exceptions"))
    row = side_by_side(profit, bas_period(tables, period).select("G1", "1A", "1B", "Net GST", "W4"), open_count)
    # Label and figure of each line.
    lines = [
        ("Revenue ex-GST", F.col("revenue")),
        ("Direct costs", F.col("total")),
        ("Profit", F.col("profit")),
        ("Margin %", money.margin(F.col("profit"), F.col("revenue"), 2)),
        ("BAS G1", F.col("G1")),
        ("BAS 1A", F.col("1A")),
        ("BAS 1B", F.col("1B")),
        ("Net GST", F.col("Net GST")),
        ("PAYG W4", F.col("W4")),
        ("Open exceptions", F.col("exceptions")),
    ]
    entries = [
        F.struct(F.lit(i).alias("line_no"), F.lit(label).alias("label"), value.cast("decimal(26,2)").alias("value"))
        for i, (label, value) in enumerate(lines, start=1)
    ]
    return row.select(F.inline(F.array(*entries))).orderBy("line_no")
