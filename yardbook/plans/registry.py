"""Named queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yardbook.functions.periods import MONTH_KEY, in_months, in_period, month_start
from yardbook.functions.scratch import kept, session_folder
from yardbook.operators import billing, exceptions, forecast, journals, overview, profit, quality, revenue, tax
from yardbook.sources.catalog import Catalog
from yardbook.sources.readers import coerce_table
from yardbook.sources.refresh import Refreshed, refresh_usage
from yardbook.sources.store import TableStore
from yardbook.sources.testdata import finance_catalog
from yardbook.sources.writers import build_derived, store_sources

PERIOD = date(1998, 6, 1)
AS_OF = date(2001, 12, 31)

Query = Callable[[Catalog], DataFrame]


def _period_filter(t: Catalog) -> DataFrame:
    columns = ["usage_id", "job_id", "asset_id", "usage_date", "hours_worked"]
    return in_period(t["usage_log"], "usage_date", PERIOD).select(*columns)


def _detail_filter(t: Catalog) -> DataFrame:
    detail = revenue.revenue_detail(t, PERIOD)
    return revenue.revenue_detail_filter(detail, date(1998, 6, 5), date(1998, 6, 25), status="Underbilled")


def _scenario(t: Catalog) -> DataFrame:
    return forecast.forecast_variance_scenario(t, PERIOD, utilisation_pct=0.8, days=26, rate_adjustment_pct=2.5)


def _one_sided_journal(t: Catalog) -> DataFrame:
    pack = journals.journal_pack_period(t, PERIOD).where("account_name <> 'Hire Revenue'")
    return exceptions.journal_issues(pack, PERIOD)


def _exception_filter(t: Catalog) -> DataFrame:
    scan = exceptions.exception_scan(t, None, AS_OF)
    return exceptions.exception_filter(scan, ["HIGH", "MEDIUM"], ["costs", "fuel_tax_credit"], ["Open"])


def _resolutions(t: Catalog) -> DataFrame:
    log = kept(t["exception_log"].withColumnRenamed("severity", "status").drop("message"), "exception_log")
    return exceptions.apply_resolutions(log, log.where("exception_type = 'ORPHAN_COST'"))


def _staging_diff(t: Catalog) -> DataFrame:
    return quality.staging_diff(revenue.revenue_engine(t, hour_rounding="ceil"), t["revenue_engine"])


def _missing_rate_cards(t: Catalog) -> DataFrame:
    return quality.missing_rate_cards(t.with_tables(rate_card=t["rate_card"].where("hourly_rate_cents >= 20000")))


def _refreshed(t: Catalog) -> tuple[TableStore, Refreshed]:
    """A store of usage and revenue in which the usage of one month is replaced: eight hours more on each row."""
    store = TableStore(t.spark, session_folder(t.spark, "refresh"))
    names = ("usage_log", "rate_card", "job_rates")
    tables = store_sources(Catalog(t.spark, {name: t[name].drop(MONTH_KEY) for name in names}), store.folder)
    with store.change() as change:
        build_derived(change, tables, ["revenue_engine"], numbered=False)
    longer = in_period(tables["usage_log"], "usage_date", PERIOD)
    longer = longer.withColumn("hours_worked", (F.col("hours_worked") + 8).cast("decimal(5,1)")).drop(MONTH_KEY)
    return store, refresh_usage(store, longer, [PERIOD])


def _revenue_after_refresh(t: Catalog) -> DataFrame:
    store, _ = _refreshed(t)
    return store.read("revenue_engine").select(*revenue.REVENUE_COLUMNS)


def _refreshed_months(t: Catalog) -> DataFrame:
    """Months with the rows and the revenue that the refresh wrote anew."""
    store, done = _refreshed(t)
    rows = in_months(store.read("revenue_engine"), "usage_date", done.revenue_months)
    return rows.groupBy(month_start(F.col("usage_date")).alias("month_start")).agg(
        F.count("*").alias("rows"), F.sum("total_revenue_cents").alias("revenue_cents")
    )


def _coerce_table(t: Catalog) -> DataFrame:
    """Invoices as text with broken dates and amounts, read leniently."""
    invoices = t["invoice_myob"]
    number = F.expr("cast(substr(job_id, 2) as bigint)")
    text = invoices.select(*[F.col(c).cast("string").alias(c) for c in invoices.columns])
    broken = text.withColumn(
        "invoice_date", F.when(number % 17 == 0, "soon").otherwise(F.col("invoice_date"))
    ).withColumn("amount_ex_gst_cents", F.when(number % 13 == 0, "n/a").otherwise(F.col("amount_ex_gst_cents")))
    return coerce_table(broken, "invoice_myob")


QUERIES: dict[str, Query] = {
    # revenue
    "term_hours": revenue.term_hours,
    "billable_hours": revenue.billable_hours,
    "rate_selection": revenue.rate_selection,
    "float_fee": revenue.float_fee,
    "revenue_engine": revenue.revenue_engine,
    "revenue_id_seq": revenue.revenue_id_seq,
    "float_required_by_site": revenue.float_required_by_site,
    "period_filter": _period_filter,
    "revenue_by_month_type": revenue.revenue_by_month_type,
    "top_jobs_revenue": revenue.top_jobs_revenue,
    "rain_off_impact": revenue.rain_off_impact,
    "float_share": revenue.float_share,
    "mom_trend": revenue.mom_trend,
    "customer_ranking": profit.customer_ranking,
    "revenue_trend": revenue.revenue_trend,
    "revenue_by_type": lambda t: revenue.revenue_by_type(t, PERIOD),
    "top5_jobs": lambda t: revenue.top5_jobs(t, PERIOD),
    "available_periods": revenue.available_periods,
    "revenue_detail": lambda t: revenue.revenue_detail(t, PERIOD),
    "revenue_detail_filter": _detail_filter,
    "revenue_detail_totals": lambda t: revenue.revenue_detail_totals(t, PERIOD),
    "overview_kpis": lambda t: overview.overview_kpis(t, PERIOD, AS_OF),
    "period_summary": lambda t: overview.period_summary(t, PERIOD, AS_OF),
    # work in progress and billing
    "wip_summary": billing.wip_summary,
    "wip_over_threshold": billing.wip_over_threshold,
    "underbilled": billing.underbilled,
    "overbilled": billing.overbilled,
    "billing_status": billing.billing_status,
    "wip_ageing": lambda t: billing.wip_ageing(t, AS_OF),
    "wip_by_job": lambda t: billing.wip_by_job(t, AS_OF),
    "wip_by_customer": lambda t: billing.wip_by_customer(t, AS_OF),
    "billing_candidates": lambda t: billing.billing_candidates(t, AS_OF),
    "billing_variance_exceptions": lambda t: billing.billing_variance_exceptions(
        t["revenue_engine"], t["invoice_myob"]
    ),
    "billing_run": billing.billing_run,
    # cost and profit
    "direct_costs": profit.direct_costs,
    "maintenance_per_hour": profit.maintenance_per_hour,
    "transport_per_job": profit.transport_per_job,
    "job_profit_table": profit.job_profit_table,
    "asset_profit_table": profit.asset_profit_table,
    "job_profit": profit.job_profit,
    "job_profit_period": lambda t: profit.job_profit(t, PERIOD),
    "asset_profit": lambda t: profit.asset_profit(t, PERIOD),
    "job_margin_report": profit.job_margin_report,
    "cost_mix": profit.cost_mix,
    "operator_hours": profit.operator_hours,
    "asset_unit_economics": profit.asset_unit_economics,
    "cost_gst_fields": profit.cost_gst_fields,
    # forecast
    "working_days": forecast.working_days,
    "forecast_assumptions": forecast.forecast_assumptions,
    "build_forecast": lambda t: forecast.build_forecast(forecast.forecast_input(t)),
    "forecast_variance": lambda t: forecast.forecast_variance_period(t, PERIOD),
    "forecast_variance_scenario": _scenario,
    "forecast_bridge": lambda t: forecast.forecast_bridge(_scenario(t)),
    "asset_utilisation": forecast.asset_utilisation,
    # tax, payroll and reconciliation
    "bas_check_lines": tax.bas_check_lines,
    "bas_summary": tax.bas_summary,
    "bas_period": lambda t: tax.bas_period(t, PERIOD),
    "bas_field_check": lambda t: tax.bas_field_check(t, PERIOD, tax.ledger_tax_fields(t, PERIOD)),
    "gl_extract": tax.gl_extract,
    "gst_recon": tax.gst_recon,
    "myob_recon": lambda t: tax.myob_recon(t, PERIOD),
    "withholding_summary": tax.withholding_summary,
    "payg_register": lambda t: tax.payg_register(t, PERIOD),
    "payg_totals": lambda t: tax.payg_totals(t, PERIOD),
    "abn_withholding": lambda t: tax.abn_withholding(t, numbered=True),
    "super_compliance": tax.super_compliance,
    "payroll_tax": tax.payroll_tax,
    "payroll_compliance": tax.payroll_compliance,
    "payroll_tax_allocation": tax.payroll_tax_allocation,
    "payroll_totals": lambda t: tax.payroll_totals(t, PERIOD),
    "fuel_tax_credit": lambda t: tax.fuel_tax_credit(t, numbered=True),
    "ftc_summary": tax.ftc_summary,
    "ftc_period": lambda t: tax.ftc_period(t, PERIOD),
    "ftc_stale": lambda t: tax.ftc_stale(t, AS_OF),
    # journals
    "journal_pack": lambda t: journals.journal_pack(t, AS_OF),
    "journal_balance": lambda t: journals.journal_balance(t, AS_OF),
    "journal_pack_period": lambda t: journals.journal_pack_period(t, PERIOD),
    "assert_balanced": lambda t: journals.balance_of(journals.journal_pack_period(t, PERIOD)),
    "journal_wide": lambda t: journals.journal_wide(t, PERIOD),
    # exceptions
    "exception_scan": lambda t: exceptions.exception_scan(t, None, AS_OF),
    "exception_scan_period": lambda t: exceptions.exception_scan(t, PERIOD, AS_OF),
    "billing_issues": lambda t: exceptions.billing_issues(t, None, AS_OF),
    "missing_withholding": lambda t: exceptions.missing_withholding(t, PERIOD),
    "orphan_costs": lambda t: exceptions.orphan_costs(t, PERIOD),
    "journal_imbalance": _one_sided_journal,
    "payroll_variance": lambda t: exceptions.payroll_issues(t, PERIOD, PERIOD),
    "stale_credits": lambda t: exceptions.stale_credit_issues(t, AS_OF),
    "dashboard_exceptions": lambda t: exceptions.dashboard_exceptions(t, PERIOD, AS_OF),
    "exception_numbering": lambda t: exceptions.exception_numbering(exceptions.exception_scan(t, None, AS_OF)),
    "exception_filter": _exception_filter,
    "exception_log_build": exceptions.exception_log_build,
    "open_exceptions": exceptions.open_exceptions,
    "exception_counts": lambda t: exceptions.exception_counts(exceptions.exception_scan(t, None, AS_OF)),
    "apply_resolutions": _resolutions,
    # stored tables
    "revenue_after_refresh": _revenue_after_refresh,
    "refreshed_months": _refreshed_months,
    # data quality
    "dq_constraints": quality.dq_constraints,
    "missing_rate_cards": _missing_rate_cards,
    "staging_diff": _staging_diff,
    "coerce_table": _coerce_table,
}


def plain_numbers(df: DataFrame) -> DataFrame:
    """Decimals as doubles, the form in which results are compared with other engines."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def build(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain_numbers(query(finance_catalog(spark, sf_dir)))

    return run
