"""Billable hours, rates, float fees and the revenue reports built on them."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yardbook.config import DEFAULT_RULES, Rules
from yardbook.functions import money
from yardbook.functions.keys import may_meet, with_mark
from yardbook.functions.numbering import with_sequence_id
from yardbook.functions.periods import MONTH_KEY, by_month, fixed_months, in_months, in_period, month_start, observed_months
from yardbook.sources.catalog import Catalog

TERM = ["job_id", "asset_id"]

REVENUE_COLUMNS = [
    "usage_id", "job_id", "asset_id", "equipment_type", "usage_date", "actual_hours", "billable_hours",
    "rate_used_cents", "rate_source", "hire_revenue_cents", "float_applied_cents", "total_revenue_cents",
    "gst_output_cents", "tax_code", "bas_g1_cents", "bas_1a_cents",
]


# --- contract rules -------------------------------------------------------------------------------


def term_hours(tables: Catalog) -> DataFrame:
    """Hours worked per hire term (job and asset) over all dates."""
    return tables["usage_log"].groupBy(*TERM).agg(F.sum("hours_worked").alias("total_term_hours"))


def billable_hours_rule(
    hours: Column, rain: Column, hour_rounding: str = "none", rules: Rules = DEFAULT_RULES
) -> Column:
    """Hours charged: the daily minimum, or the lower one on a rain day.

    ``hour_rounding="ceil"`` charges started hours in full.
    """
    minimum = F.when(rain, F.lit(rules.rain_min_hours)).otherwise(F.lit(rules.min_hours))
    charged = F.greatest(hours, minimum.cast("decimal(5,1)"))
    if hour_rounding == "ceil":
        charged = F.ceil(charged)
    elif hour_rounding != "none":
        raise ValueError(f"hour_rounding must be 'none' or 'ceil', not {hour_rounding!r}")
    return charged.cast("decimal(5,1)")


def float_fee_rule(standard_fee: Column, total_term_hours: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """Mobilisation fee, doubled for a term below sixteen hours."""
    multiple = F.when(total_term_hours < rules.short_term_hours, rules.short_term_float_multiple).otherwise(1)
    return standard_fee * multiple


def billable_hours(tables: Catalog, hour_rounding: str = "none", rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Charged hours of every usage row."""
    charged = billable_hours_rule(F.col("hours_worked"), F.col("rain_flag"), hour_rounding, rules)
    return tables["usage_log"].select("usage_id", "hours_worked", "rain_flag", charged.alias("billable_hours"))


def _rated(tables: Catalog, usage: DataFrame) -> DataFrame:
    """Usage rows with their rate and standard float fee; rows without a rate-card line drop out."""
    card = tables["rate_card"].select("equipment_type", "hourly_rate_cents", "float_fee_cents")
    override = tables["job_rates"].select("job_id", "equipment_type", "override_rate_cents")
    return (
        usage.join(card, "equipment_type")
        .join(override, ["job_id", "equipment_type"], "left")
        .select(
            *usage.columns,
            "float_fee_cents",
            F.coalesce("override_rate_cents", "hourly_rate_cents").alias("rate_used_cents"),
            F.when(F.col("override_rate_cents").isNotNull(), "Override").otherwise("Rate card").alias("rate_source"),
        )
    )


def rate_selection(tables: Catalog) -> DataFrame:
    """Rate per usage row: the job's own rate if agreed, else the rate card."""
    return _rated(tables, tables["usage_log"]).select(
        "usage_id", "job_id", "equipment_type", "rate_used_cents", "rate_source"
    )


def _short_terms(tables: Catalog, rules: Rules) -> DataFrame:
    """Hire terms that charge the float fee double, limited to terms that charge it at all."""
    return (
        tables["usage_log"]
        .groupBy(*TERM)
        .agg(F.sum("hours_worked").alias("total_term_hours"), F.bool_or("float_required").alias("_floats"))
        .where(F.col("_floats") & (F.col("total_term_hours") < rules.short_term_hours))
        .select(*TERM, "total_term_hours")
    )


def float_fee(tables: Catalog, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Float fee of every usage row that charges one, with the hours of its term."""
    flagged = tables["usage_log"].where("float_required").select("usage_id", *TERM, "equipment_type")
    card = tables["rate_card"].select("equipment_type", "float_fee_cents")
    fee = float_fee_rule(F.col("float_fee_cents"), F.col("total_term_hours"), rules)
    return (
        flagged.join(card, "equipment_type")
        .join(term_hours(tables), TERM)
        .select("usage_id", *TERM, "total_term_hours", fee.alias("float_applied_cents"))
    )


def priced_usage(
    tables: Catalog,
    period: str | date | None = None,
    hour_rounding: str = "none",
    rules: Rules = DEFAULT_RULES,
    months: Iterable[str | date] | None = None,
) -> DataFrame:
    """Usage rows with all revenue columns added.

    Only rows that charge a float fee need the hours of their term, and only rows whose job may have agreed a rate
    of its own look it up, so only those rows are shuffled; the others pass straight from the scan. The term hours
    always cover all dates, the period (or the months) applies to the rows that are priced.
    """
    usage = in_months(in_period(tables["usage_log"], "usage_date", period), "usage_date", months)
    agreed, listed = _rated_apart(tables, usage.where("float_required"))
    charged = agreed.unionByName(listed).join(_short_terms(tables, rules), TERM, "left")
    agreed, straight = _uncharged(tables, usage, hour_rounding, rules)
    return _with_revenue(_priced(charged, hour_rounding, rules, True).unionByName(agreed).unionByName(straight))


def _rated_apart(tables: Catalog, usage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usage rows with their rate: those that look up a rate of their job, and all others as they come."""
    marked = with_mark(usage, tables["job_rates"], ["job_id", "equipment_type"], "_agreed")
    agreed = _rated(tables, marked.where("_agreed").drop("_agreed"))
    card = tables["rate_card"].select("equipment_type", "float_fee_cents", F.col("hourly_rate_cents").alias("rate_used_cents"))
    listed = marked.where("not _agreed").drop("_agreed").join(card, "equipment_type")
    return agreed, listed.withColumn("rate_source", F.lit("Rate card"))


def _uncharged(tables: Catalog, usage: DataFrame, hour_rounding: str, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """The priced rows that charge no float fee, in the same two parts."""
    agreed, listed = _rated_apart(tables, usage.where("not float_required or float_required is null"))
    return _priced(agreed, hour_rounding, rules, False), _priced(listed, hour_rounding, rules, False)


def _priced(rated: DataFrame, hour_rounding: str, rules: Rules, charged: bool) -> DataFrame:
    """Rated rows with their charged hours and float fee; rows that charge the fee carry the hours of a short term."""
    hours = billable_hours_rule(F.col("hours_worked"), F.col("rain_flag"), hour_rounding, rules)
    fee = float_fee_rule(F.col("float_fee_cents"), F.col("total_term_hours"), rules) if charged else F.lit(0).cast("bigint")
    added = {"hours_worked", "float_fee_cents", "rate_used_cents", "rate_source", "total_term_hours"}
    return rated.select(
        *[c for c in rated.columns if c not in added],
        F.col("hours_worked").alias("actual_hours"),
        hours.alias("billable_hours"),
        "rate_used_cents",
        "rate_source",
        fee.alias("float_applied_cents"),
    )


def _with_revenue(rows: DataFrame) -> DataFrame:
    hire = money.round_div(money.tenths(F.col("billable_hours")) * F.col("rate_used_cents"), 10)
    total, tax = F.col("total_revenue_cents"), F.col("gst_output_cents")
    return (
        rows.select("*", hire.alias("hire_revenue_cents"))
        .select("*", (F.col("hire_revenue_cents") + F.col("float_applied_cents")).alias("total_revenue_cents"))
        .select("*", money.gst(total).alias("gst_output_cents"))
        .select("*", F.lit("GST").alias("tax_code"), total.alias("bas_g1_cents"), tax.alias("bas_1a_cents"))
    )


def revenue_engine(
    tables: Catalog,
    period: str | date | None = None,
    hour_rounding: str = "none",
    rules: Rules = DEFAULT_RULES,
    months: Iterable[str | date] | None = None,
    usage: DataFrame | None = None,
) -> DataFrame:
    """One revenue line per usage row, keyed by ``usage_id``; of some rows of a log stored by month, ``usage``, laid out by month."""
    if usage is not None:
        return lines_by_month(tables, usage, hour_rounding, rules, some=True)
    return priced_usage(tables, period, hour_rounding, rules, months).select(*REVENUE_COLUMNS)


def lines_by_month(
    tables: Catalog, usage: DataFrame, hour_rounding: str = "none", rules: Rules = DEFAULT_RULES, some: bool = False
) -> DataFrame:
    """The revenue lines of ``usage``, rows of the log that is stored by month, laid out by month again.

    Rows that charge no float fee and whose job has agreed no rate of its own stay in the order of the stored
    files, so they are not shuffled. Only the others look up their term and their rate and are then dealt by month.
    ``some`` tells that ``usage`` is a small part of the log: then only the terms it names are summed.
    """
    needed = ["usage_id", *TERM, "equipment_type", "usage_date", "hours_worked", "rain_flag", "float_required"]
    usage = usage.select(*needed)
    flagged = usage.where("float_required")
    log = tables["usage_log"].select(*TERM, "hours_worked", "float_required")
    terms = _short_terms(tables.with_tables(usage_log=may_meet(log, flagged, TERM)) if some else tables, rules)
    charged = _priced(_rated(tables, flagged).join(terms, TERM, "left"), hour_rounding, rules, True)
    agreed, straight = _uncharged(tables, usage, hour_rounding, rules)
    kept = [c for c in straight.columns if c not in ("rain_flag", "float_required")]
    dealt = by_month(charged.unionByName(agreed).select(*kept), "usage_date").drop(MONTH_KEY)
    return _with_revenue(straight.select(*kept).unionByName(dealt)).select(*REVENUE_COLUMNS)


def with_revenue_id(lines: DataFrame, stored: bool = True) -> DataFrame:
    """Revenue lines with their running id, ordered by date, job, asset and usage row."""
    order = [F.col(c) for c in ("usage_date", "job_id", "asset_id", "usage_id")]
    return with_sequence_id(lines.select(*REVENUE_COLUMNS), "revenue_id", "REV", 5, order, stored)


def revenue_id_seq(tables: Catalog, period: str | date | None = None) -> DataFrame:
    """The stored or computed revenue lines with their running id."""
    return with_revenue_id(in_period(tables["revenue_engine"], "usage_date", period), tables.stored("revenue_engine"))


def float_required_by_site(tables: Catalog) -> DataFrame:
    """Whether a usage row needs a float: the asset's previous row is absent or at another site.

    The previous row is looked up inside one asset-day; only the first row of a day asks the asset's
    earlier days, through one summary row per asset-day. So the history of a busy asset is spread
    over its days instead of being sorted in one task.
    """
    day = ["asset_id", "usage_date"]
    place = F.struct("job_id", "usage_id")
    usage = tables["usage_log"].select("usage_id", "job_id", *day, "site_name")
    inside_day = Window.partitionBy(*day).orderBy("job_id", "usage_id")
    over_days = Window.partitionBy("asset_id").orderBy("usage_date")
    day_before = (
        usage.groupBy(*day)
        .agg(F.max_by("site_name", place).alias("_last_site"))
        .select(*day, F.lag("_last_site").over(over_days).alias("_site_before_day"))
    )
    previous = F.when(F.col("_row") == 1, F.col("_site_before_day")).otherwise(F.col("_site_before_row"))
    return (
        usage.withColumn("_row", F.row_number().over(inside_day))
        .withColumn("_site_before_row", F.lag("site_name").over(inside_day))
        .join(day_before, day)
        .withColumn("_previous", previous)
        .select(
            "usage_id",
            "asset_id",
            "usage_date",
            "site_name",
            (F.col("_previous").isNull() | (F.col("_previous") != F.col("site_name"))).alias("float_required"),
        )
    )


# --- reports --------------------------------------------------------------------------------------


def _total(column: str, name: str | None = None) -> Column:
    return F.sum(column).alias(name or column)


def revenue_by_month_type(tables: Catalog) -> DataFrame:
    """Hire, float, total and tax per month and equipment type."""
    return (
        tables["revenue_engine"]
        .groupBy(month_start(F.col("usage_date")).alias("month_start"), "equipment_type")
        .agg(
            _total("hire_revenue_cents"),
            _total("float_applied_cents", "float_revenue_cents"),
            _total("total_revenue_cents"),
            _total("gst_output_cents"),
        )
        .orderBy("month_start", "equipment_type")
    )


def top_jobs_revenue(tables: Catalog, limit: int = 10) -> DataFrame:
    """The jobs with the most revenue."""
    jobs = tables["job_master"].select("job_id", "customer_name", "site_name")
    return (
        tables["revenue_engine"]
        .groupBy("job_id")
        .agg(_total("total_revenue_cents"))
        .join(jobs, "job_id")
        .select("job_id", "customer_name", "site_name", "total_revenue_cents")
        .orderBy(F.desc("total_revenue_cents"), "job_id")
        .limit(limit)
    )


def rain_off_impact(tables: Catalog) -> DataFrame:
    """Rain rows, their revenue and the revenue from the rain minimum, per month."""
    if tables.stored("revenue_engine"):
        lines = tables["revenue_engine"].join(tables["usage_log"].select("usage_id", "rain_flag"), "usage_id")
    else:
        lines = priced_usage(tables)
    zero = F.lit(0).cast("bigint")
    added = F.greatest(money.tenths(F.col("billable_hours")) - money.tenths(F.col("actual_hours")), zero)
    return (
        lines.groupBy(month_start(F.col("usage_date")).alias("month_start"))
        .agg(
            F.count_if("rain_flag").alias("rain_usage_rows"),
            F.sum(F.when(F.col("rain_flag"), F.col("total_revenue_cents")).otherwise(zero)).alias(
                "rain_day_total_revenue_cents"
            ),
            money.round_div(
                F.sum(F.when(F.col("rain_flag"), added * F.col("rate_used_cents")).otherwise(zero)), 10
            ).alias("rain_minimum_impact_cents"),
        )
        .orderBy("month_start")
    )


def float_share(tables: Catalog, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Float fees as a share of each job's revenue, flagged above the limit."""
    num, den = rules.float_share_flag.as_integer_ratio()
    part, total = F.col("float_revenue_cents"), F.col("total_revenue_cents")
    return (
        tables["revenue_engine"]
        .groupBy("job_id")
        .agg(_total("float_applied_cents", "float_revenue_cents"), _total("total_revenue_cents"))
        .join(tables["job_master"].select("job_id", "customer_name"), "job_id")
        .select(
            "job_id",
            "customer_name",
            "float_revenue_cents",
            "total_revenue_cents",
            money.percent(part, total, 2).alias("float_pct"),
            F.when(total != 0, part * den > total * num).alias("float_over_40_pct"),
        )
        .orderBy(F.col("float_pct").desc_nulls_last(), "job_id")
    )


def _by_month(tables: Catalog) -> DataFrame:
    return (
        tables["revenue_engine"]
        .groupBy(month_start(F.col("usage_date")).alias("month_start"))
        .agg(_total("total_revenue_cents", "revenue_cents"))
    )


def mom_trend(tables: Catalog, first: str | date | None = None, last: str | date | None = None) -> DataFrame:
    """Revenue of every month in a dense range, with the change from the month before."""
    by_month = _by_month(tables)
    if first is not None and last is not None:
        months = fixed_months(tables.spark, first, last)
    else:
        months = observed_months(by_month, "month_start")
    in_order = Window.orderBy("month_start")  # one row per calendar month
    return (
        months.join(by_month, "month_start", "left")
        .select("month_start", money.cents(F.col("revenue_cents")).alias("revenue_cents"))
        .withColumn("mom_change_cents", F.col("revenue_cents") - F.lag("revenue_cents").over(in_order))
        .orderBy("month_start")
    )


def revenue_trend(tables: Catalog) -> DataFrame:
    """Revenue of the months that have any."""
    return _by_month(tables).select(
        F.col("month_start").alias("month"), F.col("revenue_cents").alias("total_revenue_cents")
    ).orderBy("month")


def revenue_by_type(tables: Catalog, period: str | date) -> DataFrame:
    """Revenue of one month per equipment type, smallest first."""
    return (
        in_period(tables["revenue_engine"], "usage_date", period)
        .groupBy("equipment_type")
        .agg(_total("total_revenue_cents"))
        .orderBy("total_revenue_cents", "equipment_type")
    )


def top5_jobs(tables: Catalog, period: str | date, limit: int = 5) -> DataFrame:
    """The jobs with the most revenue in one month."""
    return (
        in_period(tables["revenue_engine"], "usage_date", period)
        .groupBy("job_id")
        .agg(_total("total_revenue_cents", "revenue"))
        .orderBy(F.desc("revenue"), "job_id")
        .limit(limit)
        .join(tables["job_master"].select("job_id", "customer_name"), "job_id", "left")
        .orderBy(F.desc("revenue"), "job_id")
    )


def available_periods(tables: Catalog, default: str = "2026-01-01") -> DataFrame:
    """Months with revenue as ``yyyy-MM``; the default alone when there are none."""
    usage = tables["revenue_engine"]
    months = usage.select(month_start(F.col("usage_date")).alias("m")).distinct()
    some = months.agg(F.count("*").alias("n"))
    fallback = tables.spark.range(1).where(some.scalar() == 0).select(F.lit(default).alias("period"))
    return months.select(F.date_format("m", "yyyy-MM").alias("period")).union(fallback).orderBy("period")


def revenue_detail(tables: Catalog, period: str | date | None = None) -> DataFrame:
    """Revenue lines of one month beside the billing state of their hire term."""
    from yardbook.operators.billing import wip_status

    billing = wip_status(tables).select(*TERM, "invoiced_amount_cents", "wip_cents", "status")
    return (
        in_period(tables["revenue_engine"], "usage_date", period)
        .join(billing, TERM, "left")
        .select(
            F.col("usage_date").alias("date"),
            F.col("job_id").alias("job"),
            F.col("asset_id").alias("asset"),
            F.col("actual_hours").alias("hours_worked"),
            "billable_hours",
            F.col("rate_used_cents").alias("rate_used"),
            F.col("hire_revenue_cents").alias("hire_revenue"),
            F.col("float_applied_cents").alias("float_fee"),
            F.col("total_revenue_cents").alias("total_revenue"),
            F.col("invoiced_amount_cents").alias("invoiced"),
            F.col("wip_cents").alias("WIP"),
            "status",
        )
    )


def revenue_detail_filter(
    detail: DataFrame,
    date_from: date | None = None,
    date_to: date | None = None,
    job: str = "All",
    asset: str = "All",
    status: str = "All",
) -> DataFrame:
    """Revenue detail narrowed by any of the given choices."""
    if date_from is not None and date_to is not None:
        detail = detail.where(F.col("date").between(F.lit(date_from), F.lit(date_to)))
    for column, choice in (("job", job), ("asset", asset), ("status", status)):
        if choice != "All":
            detail = detail.where(F.col(column) == choice)
    return detail


def revenue_detail_totals(tables: Catalog, period: str | date | None = None) -> DataFrame:
    """Earned, invoiced and unbilled totals of the revenue detail.

    Billing amounts belong to a hire term. The reported totals repeat them for every usage row of
    the term, as the detail report does; the deduplicated totals count each term once.
    """
    from yardbook.operators.billing import wip_status

    billing = wip_status(tables).select(*TERM, "invoiced_amount_cents", "wip_cents")
    per_term = (
        in_period(tables["revenue_engine"], "usage_date", period)
        .groupBy(*TERM)
        .agg(F.count("*").alias("rows"), _total("total_revenue_cents"))
        .join(billing, TERM, "left")
    )
    rows = F.col("rows")
    invoiced, wip = money.cents(F.col("invoiced_amount_cents")), money.cents(F.col("wip_cents"))
    return per_term.agg(
        money.cents(F.sum("total_revenue_cents")).alias("earned_cents"),
        money.cents(F.sum(rows * invoiced)).alias("invoiced_as_reported_cents"),
        money.cents(F.sum(rows * wip)).alias("wip_as_reported_cents"),
        money.cents(F.sum(invoiced)).alias("invoiced_deduplicated_cents"),
        money.cents(F.sum(wip)).alias("wip_deduplicated_cents"),
    )
