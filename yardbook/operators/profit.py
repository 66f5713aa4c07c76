"""Direct cost allocation, and profit per job, asset and customer."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardbook.config import DEFAULT_RULES, Rules
from yardbook.functions import money
from yardbook.functions.numbering import with_rank_desc
from yardbook.functions.periods import in_period, month_start
from yardbook.functions.scalars import attach
from yardbook.sources.catalog import Catalog

# Cost categories with an own profit column, all others count as "other".
CATEGORY_COLUMNS = {
    "Fuel": "fuel",
    "Labour": "labour",
    "Maintenance": "maintenance",
    "Transport/float": "transport",
}

MEASURES = ["revenue", *CATEGORY_COLUMNS.values(), "other", "total"]


def _cost_pivot(costs: DataFrame, key: str) -> DataFrame:
    """Cost per category, one column each, in a single pass over the rows that carry the key."""
    amount, category = F.col("amount_cents"), F.col("cost_category")
    zero = F.lit(0).cast("bigint")
    named = [F.sum(F.when(category == c, amount).otherwise(zero)).alias(n) for c, n in CATEGORY_COLUMNS.items()]
    other = F.sum(F.when(~category.isin(*CATEGORY_COLUMNS), amount).otherwise(zero)).alias("other")
    return costs.where(F.col(key).isNotNull()).groupBy(key).agg(*named, other, F.sum(amount).alias("total"))


def _profit_lines(tables: Catalog, owner: DataFrame, key: str, period: str | date | None) -> DataFrame:
    """Revenue and costs of every row of ``owner``; both facts are summed before they are joined."""
    revenue = (
        in_period(tables["revenue_engine"], "usage_date", period)
        .groupBy(key)
        .agg(F.sum("total_revenue_cents").alias("revenue"))
    )
    costs = _cost_pivot(in_period(tables["costs"], "cost_date", period), key)
    return (
        owner.join(revenue, key, "left")
        .join(costs, key, "left")
        .select(*owner.columns, *[money.cents(F.col(m)).alias(m) for m in MEASURES])
        .withColumn("profit", F.col("revenue") - F.col("total"))
    )


def job_profit_lines(tables: Catalog, period: str | date | None = None) -> DataFrame:
    jobs = tables["job_master"].select("job_id", "customer_name", "site_name")
    return _profit_lines(tables, jobs, "job_id", period)


def asset_profit_lines(tables: Catalog, period: str | date | None = None) -> DataFrame:
    return _profit_lines(tables, tables["fleet_register"].select("asset_id", "equipment_type"), "asset_id", period)


def _stored_form(lines: DataFrame, key: str) -> DataFrame:
    return lines.select(
        key,
        F.col("revenue").alias("revenue_cents"),
        F.col("fuel").alias("fuel_direct_cents"),
        F.col("labour").alias("labour_direct_cents"),
        F.col("maintenance").alias("maintenance_cents"),
        F.col("transport").alias("transport_cents"),
        F.col("other").alias("other_costs_cents"),
        F.col("total").alias("total_cost_cents"),
        F.col("profit").alias("profit_cents"),
        money.margin(F.col("profit"), F.col("revenue"), 4).alias("margin_pct"),
    )


def job_profit_table(tables: Catalog) -> DataFrame:
    """Profit of every job over all dates, margin to four decimals."""
    return _stored_form(job_profit_lines(tables), "job_id")


def asset_profit_table(tables: Catalog) -> DataFrame:
    """Profit of every asset over all dates, margin to four decimals; costs without asset stay out."""
    return _stored_form(asset_profit_lines(tables), "asset_id")


def margin_band_rule(margin_pct: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """Traffic-light band of a margin; a missing margin counts as zero."""
    pct = F.coalesce(margin_pct, F.lit(0))
    return F.when(pct < rules.margin_low_pct, "low").when(pct < rules.margin_fair_pct, "fair").otherwise("good")


def _report_form(lines: DataFrame, *owner_columns: Column | str) -> DataFrame:
    return lines.select(
        *owner_columns,
        "revenue",
        F.col("fuel").alias("fuel_cost"),
        F.col("labour").alias("labour_cost"),
        F.col("maintenance").alias("maintenance_cost"),
        F.col("transport").alias("transport_cost"),
        F.col("total").alias("total_cost"),
        "profit",
        money.margin(F.col("profit"), F.col("revenue"), 2).alias("margin_pct"),
    )


def job_profit(tables: Catalog, period: str | date | None = None) -> DataFrame:
    """Profit per job, worst margin first, optionally for one month."""
    report = _report_form(job_profit_lines(tables, period), "job_id", F.col("customer_name").alias("customer"))
    return report.withColumn("margin_band", margin_band_rule(F.col("margin_pct"))).orderBy("margin_pct", "job_id")


def asset_profit(tables: Catalog, period: str | date | None = None) -> DataFrame:
    """Profit per asset, worst margin first, optionally for one month."""
    report = _report_form(asset_profit_lines(tables, period), "asset_id", "equipment_type")
    return report.orderBy("margin_pct", "asset_id")


def _stored_job_profit(tables: Catalog) -> DataFrame:
    """The job-profit table with customer and site, without a second look at the jobs if it is derived."""
    jobs = ["job_id", "customer_name", "site_name"]
    if tables.stored("job_profit"):
        return tables["job_profit"].join(tables["job_master"].select(*jobs), "job_id")
    lines = job_profit_lines(tables)
    margin = money.margin(F.col("profit"), F.col("revenue"), 4)
    return lines.select(
        *jobs,
        F.col("revenue").alias("revenue_cents"),
        F.col("total").alias("total_cost_cents"),
        F.col("profit").alias("profit_cents"),
        margin.alias("margin_pct"),
    )


def job_margin_report(tables: Catalog) -> DataFrame:
    """Job profit with customer and site, worst margin first."""
    return (
        _stored_job_profit(tables)
        .select(
            "job_id", "customer_name", "site_name", "revenue_cents", "total_cost_cents", "profit_cents", "margin_pct"
        )
        .orderBy("margin_pct", "profit_cents", "job_id")
    )


def customer_ranking(tables: Catalog) -> DataFrame:
    """Revenue, cost, profit and margin per customer, ranked by revenue."""
    totals = (
        _stored_job_profit(tables)
        .groupBy("customer_name")
        .agg(
            F.sum("revenue_cents").alias("ytd_revenue_cents"),
            F.sum("total_cost_cents").alias("ytd_cost_cents"),
            F.sum("profit_cents").alias("ytd_profit_cents"),
        )
        .withColumn("margin_pct", money.margin(F.col("ytd_profit_cents"), F.col("ytd_revenue_cents"), 2))
    )
    return with_rank_desc(totals, "ytd_revenue_cents", ["customer_name"], "revenue_rank").orderBy(
        "revenue_rank", "customer_name"
    )


def direct_costs(tables: Catalog) -> DataFrame:
    """Costs per job, asset and category. Filter on job and asset for a single hire term."""
    return (
        tables["costs"]
        .where("asset_id is not null")
        .groupBy("job_id", "asset_id", "cost_category")
        .agg(F.sum("amount_cents").alias("amount_cents"), F.sum("gst_input_cents").alias("gst_input_cents"))
    )


def maintenance_per_hour(tables: Catalog, period: str | date | None = None) -> DataFrame:
    """Maintenance cents per hour worked for each asset and month, zero where either is missing."""
    nil = F.lit(0).cast("bigint")
    worked = in_period(tables["usage_log"], "usage_date", period).select(
        "asset_id",
        month_start(F.col("usage_date")).alias("month_start"),
        "hours_worked",
        nil.alias("maintenance_cents"),
    )
    spent = (
        in_period(tables["costs"], "cost_date", period)
        .where("cost_category = 'Maintenance' and asset_id is not null")
        .select(
            "asset_id",
            month_start(F.col("cost_date")).alias("month_start"),
            F.lit(0).cast("decimal(5,1)").alias("hours_worked"),
            F.col("amount_cents").alias("maintenance_cents"),
        )
    )
    per_hour = F.col("maintenance_cents").cast("double") / F.nullif(F.col("actual_hours").cast("double"), F.lit(0.0))
    return (
        worked.unionByName(spent)
        .groupBy("asset_id", "month_start")
        .agg(F.sum("hours_worked").alias("actual_hours"), F.sum("maintenance_cents").alias("maintenance_cents"))
        .withColumn("maintenance_cents_per_hour", F.coalesce(per_hour, F.lit(0.0)))
    )


def transport_per_job(tables: Catalog) -> DataFrame:
    """Transport and float cost of every job, zero if none."""
    amount = F.sum("amount_cents").alias("transport_cents")
    spent = tables["costs"].where("cost_category = 'Transport/float'").groupBy("job_id").agg(amount)
    return (
        tables["job_master"]
        .select("job_id")
        .join(spent, "job_id", "left")
        .select("job_id", money.cents(F.col("transport_cents")).alias("transport_cents"))
    )


def cost_mix(tables: Catalog) -> DataFrame:
    """Cost per category and its share of all revenue."""
    revenue = tables["revenue_engine"].agg(F.sum("total_revenue_cents").alias("revenue_cents"))
    by_category = tables["costs"].groupBy("cost_category").agg(F.sum("amount_cents").alias("cost_cents"))
    return (
        attach(by_category, revenue)
        .select(
            "cost_category",
            "cost_cents",
            money.percent(F.col("cost_cents"), F.col("revenue_cents"), 2).alias("pct_of_revenue"),
        )
        .orderBy(F.desc("cost_cents"), "cost_category")
    )


def operator_hours(tables: Catalog) -> DataFrame:
    """Hours and labour cost per operator. Labour is summed per usage row before the join."""
    labour = (
        tables["costs"]
        .where("cost_category = 'Labour' and usage_id is not null")
        .groupBy("usage_id")
        .agg(F.sum("amount_cents").alias("labour_cents"))
    )
    hours = F.col("total_hours")
    return (
        tables["usage_log"]
        .select("usage_id", "operator_name", "hours_worked")
        .join(labour, "usage_id", "left")
        .groupBy("operator_name")
        .agg(
            F.sum("hours_worked").alias("total_hours"),
            money.cents(F.sum("labour_cents")).alias("labour_cost_cents"),
        )
        .withColumn(
            "labour_cost_per_hour_cents", money.ratio(F.col("labour_cost_cents") * 10, money.tenths(hours))
        )
        .orderBy(F.desc("total_hours"), "operator_name")
    )


def asset_unit_economics(tables: Catalog, period: str | date | None = None) -> DataFrame:
    """Asset profit per hour worked; revenue per hour is cut to whole cents."""
    worked = (
        in_period(tables["usage_log"], "usage_date", period)
        .groupBy("asset_id")
        .agg(F.sum("hours_worked").alias("hours"))
    )
    hours = F.coalesce(F.col("hours"), F.lit(0).cast("decimal(15,1)"))
    in_tenths = F.nullif(money.tenths(F.col("hours")), F.lit(0).cast("bigint"))
    divisor = F.when(F.col("hours") == 0, F.lit(1.0)).otherwise(F.col("hours").cast("double"))
    return (
        _report_form(asset_profit_lines(tables, period), "asset_id", "equipment_type", "other")
        .join(worked, "asset_id", "left")
        .withColumn("hours", hours)
        .select(
            "asset_id",
            "equipment_type",
            "revenue",
            "total_cost",
            F.col("other").alias("other_cost"),
            "profit",
            "margin_pct",
            "hours",
            money.cents(money.int_div(F.col("revenue") * 10, in_tenths)).alias("rev_per_hour"),
            (F.col("profit").cast("double") / divisor).alias("profit_per_hour"),
        )
        .orderBy("profit_per_hour", "asset_id")
    )


def cost_gst_fields_rule(amount: Column, creditable: Column) -> dict[str, Column]:
    """Input tax columns of a cost row: ten percent where the tax can be claimed, else zero."""
    nil = F.lit(0).cast("bigint")
    tax = F.when(creditable, money.gst(amount)).otherwise(nil)
    return {
        "gst_input_cents": tax,
        "bas_g11_cents": F.when(creditable, amount).otherwise(nil),
        "bas_1b_cents": tax,
    }


def cost_gst_fields(tables: Catalog) -> DataFrame:
    """Input tax columns of every cost row, derived from its amount and tax code."""
    fields = cost_gst_fields_rule(F.col("amount_cents"), F.col("tax_code") == "GST")
    return tables["costs"].select(
        "cost_id", "tax_code", "amount_cents", *[column.alias(name) for name, column in fields.items()]
    )
