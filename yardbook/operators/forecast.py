"""Forecast revenue, its variance from actual revenue, and asset utilisation."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardbook.config import DEFAULT_RULES, Rules
from yardbook.functions import money
from yardbook.functions.periods import in_period, month_code, observed_months, period_bounds
from yardbook.sources.catalog import Catalog

# Forecast hours are kept as whole numbers of this fraction (one decimal of hours, four of utilisation).
HOUR_UNITS = 100_000


def working_day_rule(first: Column, last: Column) -> Column:
    """Mondays to Saturdays between two dates."""
    days = F.sequence(first, last, F.expr("interval 1 day"))
    return F.size(F.filter(days, lambda day: F.weekday(day) < 6))


def working_days(tables: Catalog, months: DataFrame | None = None) -> DataFrame:
    """Working days of each month, by default of all months between first and last usage."""
    if months is None:
        months = observed_months(tables["usage_log"], "usage_date")
    first = F.col("month_start")
    return months.select(
        first.alias("period_start"), working_day_rule(first, F.last_day(first)).alias("working_days")
    )


def _hour_units(fleet: Column, hours: Column, days: Column, utilisation: Column) -> Column:
    share = (utilisation * 10_000).cast("bigint")
    return fleet.cast("bigint") * money.tenths(hours) * days.cast("bigint") * share


def _as_hours(units: Column) -> Column:
    return (units.cast("decimal(28,0)") * F.lit(Decimal("0.00001"))).cast("decimal(28,5)")


def forecast_assumptions(
    tables: Catalog, months: DataFrame | None = None, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """One forecast row per asset and month.

    The months of the range are few, so they travel as one array with every asset and are unfolded
    there; no join pairs the two tables.
    """
    calendar = working_days(tables, months).agg(
        F.collect_list(F.struct("period_start", "working_days")).alias("months")
    )
    card = tables["rate_card"].select("equipment_type", F.col("hourly_rate_cents").alias("rate_cents"))
    units = _hour_units(F.lit(1), F.col("hours_per_day"), F.col("working_days"), F.col("utilisation_pct"))
    return (
        tables["fleet_register"]
        .select("asset_id", "equipment_type")
        .join(card, "equipment_type")
        .withColumn("months", calendar.scalar())
        .select("asset_id", "equipment_type", "rate_cents", F.inline("months"))
        .withColumn("hours_per_day", F.lit(rules.forecast_hours_per_day).cast("decimal(5,1)"))
        .withColumn("utilisation_pct", F.lit(rules.forecast_utilisation).cast("decimal(6,4)"))
        .select(
            F.concat(F.lit("FA"), month_code(F.col("period_start")), F.lit("-"), F.col("asset_id")).alias(
                "forecast_assumption_id"
            ),
            "period_start",
            "asset_id",
            "equipment_type",
            F.lit(1).alias("fleet_count"),
            "hours_per_day",
            "working_days",
            "utilisation_pct",
            "rate_cents",
            money.round_div(units * F.col("rate_cents"), HOUR_UNITS).alias("forecast_revenue_cents"),
        )
    )


def build_forecast(assumptions: DataFrame) -> DataFrame:
    """Add forecast revenue and hours to rows with fleet_count, hours_per_day, days, utilisation_pct, rate."""
    units = _hour_units(F.col("fleet_count"), F.col("hours_per_day"), F.col("days"), F.col("utilisation_pct"))
    return assumptions.withColumn(
        "forecast_revenue", money.round_div(units * F.col("rate"), HOUR_UNITS)
    ).withColumn("forecast_hours", _as_hours(units))


def forecast_input(tables: Catalog, period: str | date | None = None) -> DataFrame:
    """Forecast assumptions under the column names that ``build_forecast`` expects."""
    return in_period(tables["forecast_assumptions"], "period_start", period).select(
        "period_start",
        "asset_id",
        "equipment_type",
        "fleet_count",
        "hours_per_day",
        F.col("working_days").alias("days"),
        "utilisation_pct",
        F.col("rate_cents").alias("rate"),
    )


def _actuals(lines: DataFrame) -> DataFrame:
    """Actual revenue, hours and rates per equipment type; the mean rate is kept as sum and count."""
    if "hire_revenue_cents" in lines.columns:
        hire = F.col("hire_revenue_cents")
    elif "float_applied_cents" in lines.columns:
        hire = F.col("total_revenue_cents") - F.col("float_applied_cents")
    else:
        hire = F.col("total_revenue_cents")
    return lines.groupBy("equipment_type").agg(
        F.sum("total_revenue_cents").alias("actual_revenue"),
        F.sum(hire).alias("actual_hire"),
        (money.tenths(F.sum("billable_hours")) * (HOUR_UNITS // 10)).alias("actual_units"),
        F.sum("rate_used_cents").alias("actual_rate_sum"),
        F.count("rate_used_cents").alias("actual_rate_n"),
    )


def _variance(both: DataFrame, rate_den: int = 1) -> DataFrame:
    """Split the variance of joined forecast and actual totals.

    The forecast rate is ``forecast_rate_sum / (forecast_rate_n * rate_den)``. Products of sums are
    taken on decimal(38,0), so the effects are exact before their one rounding.
    """

    def whole(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast(money.WIDE)

    def count(name: str) -> Column:
        return F.greatest(whole(name), F.lit(1).cast(money.WIDE))

    forecast, actual = money.cents(F.col("forecast_revenue")), money.cents(F.col("actual_revenue"))
    f_units, a_units = whole("forecast_units"), whole("actual_units")
    f_sum, f_n = whole("forecast_rate_sum"), count("forecast_rate_n") * rate_den
    a_sum, a_n = whole("actual_rate_sum"), count("actual_rate_n")
    utilisation = money.ratio((a_units - f_units) * f_sum, f_n * HOUR_UNITS)
    rate = money.ratio((a_sum * f_n - f_sum * a_n) * a_units, a_n * f_n * HOUR_UNITS)
    change = actual - forecast
    percent = F.coalesce(money.percent(change, forecast, 2), F.lit(0).cast("decimal(24,2)"))
    return both.select(
        "equipment_type",
        forecast.alias("forecast_revenue"),
        actual.alias("actual_revenue"),
        change.alias("variance_amount"),
        percent.alias("variance_pct"),
        utilisation.alias("utilisation_variance"),
        rate.alias("rate_variance"),
        (money.cents(F.col("actual_hire")) - forecast - utilisation - rate).alias("mix_variance"),
    )


def forecast_variance(forecast: DataFrame, actual: DataFrame) -> DataFrame:
    """Forecast against actual revenue per equipment type, split into utilisation, rate and mix.

    ``forecast`` holds the columns of ``build_forecast`` (its input is enough), ``actual`` revenue
    lines. Float fees count as revenue but not in the split. Types on one side only are kept.
    """
    if "forecast_revenue" not in forecast.columns:
        forecast = build_forecast(forecast)
    planned = forecast.groupBy("equipment_type").agg(
        F.sum("forecast_revenue").alias("forecast_revenue"),
        F.sum((F.col("forecast_hours") * HOUR_UNITS).cast("bigint")).alias("forecast_units"),
        F.sum("rate").alias("forecast_rate_sum"),
        F.count("rate").alias("forecast_rate_n"),
    )
    return _variance(planned.join(_actuals(actual), "equipment_type", "full"))


def forecast_variance_period(tables: Catalog, period: str | date) -> DataFrame:
    """The forecast variance of one month."""
    lines = in_period(tables["revenue_engine"], "usage_date", period)
    return forecast_variance(forecast_input(tables, period), lines)


def forecast_variance_scenario(
    tables: Catalog,
    period: str | date,
    utilisation_pct: float | Decimal = Decimal("0.72"),
    days: int | None = None,
    rate_adjustment_pct: float | Decimal = 0,
) -> DataFrame:
    """The variance of one month against a forecast from the fleet under given assumptions.

    Only types with a fleet appear.
    """
    start, end = period_bounds(period)
    day_count = working_day_rule(F.lit(start), F.lit(end)) if days is None else F.lit(days)
    use_num, use_den = Decimal(str(utilisation_pct)).as_integer_ratio()
    adj_num, adj_den = (1 + Decimal(str(rate_adjustment_pct)) / 100).as_integer_ratio()
    fleet = (
        tables["fleet_register"]
        .groupBy("equipment_type")
        .agg(F.count("asset_id").alias("fleet_count"))
        .join(tables["rate_card"].select("equipment_type", "hourly_rate_cents"), "equipment_type", "left")
    )
    # Nine hours a day; hours and rate carry the scenario's denominators until the rounding.
    hour_num = F.col("fleet_count").cast(money.WIDE) * 9 * day_count * use_num
    rate_num = money.cents(F.col("hourly_rate_cents")).cast(money.WIDE) * adj_num
    planned = fleet.select(
        "equipment_type",
        money.ratio(hour_num * rate_num, F.lit(use_den * adj_den)).alias("forecast_revenue"),
        money.ratio(hour_num * HOUR_UNITS, F.lit(use_den)).alias("forecast_units"),
        rate_num.alias("forecast_rate_sum"),
        F.lit(1).alias("forecast_rate_n"),
    )
    lines = in_period(tables["revenue_engine"], "usage_date", period)
    return _variance(planned.join(_actuals(lines), "equipment_type", "left"), rate_den=adj_den)


def forecast_bridge(variance: DataFrame) -> DataFrame:
    """Five ordered steps from forecast to actual revenue, with the gap and its largest driver."""
    effects = ["utilisation_variance", "rate_variance", "mix_variance"]
    totals = variance.agg(
        *[money.cents(F.sum(c)).alias(c) for c in ("forecast_revenue", *effects, "actual_revenue")]
    )
    gap = F.col("actual_revenue") - F.col("forecast_revenue")
    sizes = [F.abs(F.col(c)) for c in effects]
    largest = F.greatest(*sizes)
    driver = (
        F.when(sizes[0] == largest, "utilisation variance")
        .when(sizes[1] == largest, "rate variance")
        .otherwise("mix variance")
    )
    # Label and source column of each step.
    steps = [
        ("Forecast", "forecast_revenue"),
        ("Utilisation", "utilisation_variance"),
        ("Rate", "rate_variance"),
        ("Mix", "mix_variance"),
        ("Actual", "actual_revenue"),
    ]
    entries = [
        F.struct(F.lit(i).alias("step"), F.lit(label).alias("label"), F.col(c).alias("amount_cents"))
        for i, (label, c) in enumerate(steps, start=1)
    ]
    return totals.select(
        F.inline(F.array(*entries)),
        gap.alias("gap_cents"),
        F.when(gap >= 0, "above").otherwise("below").alias("direction"),
        driver.alias("largest_driver"),
    ).orderBy("step")


def asset_utilisation(tables: Catalog) -> DataFrame:
    """Hours worked against forecast hours per asset.

    An asset with a forecast but no usage has no percentage and sorts first.
    """
    worked = tables["usage_log"].groupBy("asset_id").agg(F.sum("hours_worked").alias("worked"))
    units = _hour_units(F.lit(1), F.col("hours_per_day"), F.col("working_days"), F.col("utilisation_pct"))
    planned = tables["forecast_assumptions"].groupBy("asset_id").agg(F.sum(units).alias("units"))
    none = F.lit(0).cast("decimal(24,2)")
    percent = money.percent(money.tenths(F.col("worked")).cast(money.WIDE) * (HOUR_UNITS // 10), F.col("units"), 2)
    return (
        tables["fleet_register"]
        .select("asset_id", "equipment_type")
        .join(worked, "asset_id", "left")
        .join(planned, "asset_id", "left")
        .select(
            "asset_id",
            "equipment_type",
            F.coalesce("worked", F.lit(0)).cast("decimal(16,1)").alias("actual_hours"),
            F.round(_as_hours(F.coalesce("units", F.lit(0))), 1).cast("decimal(20,1)").alias("forecast_hours"),
            F.when(F.coalesce("units", F.lit(0)) == 0, none).otherwise(percent).alias("utilisation_vs_forecast_pct"),
        )
        .orderBy(F.col("utilisation_vs_forecast_pct").desc_nulls_first(), "asset_id")
    )
