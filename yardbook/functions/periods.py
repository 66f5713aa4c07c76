"""Calendar helpers: month keys, inclusive month filters and dense month ranges."""

from __future__ import annotations

import calendar
from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Partition column of stored tables: the first day of the month of the table's date.
MONTH_KEY = "month_key"


def as_date(value: str | date) -> date:
    """A date from a date, a timestamp or an ISO text (``2026-01`` counts as its first day)."""
    if isinstance(value, date):
        return date(value.year, value.month, value.day)
    text = value[:10]
    return date.fromisoformat(text if len(text) > 7 else f"{text}-01")


def period_bounds(period: str | date) -> tuple[date, date]:
    """First and last day of the month that contains ``period``."""
    start = as_date(period).replace(day=1)
    return start, start.replace(day=calendar.monthrange(start.year, start.month)[1])


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def month_code(day: Column) -> Column:
    return F.date_format(day, "yyyyMM")


def by_month(df: DataFrame, day: str) -> DataFrame:
    """Rows with their month, laid out so that one writer holds few months.

    The rebalance hint lets Spark split a month that is much larger than the others.
    """
    return df.withColumn(MONTH_KEY, month_start(F.col(day))).hint("rebalance", MONTH_KEY)


def in_period(df: DataFrame, column: str, period: str | date | None) -> DataFrame:
    """Rows of one calendar month; all rows without a period or without the column.

    The bounds are literals, so the predicate reaches the Parquet scan; a table stored by month is
    also pruned to the folder of that month.
    """
    if period is None or column not in df.columns:
        return df
    start, end = period_bounds(period)
    if MONTH_KEY in df.columns:
        df = df.where(F.col(MONTH_KEY) == F.lit(start))
    return df.where(F.col(column).between(F.lit(start), F.lit(end)))


def in_months(df: DataFrame, column: str, months: Iterable[str | date] | None) -> DataFrame:
    """Rows of any of some calendar months; all rows if ``months`` is None."""
    if months is None:
        return df
    starts = sorted({period_bounds(month)[0] for month in months})
    if not starts:
        return df.where(F.lit(False))
    if MONTH_KEY in df.columns:
        df = df.where(F.col(MONTH_KEY).isin(starts))
    # The range reaches the Parquet scan; the months in it are told apart row by row.
    inside = F.col(column).between(F.lit(starts[0]), F.lit(period_bounds(starts[-1])[1]))
    return df.where(inside & month_start(F.col(column)).isin(starts))


def month_range(bounds: DataFrame) -> DataFrame:
    """One row ``month_start`` per month of a one-row frame (first_month, last_month)."""
    every_month = F.sequence("first_month", "last_month", F.expr("interval 1 month"))
    return bounds.where("first_month is not null").select(F.explode(every_month).alias("month_start"))


def observed_months(df: DataFrame, column: str) -> DataFrame:
    """Dense months between the first and the last date of ``column``."""
    return month_range(
        df.agg(
            month_start(F.min(column)).alias("first_month"),
            month_start(F.max(column)).alias("last_month"),
        )
    )


def fixed_months(spark, first: str | date, last: str | date) -> DataFrame:
    """Dense months between two given dates."""
    return month_range(
        spark.range(1).select(
            F.lit(period_bounds(first)[0]).alias("first_month"),
            F.lit(period_bounds(last)[0]).alias("last_month"),
        )
    )
