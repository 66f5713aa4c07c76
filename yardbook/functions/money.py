"""Exact cent arithmetic as column expressions.

Row-level rules stay on ``bigint`` so they run inside whole-stage codegen. Ratios of sums use
``decimal(38,0)`` because at cluster scale a month of cents times a percentage factor passes 2**63.
All rounding is half away from zero.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def int_div(num: Column, den: Column) -> Column:
    """Whole-number division that truncates toward zero (bigint result)."""
    return F.call_function("div", num, den)


def cents(total: Column) -> Column:
    """A sum of cents where no row means zero."""
    return F.coalesce(total, F.lit(0).cast("bigint"))


def tenths(hours: Column) -> Column:
    """Hours with one decimal as a whole number of tenths."""
    return (hours * F.lit(10)).cast("bigint")


def round_div(num: Column, den: int) -> Column:
    """Bigint ``num`` over a positive constant, rounded half away from zero."""
    half, whole = F.lit(den // 2), F.lit(den)
    return F.when(num >= 0, int_div(num + half, whole)).otherwise(-int_div(half - num, whole))


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` to a whole bigint, half away from zero; NULL where ``den`` is zero.

    Both arguments must be whole numbers; ``den`` must not be negative.
    """
    n, d = num.cast(WIDE), F.nullif(den.cast(WIDE), F.lit(0).cast(WIDE))
    size = int_div(F.abs(n) * F.lit(2) + d, d * F.lit(2))
    return F.when(n < 0, -size).otherwise(size)


def percent(num: Column, den: Column, places: int) -> Column:
    """``num / den * 100`` rounded to ``places`` decimals; NULL where ``den`` is zero."""
    scaled = ratio(num.cast(WIDE) * F.lit(100 * 10**places), den)
    return (scaled.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-places))).cast(f"decimal(24,{places})")


def margin(profit: Column, revenue: Column, places: int) -> Column:
    """Profit margin in percent, zero where there is no revenue."""
    zero = F.lit(0).cast(f"decimal(24,{places})")
    return F.when(revenue == 0, zero).otherwise(percent(profit, revenue, places))


def apply_rate(amount: Column, rate: Decimal) -> Column:
    """Whole cents times a constant rate, rounded to whole cents."""
    num, den = Decimal(str(rate)).as_integer_ratio()
    return round_div(amount * F.lit(num), den)


def gst(amount: Column) -> Column:
    """Ten percent tax on an amount before tax."""
    return round_div(amount, 10)
