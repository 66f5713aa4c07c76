"""Known answers of the single rules."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from yardbook.functions import money
from yardbook.functions.periods import as_date, period_bounds
from yardbook.operators import billing, exceptions, forecast, journals, profit, revenue, tax


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def hours(text):
    return F.lit(Decimal(text)).cast("decimal(5,1)")


@pytest.mark.parametrize(
    "worked, rain, rounding, charged",
    [
        ("6.0", True, "none", "6.0"),
        ("7.0", False, "none", "8.0"),
        ("5.5", True, "none", "6.0"),
        ("8.5", False, "none", "8.5"),
        ("8.5", False, "ceil", "9.0"),
    ],
)
def test_billable_hours(spark, worked, rain, rounding, charged):
    rule = revenue.billable_hours_rule(hours(worked), F.lit(rain), rounding)
    assert value(spark, rule) == Decimal(charged)


def test_unknown_rounding_is_refused(spark):
    with pytest.raises(ValueError):
        revenue.billable_hours_rule(hours("1.0"), F.lit(True), "floor")


@pytest.mark.parametrize("term, fee", [("12.0", 100_000), ("18.0", 50_000), ("16.0", 50_000), ("15.5", 100_000)])
def test_float_fee(spark, term, fee):
    assert value(spark, revenue.float_fee_rule(F.lit(50_000), hours(term))) == fee


def test_withholding(spark):
    for gross, due in [(120_000, 56_400), (300_696, 141_327), (317_910, 149_418)]:
        assert value(spark, tax.abn_withholding_rule(F.lit(gross).cast("bigint"))) == due


@pytest.mark.parametrize("amount, tenth", [(5, 1), (4, 0), (15, 2), (-5, -1), (-4, 0), (0, 0), (748_831, 74_883)])
def test_round_half_away(spark, amount, tenth):
    assert value(spark, money.gst(F.lit(amount).cast("bigint"))) == tenth


def test_ratio_is_exact_beyond_64_bits(spark):
    n, d = 10**17 + 1, 2 * 10**17
    assert value(spark, money.percent(F.lit(n).cast("bigint"), F.lit(d).cast("bigint"), 4)) == Decimal("50.0000")
    assert value(spark, money.ratio(F.lit(-5).cast("bigint"), F.lit(2).cast("bigint"))) == -3
    assert value(spark, money.ratio(F.lit(5).cast("bigint"), F.lit(0).cast("bigint"))) is None


@pytest.mark.parametrize(
    "invoiced, wip, status",
    [
        (0, 900_000, "No Invoice"),
        (1, 50_000, "OK"),
        (1, 50_001, "Underbilled"),
        (1, -50_000, "OK"),
        (1, -50_001, "Overbilled"),
    ],
)
def test_billing_status(spark, invoiced, wip, status):
    assert value(spark, billing.billing_status_rule(F.lit(invoiced), F.lit(wip))) == status


@pytest.mark.parametrize("pct, band", [(19.9, "low"), (20, "fair"), (39.9, "fair"), (40, "good"), (None, "low")])
def test_margin_band(spark, pct, band):
    assert value(spark, profit.margin_band_rule(F.lit(pct).cast("double"))) == band


def test_balanced_journal_passes_and_other_raises(spark):
    journals.assert_balanced(spark.createDataFrame([(100_000, 0), (0, 100_000)], "dr long, cr long"))
    unbalanced = spark.createDataFrame([(100_000, 0), (0, 99_999)], "dr long, cr long")
    with pytest.raises(ValueError, match="DR 100000 != CR 99999"):
        journals.assert_balanced(unbalanced)
    with pytest.raises(ValueError):
        journals.assert_balanced(unbalanced.drop("cr"))
    rows = exceptions.journal_issues(unbalanced).collect()
    assert [r.description for r in rows] == ["Debits of 100000 do not equal credits of 99999"]


def test_working_days(spark):
    rule = forecast.working_day_rule(F.lit(date(2026, 1, 1)), F.lit(date(2026, 1, 31)))
    assert value(spark, rule) == 27


def test_periods():
    assert period_bounds("2024-02-17") == (date(2024, 2, 1), date(2024, 2, 29))
    assert as_date("2026-01") == date(2026, 1, 1)


def test_payroll_allocation_known_month(spark):
    # January of the shipped payroll: wages 54,164.94, 31,458.99 and an admin group.
    wages = spark.createDataFrame(
        [(date(2026, 1, 1), "a", 5_416_494), (date(2026, 1, 1), "b", 3_145_899), (date(2026, 1, 1), "c", 0)],
        "month_start date, pay_group string, gross_wages_cents long",
    )
    got = {
        r.pay_group: r.payroll_tax_cents
        for r in tax.allocate_payroll_tax(wages, 8_333_300, Decimal("0.0485")).collect()
    }
    month = round((5_416_494 + 3_145_899 - 8_333_300) * 0.0485)
    assert got["c"] == 0 and abs(got["a"] + got["b"] - month) <= 1


def test_fuel_credit_known_row(mini):
    tables = mini(
        costs=[
            dict(cost_id="c", job_id="j", asset_id="BC001", cost_date=date(2026, 1, 5), cost_category="Fuel",
                 amount_cents=748_831)
        ]
    )
    row = tax.fuel_tax_credit(tables).first()
    assert (row.litres, row.fuel_tax_credit_cents) == (Decimal("3565.86"), 713)
