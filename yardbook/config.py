"""Business constants, kept in one place and passed to operators as keyword parameters."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal


@dataclass(frozen=True)
class Rules:
    # Fixed values of the hire contract.
    min_hours: int = 8
    rain_min_hours: int = 6
    short_term_hours: int = 16
    short_term_float_multiple: int = 2

    # Fixed values of the billing review (cents, days).
    wip_review_cents: int = 500_000
    billing_tolerance_cents: int = 50_000
    invoice_grace_days: int = 14
    aged_wip_days: int = 30
    float_share_flag: Decimal = Decimal("0.40")

    # Fixed values of the tax rules.
    withholding_rate: Decimal = Decimal("0.47")
    diesel_cents_per_litre: int = 210
    fuel_credit_rate: Decimal = Decimal("0.20")
    fuel_credit_stale_days: int = 180
    payroll_tolerance_cents: int = 5_000
    ledger_tolerance_cents: int = 100

    # Fixed values of the forecast and of the depreciation journal.
    forecast_hours_per_day: Decimal = Decimal("9.0")
    forecast_utilisation: Decimal = Decimal("0.72")
    depreciation_cents: int = 750_000

    # Fixed values of the margin bands (percent).
    margin_low_pct: int = 20
    margin_fair_pct: int = 40


DEFAULT_RULES = Rules()
