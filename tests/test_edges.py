"""Boundary rows, empty inputs and invariants."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from yardbook.operators import billing, exceptions, forecast, journals, overview, profit, quality, revenue, tax

DAY = date(2026, 1, 10)


def usage(i, job="J1", asset="A1", kind="Dozer", hours="8.0", rain=False, floats=False, day=DAY, site="S"):
    return dict(usage_id=f"U{i}", job_id=job, asset_id=asset, equipment_type=kind, usage_date=day, site_name=site,
                hours_worked=Decimal(hours), rain_flag=rain, float_required=floats)


def card(kind="Dozer", rate=14_000, fee=50_000):
    return dict(rate_card_id=kind, equipment_type=kind, hourly_rate_cents=rate, float_fee_cents=fee, effective_from=DAY)


def job(name="J1", end=date(2026, 1, 20), status="Completed", customer="C"):
    return dict(job_id=name, customer_name=customer, start_date=DAY, end_date=end, status=status)


def asset(name="A1", kind="Dozer"):
    return dict(asset_id=name, equipment_type=kind, purchase_date=DAY, status="Active")


def cost(i, amount, category="Fuel", job="J1", asset="A1", code="GST", usage_id=None, day=DAY):
    return dict(cost_id=f"C{i}", usage_id=usage_id, job_id=job, asset_id=asset, cost_date=day, cost_category=category,
                amount_cents=amount, tax_code=code)


def invoice(i, amount, job="J1", asset="A1"):
    return dict(invoice_id=f"I{i}", job_id=job, asset_id=asset, invoice_date=DAY, amount_ex_gst_cents=amount)


def test_override_comes_first_and_missing_card_drops_the_row(mini):
    tables = mini(
        usage_log=[usage(1), usage(2, job="J2"), usage(3, kind="Unknown")],
        rate_card=[card()],
        job_rates=[dict(job_rate_id="r", job_id="J2", equipment_type="Dozer", override_rate_cents=13_000)],
    )
    got = {r.usage_id: (r.rate_used_cents, r.rate_source) for r in revenue.revenue_engine(tables).collect()}
    assert got == {"U1": (14_000, "Rate card"), "U2": (13_000, "Override")}
    assert [(r.equipment_type, r.usage_rows) for r in quality.missing_rate_cards(tables).collect()] == [("Unknown", 1)]


def test_term_hours_ignore_the_period(mini):
    # 10 hours in January and 6 in February make 16, so the January fee is not doubled.
    tables = mini(
        usage_log=[usage(1, hours="10.0", floats=True), usage(2, hours="6.0", day=date(2026, 2, 3))],
        rate_card=[card()],
    )
    rows = revenue.revenue_engine(tables, "2026-01").collect()
    assert [(r.usage_id, r.float_applied_cents) for r in rows] == [("U1", 50_000)]


def test_invoice_grace_days(mini):
    tables = mini(usage_log=[usage(1, hours="1.0")], rate_card=[card(rate=1_000, fee=0)], job_master=[job()])
    late = date(2026, 1, 25)
    issue = lambda day: [r.issue_type for r in exceptions.billing_issues(tables, None, day).collect()]
    assert issue(date(2026, 1, 24)) == [] and issue(late) == ["No invoice"]
    # Inside the grace days a large amount still counts as under-billed.
    big = mini(usage_log=[usage(1)], rate_card=[card()], job_master=[job()])
    assert [r.issue_type for r in exceptions.billing_issues(big, None, DAY).collect()] == ["Underbilling"]


@pytest.mark.parametrize("billed, found", [(62_000, []), (61_999, ["Underbilling"]), (162_001, ["Overbilling"])])
def test_billing_tolerance_is_strict(mini, billed, found):
    tables = mini(usage_log=[usage(1)], rate_card=[card()], invoice_myob=[invoice(1, billed)])
    rows = billing.billing_variance_exceptions(tables["revenue_engine"], tables["invoice_myob"]).collect()
    assert [r.issue_type for r in rows] == found


def test_costs_without_asset_stay_out_of_asset_profit(mini):
    tables = mini(
        usage_log=[usage(1)], rate_card=[card()], job_master=[job(), job("J2")], fleet_register=[asset(), asset("A2")],
        costs=[cost(1, 100), cost(2, 50, "E-tag"), cost(3, 900, "Subcontract ABN", asset=None, code="ABN")],
    )
    by_asset = {r.asset_id: r for r in profit.asset_profit_table(tables).collect()}
    assert by_asset["A1"].total_cost_cents == 150 and by_asset["A1"].other_costs_cents == 50
    assert by_asset["A2"].margin_pct == 0
    by_job = {r.job_id: r for r in profit.job_profit_table(tables).collect()}
    assert by_job["J1"].total_cost_cents == 1_050 and by_job["J1"].other_costs_cents == 950
    assert by_job["J2"].revenue_cents == 0 and by_job["J2"].margin_pct == 0
    assert [r.cost_id for r in exceptions.costs_without_withholding(tables).collect()] == ["C3"]


def test_utilisation_without_usage_is_null_and_first(mini):
    tables = mini(
        usage_log=[usage(1)], rate_card=[card()], fleet_register=[asset(), asset("A2")], job_master=[job()]
    )
    rows = forecast.asset_utilisation(tables).collect()
    assert [(r.asset_id, r.utilisation_vs_forecast_pct is None) for r in rows] == [("A2", True), ("A1", False)]


def test_empty_tables_give_zero_rows_not_errors(mini):
    tables = mini()
    assert tax.bas_period(tables, "2026-01").first()["Net GST"] == 0
    assert revenue.available_periods(tables).collect()[0].period == "2026-01-01"
    assert tax.payroll_compliance(tables, "2026-01").count() == 0
    assert [r.dr + r.cr for r in journals.journal_pack_period(tables, "2026-01", check=True).collect()] == [0] * 8
    assert journals.journal_pack(tables, "2026-06-30").count() == 0
    assert journals.journal_balance(tables, "2026-06-30").first().balanced
    assert exceptions.exception_scan(tables, "2026-01", "2026-06-30").count() == 0
    assert revenue.mom_trend(tables).count() == 0
    assert revenue.mom_trend(tables, "2026-01", "2026-06").count() == 6
    assert overview.overview_kpis(tables, "2026-01", "2026-06-30").first().margin_pct == 0


def test_ledger_tolerance_includes_its_limit(mini):
    def status(ledger):
        tables = mini(
            usage_log=[usage(1)], rate_card=[card()],
            myob_gl_extract=[dict(gl_extract_id="g", period_start=date(2026, 1, 1), account_name="hire REVENUE",
                                  credit_cents=ledger)],
        )
        return {r.metric: r.status for r in tax.myob_recon(tables, "2026-01").collect()}["Revenue"]

    assert status(112_000 - 100) == "OK" and status(112_000 - 101) == "CHECK"


def test_payroll_variance_limit_and_missing_configuration(mini):
    month = date(2026, 1, 1)
    pay = lambda extra: [dict(payroll_month_id="p", month_start=month, pay_group="Ops", gross_wages_cents=100_000,
                              super_guarantee_cents=12_000 + extra)]
    config = [
        dict(config_key=k, config_value=Decimal(v), effective_from=month)
        for k, v in [("super_guarantee_rate", "0.12"), ("vic_payroll_tax_rate", "0.0485"),
                     ("vic_payroll_tax_monthly_threshold", "83333"), ("coinvest_rate", "0")]
    ]
    found = lambda extra, cfg: [
        r.severity
        for r in exceptions.payroll_issues(mini(payroll_monthly=pay(extra), payroll_config=cfg), month).collect()
    ]
    assert found(5_000, config) == [] and found(5_001, config) == ["MEDIUM"] and found(0, []) == ["LOW"]


def test_stale_credit_needs_an_update_time(mini):
    row = dict(fuel_tax_credit_id="f", asset_id="A1", month_start=DAY, litres=Decimal("1.00"),
               ato_eligible_rate_cents_per_litre=Decimal("0.20"))
    tables = mini(fuel_tax_credit=[row, {**row, "asset_id": "A2", "updated_at": datetime(2025, 1, 1)}])
    assert [r.asset_id for r in tax.ftc_stale(tables, "2026-01-01").collect()] == ["A2"]


def test_staging_diff_sees_every_side(stored):
    lines = revenue.revenue_engine(stored)
    assert quality.staging_diff(lines, lines).count() == 0
    first = lines.agg(F.min("usage_id")).first()[0]
    got = quality.staging_diff(lines.where(F.col("usage_id") != first), lines).collect()
    assert [(r.usage_id, r.found_in) for r in got] == [(first, "computed only")]


def test_resolutions(spark):
    log = spark.createDataFrame([("E1", "Open"), ("E2", "Open")], "exception_id string, status string")
    done = spark.createDataFrame([("E2",), ("E2",), ("E9",)], "exception_id string")
    got = {r.exception_id: r.status for r in exceptions.apply_resolutions(log, done).collect()}
    assert got == {"E1": "Open", "E2": "Resolved"}


def test_invariants(stored):
    total = stored["revenue_engine"].agg(F.sum("total_revenue_cents")).first()[0]
    assert profit.job_profit_table(stored).agg(F.sum("revenue_cents")).first()[0] == total
    assert profit.asset_profit_table(stored).agg(F.sum("revenue_cents")).first()[0] == total
    wip = stored["wip_summary"]
    assert wip.where("wip_cents <> earned_revenue_cents - invoiced_amount_cents").count() == 0
    bas = tax.bas_summary(stored)
    assert bas.where("net_gst_cents <> one_a_cents - one_b_cents").count() == 0
    hire = stored["revenue_engine"].agg(F.sum("hire_revenue_cents")).first()[0]
    whole = forecast.forecast_variance(forecast.forecast_input(stored), stored["revenue_engine"]).agg(
        F.sum(F.expr("forecast_revenue + utilisation_variance + rate_variance + mix_variance"))
    )
    assert whole.first()[0] == hire


def test_variance_without_hire_column_uses_total_less_float(mini):
    tables = mini(
        usage_log=[usage(1, hours="20.0", floats=True)], rate_card=[card()], fleet_register=[asset()], job_master=[job()]
    )
    plan = forecast.forecast_input(tables)
    lines = tables["revenue_engine"]
    full = forecast.forecast_variance(plan, lines).collect()
    assert forecast.forecast_variance(plan, lines.drop("hire_revenue_cents")).collect() == full
    assert full[0].actual_revenue == 330_000


def test_variance_keeps_types_of_one_side(mini):
    tables = mini(
        usage_log=[usage(1)], rate_card=[card(), card("Loader")], fleet_register=[asset("A2", "Loader")],
        job_master=[job()],
    )
    full = forecast.forecast_variance_period(tables, "2026-01")
    assert {r.equipment_type: r.variance_pct for r in full.collect()}["Dozer"] == 0
    scenario = forecast.forecast_variance_scenario(tables, "2026-01")
    assert [r.equipment_type for r in scenario.collect()] == ["Loader"]


def test_period_bundle(stored):
    bundle = overview.period_bundle(stored, "1998-06", "2001-12-31", utilisation_pct=0.8, days=26)
    assert len(bundle) == 12
    assert bundle["journals"].count() == 4 and bundle["bas"].count() == 1
    assert bundle["revenue"].agg(F.sum("total_revenue_cents")).first()[0] == bundle["bas"].first()["G1"]


def test_constraints_of_single_tables_count_what_they_should(mini):
    jobs = [{"job_id": j, "duration_days": d, "status": "Open", "start_date": date(2026, 1, 1), "end_date": date(2026, 1, 2)} for j, d in (("J1", 1), ("J1", 0), ("J2", 3), (None, 1))]
    rates = [{"rate_card_id": f"R{i}", "equipment_type": t, "hourly_rate_cents": h} for i, (t, h) in enumerate((("Dozer", 1), ("Dozer", -1), ("Crane", None)))]
    own = [{"job_rate_id": f"O{i}", "job_id": j, "equipment_type": t, "override_rate_cents": 1} for i, (j, t) in enumerate((("J1", "Dozer"), ("J1", "Dozer"), ("J9", "Crane"), ("J9", None), ("J8", "Pump")))]
    tables = mini(job_master=jobs, rate_card=rates, job_rates=own)
    got = {(r.table_name, r.kind, r.rule): r.violations for r in quality.dq_constraints(tables, ["job_master", "rate_card", "job_rates"]).collect()}
    assert got["job_master", "not null", "job_id"] == 1 and got["job_master", "unique", "job_id"] == 1
    assert got["job_master", "check", "duration_days > 0"] == 1 and got["job_master", "check", "end_date >= start_date"] == 0
    assert got["rate_card", "unique", "equipment_type"] == 1 and got["rate_card", "unique", "rate_card_id"] == 0
    assert got["rate_card", "check", "hourly_rate_cents >= 0"] == 1 and got["rate_card", "not null", "hourly_rate_cents"] == 1
    assert got["job_rates", "unique", "job_id, equipment_type"] == 1
    assert got["job_rates", "reference", "job_id -> job_master"] == 3 and got["job_rates", "reference", "equipment_type -> rate_card"] == 1
    # A parent outside the report is read for its keys only.
    alone = {(r.kind, r.rule): r.violations for r in quality.dq_constraints(tables, ["job_rates"]).collect()}
    assert {("job_rates", *k): v for k, v in alone.items()} == {k: v for k, v in got.items() if k[0] == "job_rates"}


def test_constraints_read_each_stored_table_once(seeded):
    plan = quality.dq_constraints(seeded)._jdf.queryExecution().executedPlan().toString()
    for table in ("usage_log", "costs", "invoice_myob", "revenue_engine", "job_profit"):
        assert plan.count(f"/data/{table}/") == 1, table
