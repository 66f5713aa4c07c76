"""Activity statement, ledger reconciliation, withholding, payroll and fuel tax credits."""

from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yardbook.config import DEFAULT_RULES, Rules
from yardbook.functions import money
from yardbook.functions.keys import may_meet
from yardbook.functions.numbering import with_sequence_id
from yardbook.functions.periods import MONTH_KEY, as_date, in_period, month_code, month_start, observed_months, period_bounds
from yardbook.functions.scalars import attach, side_by_side
from yardbook.sources.catalog import Catalog

# The fields of the activity statement in report order.
BAS_FIELDS = ["G1", "G2", "G3", "G10", "G11", "1A", "1B", "W4", "Net GST"]


def _nil() -> Column:
    return F.lit(0).cast("bigint")


def _monthly(df: DataFrame, day: str, **sums: str) -> DataFrame:
    """Sums per calendar month."""
    totals = [F.sum(column).alias(name) for name, column in sums.items()]
    return df.groupBy(month_start(F.col(day)).alias("period_start")).agg(*totals)


def _total(df: DataFrame, **sums: str) -> DataFrame:
    """One row of sums, zero where there are no rows."""
    return df.agg(*[money.cents(F.sum(column)).alias(name) for name, column in sums.items()])


def dated_withholding(tables: Catalog) -> DataFrame:
    """Withholding entries with the date of their cost, and its month where the costs are stored by month.

    Few costs have an entry, so only those that may have one are shuffled by their id.
    """
    entries, costs = tables["payg_withholding"], tables["costs"]
    month = [MONTH_KEY] if MONTH_KEY in costs.columns else []
    dated = may_meet(costs.select("cost_id", "cost_date", *month), entries, ["cost_id"])
    return entries.join(dated, "cost_id")


# --- activity statement ---------------------------------------------------------------------------


def bas_check_lines(
    tables: Catalog, months: DataFrame | None = None
) -> DataFrame:
    """Long activity-statement lines per month. Each fact is summed once and then split into fields.

    ``months`` (month_start) lists the months of the zero placeholders; by default all months
    between the first and the last usage row.
    """
    if months is None:
        months = observed_months(tables["usage_log"], "usage_date")
    # Field, amount column, source and note.
    sales = [
        ("G1", "g1", "revenue_engine", "GST sales"),
        ("1A", "one_a", "revenue_engine", "Tax on sales"),
    ]
    purchases = [
        ("G11", "g11", "costs", "GST-creditable non-capital purchases"),
        ("1B", "one_b", "costs", "GST input credits"),
    ]
    withheld = [
        ("W4", "w4", "payg_withholding", "No-ABN PAYG withholding liability, excluded from net GST"),
    ]
    empty = [
        ("G2", None, "model", "Export sales placeholder"),
        ("G3", None, "model", "GST-free sales placeholder"),
        ("G10", None, "model", "Capital purchases placeholder"),
    ]

    def lines(per_month: DataFrame, fields: list[tuple]) -> DataFrame:
        entries = [
            F.struct(
                F.lit(field).alias("bas_field"),
                (F.col(amount) if amount else _nil()).alias("amount_cents"),
                F.lit(source).alias("source_table"),
                F.lit(note).alias("notes"),
            )
            for field, amount, source, note in fields
        ]
        return per_month.select("period_start", F.inline(F.array(*entries)))

    all_lines = (
        lines(_monthly(tables["revenue_engine"], "usage_date", g1="bas_g1_cents", one_a="bas_1a_cents"), sales)
        .unionByName(lines(_monthly(tables["costs"], "cost_date", g11="bas_g11_cents", one_b="bas_1b_cents"), purchases))
        .unionByName(lines(_monthly(tables["dated_withholding"], "cost_date", w4="withholding_cents"), withheld))
        .unionByName(lines(months.withColumnRenamed("month_start", "period_start"), empty))
    )
    return all_lines.select(
        F.concat(F.lit("BAS"), month_code(F.col("period_start")), F.lit("-"), F.col("bas_field")).alias("bas_check_id"),
        "period_start",
        "bas_field",
        money.cents(F.col("amount_cents")).alias("amount_cents"),
        "source_table",
        "notes",
    )


def _field_sum(field: str) -> Column:
    return F.sum(F.when(F.col("bas_field") == field, F.col("amount_cents")).otherwise(_nil()))


def bas_summary(tables: Catalog) -> DataFrame:
    """One row per month with all fields. Withholding is not part of net tax."""
    # Output column of each field.
    columns = {
        "G1": "g1_cents",
        "G2": "g2_cents",
        "G3": "g3_cents",
        "G10": "g10_cents",
        "G11": "g11_cents",
        "1A": "one_a_cents",
        "1B": "one_b_cents",
        "W4": "w4_cents",
    }
    return (
        tables["bas_check"]
        .groupBy("period_start")
        .agg(*[_field_sum(field).alias(name) for field, name in columns.items()])
        .withColumn("net_gst_cents", F.col("one_a_cents") - F.col("one_b_cents"))
        .orderBy("period_start")
    )


def bas_period(tables: Catalog, period: str | date) -> DataFrame:
    """The activity statement of one month as one row, zeros where nothing happened."""
    sales = _total(in_period(tables["revenue_engine"], "usage_date", period), g1="bas_g1_cents", one_a="bas_1a_cents")
    purchases = _total(in_period(tables["costs"], "cost_date", period), g11="bas_g11_cents", one_b="bas_1b_cents")
    withheld = _total(in_period(tables["dated_withholding"], "cost_date", period), w4="withholding_cents")
    return side_by_side(sales, purchases, withheld).select(
        F.lit(period_bounds(period)[0]).alias("period"),
        F.col("g1").alias("G1"),
        _nil().alias("G2"),
        _nil().alias("G3"),
        _nil().alias("G10"),
        F.col("g11").alias("G11"),
        F.col("one_a").alias("1A"),
        F.col("one_b").alias("1B"),
        F.col("w4").alias("W4"),
        (F.col("one_a") - F.col("one_b")).alias("Net GST"),
    )


def bas_field_check(tables: Catalog, period: str | date, ledger: DataFrame | None = None) -> DataFrame:
    """The statement of one month field by field against the ledger.

    ``ledger`` has columns ``bas_field`` and ``ledger_cents``; a field it does not list takes the
    model amount, as all fields do without a ledger.
    """
    entries = [
        F.struct(F.lit(i).alias("field_no"), F.lit(f).alias("bas_field"), F.col(f).alias("model_cents"))
        for i, f in enumerate(BAS_FIELDS, start=1)
    ]
    fields = bas_period(tables, period).select(F.inline(F.array(*entries)))
    model = F.col("model_cents")
    if ledger is None:
        fields = fields.withColumn("myob_cents", model)
    else:
        fields = fields.join(ledger, "bas_field", "left").withColumn("myob_cents", F.coalesce("ledger_cents", model))
    return fields.select(
        "field_no",
        "bas_field",
        "model_cents",
        "myob_cents",
        (model - F.col("myob_cents")).alias("difference_cents"),
        F.when(model == F.col("myob_cents"), "OK").otherwise("CHECK").alias("status"),
    ).orderBy("field_no")


def ledger_tax_fields(tables: Catalog, period: str | date) -> DataFrame:
    """Ledger side of the statement: tax collected and tax paid of one month."""
    # Ledger account, statement field.
    field = F.when(F.col("account_name") == "GST Collected", "1A").when(F.col("account_name") == "GST Paid", "1B")
    return (
        tables["myob_gl_extract"]
        .where((F.col("period_start") == F.lit(period_bounds(period)[0])) & (F.col("tax_code") == "GST"))
        .groupBy(field.alias("bas_field"))
        .agg(F.abs(F.sum("gst_cents")).alias("ledger_cents"))
        .where("bas_field is not null")
    )


# --- ledger ---------------------------------------------------------------------------------------


def gl_extract(tables: Catalog) -> DataFrame:
    """Model-aligned ledger rows for tax collected and tax paid, per month."""

    def rows(per_month: DataFrame, tag: str, code: str, account: str, sale: bool, note: str) -> DataFrame:
        amount = F.col("gst")
        return per_month.select(
            F.concat(F.lit(f"GL-{tag}-"), month_code(F.col("period_start"))).alias("gl_extract_id"),
            "period_start",
            F.lit(code).alias("account_code"),
            F.lit(account).alias("account_name"),
            F.lit("GST").alias("tax_code"),
            (_nil() if sale else amount).alias("debit_cents"),
            (amount if sale else _nil()).alias("credit_cents"),
            (amount if sale else -amount).alias("gst_cents"),
            F.lit(note).alias("source_reference"),
        )

    collected = _monthly(tables["revenue_engine"], "usage_date", gst="gst_output_cents")
    paid = _monthly(tables["costs"], "cost_date", gst="gst_input_cents")
    return rows(
        collected, "GSTOUT", "2-2200", "GST Collected", True, "GST on sales as in the ledger"
    ).unionByName(rows(paid, "GSTIN", "2-2210", "GST Paid", False, "GST on costs as in the ledger"))


def gst_recon(tables: Catalog) -> DataFrame:
    """Model tax against ledger tax per month; a month may be missing on either side."""
    model = (
        tables["bas_check"]
        .groupBy("period_start")
        .agg(_field_sum("1A").alias("model_out"), _field_sum("1B").alias("model_in"))
    )
    account, tax = F.col("account_name"), F.col("gst_cents")
    ledger = (
        tables["myob_gl_extract"]
        .where("tax_code = 'GST'")
        .groupBy("period_start")
        .agg(
            F.sum(F.when(account == "GST Collected", tax).otherwise(_nil())).alias("ledger_out"),
            F.abs(F.sum(F.when(account == "GST Paid", tax).otherwise(_nil()))).alias("ledger_in"),
        )
    )
    pick = {c: money.cents(F.col(c)) for c in ("model_out", "ledger_out", "model_in", "ledger_in")}
    return (
        model.join(ledger, "period_start", "full")
        .select(
            "period_start",
            pick["model_out"].alias("model_gst_output_cents"),
            pick["ledger_out"].alias("myob_gst_output_cents"),
            pick["model_in"].alias("model_gst_input_cents"),
            pick["ledger_in"].alias("myob_gst_input_cents"),
            (pick["model_out"] - pick["ledger_out"]).alias("output_variance_cents"),
            (pick["model_in"] - pick["ledger_in"]).alias("input_variance_cents"),
        )
        .orderBy("period_start")
    )


def myob_recon(tables: Catalog, period: str | date, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Revenue, cost, unbilled revenue and profit of one month against the ledger.

    Unbilled revenue always covers all dates. The ledger amount is credit less debit for every
    metric, so a cost shows with the opposite sign.
    """
    totals = side_by_side(
        _total(in_period(tables["revenue_engine"], "usage_date", period), revenue="total_revenue_cents"),
        _total(in_period(tables["costs"], "cost_date", period), cost="amount_cents"),
        _total(tables["wip_summary"], wip="wip_cents"),
    )
    amounts = [
        ("Revenue", F.col("revenue")),
        ("Cost", F.col("cost")),
        ("WIP", F.col("wip")),
        ("Profit", F.col("revenue") - F.col("cost")),
    ]
    model = totals.select(
        F.inline(
            F.array(*[F.struct(F.lit(m).alias("metric"), amount.alias("model_amount")) for m, amount in amounts])
        )
    )
    account = F.col("account_name")
    metric = F.when(account.ilike("%Revenue%"), "Revenue").when(account.ilike("%Expense%"), "Cost").otherwise(account)
    ledger = (
        tables["myob_gl_extract"]
        .where(F.col("period_start") == F.lit(period_bounds(period)[0]))
        .groupBy(metric.alias("metric"))
        .agg(F.sum(F.col("credit_cents") - F.col("debit_cents")).alias("myob_amount"))
    )
    return (
        model.join(ledger, "metric", "left")
        .withColumn("myob_amount", money.cents(F.col("myob_amount")))
        .withColumn("variance_cents", F.col("model_amount") - F.col("myob_amount"))
        .withColumn(
            "status",
            F.when(F.abs("variance_cents") <= rules.ledger_tolerance_cents, "OK").otherwise("CHECK"),
        )
    )


# --- withholding ----------------------------------------------------------------------------------


def withholding_summary(tables: Catalog) -> DataFrame:
    """Withholding liability per month, with the proof that it stays out of net tax."""
    return (
        tables["dated_withholding"]
        .groupBy(month_start(F.col("cost_date")).alias("month_start"))
        .agg(
            F.sum("gross_ex_gst_cents").alias("gross_subject_to_withholding_cents"),
            F.sum("withholding_cents").alias("w4_liability_cents"),
            F.bool_and(F.col("bas_field") == "W4").alias("posted_to_w4"),
        )
        .withColumn("included_in_net_gst", F.lit(False))
        .orderBy("month_start")
    )


def payg_register(tables: Catalog, period: str | date) -> DataFrame:
    """Withholding entries whose cost falls in one month."""
    return (
        in_period(tables["dated_withholding"], "cost_date", period)
        .select(
            "payg_withholding_id",
            "job_id",
            "cost_id",
            "supplier_name",
            "gross_ex_gst_cents",
            "withholding_rate",
            "withholding_cents",
            "liability_account",
            "bas_field",
            F.lit(False).alias("included_in_net_gst"),
        )
        .orderBy("job_id", "cost_id")
    )


def payg_totals(tables: Catalog, period: str | date) -> DataFrame:
    """Gross, withheld and net payments of one month."""
    entries = in_period(tables["dated_withholding"], "cost_date", period)
    withheld = F.col("withheld_cents")
    return _total(entries, gross_cents="gross_ex_gst_cents", withheld_cents="withholding_cents").select(
        "gross_cents",
        "withheld_cents",
        (F.col("gross_cents") - withheld).alias("net_cents"),
        withheld.alias("myob_w4_cents"),
        _nil().alias("variance_cents"),
        (withheld == 0).alias("nothing_withheld"),
    )


def abn_withholding_rule(gross: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """Amount to withhold from a payment to a supplier without a business number."""
    return money.apply_rate(gross, rules.withholding_rate)


def abn_withholding(tables: Catalog, rules: Rules = DEFAULT_RULES, numbered: bool = False) -> DataFrame:
    """Withholding entries due for all costs coded as paid without a business number."""
    gross = F.col("amount_cents")
    due = (
        tables["costs"]
        .where("tax_code = 'ABN'")
        .select(
            "job_id",
            "cost_id",
            "supplier_name",
            gross.alias("gross_ex_gst_cents"),
            F.lit(rules.withholding_rate).cast("decimal(6,4)").alias("withholding_rate"),
            abn_withholding_rule(gross, rules).alias("withholding_cents"),
            F.lit("PAYG Withholding Payable").alias("liability_account"),
            F.lit("W4").alias("bas_field"),
        )
    )
    return with_sequence_id(due, "payg_withholding_id", "PAYG", 4, [F.col("cost_id")]) if numbered else due


# --- payroll --------------------------------------------------------------------------------------


def payroll_rates(tables: Catalog) -> DataFrame:
    """The payroll configuration as one row."""

    def value(key: str) -> Column:
        return F.max(F.when(F.col("config_key") == key, F.col("config_value")))

    return tables["payroll_config"].agg(
        value("super_guarantee_rate").alias("super_rate"),
        value("vic_payroll_tax_rate").alias("tax_rate"),
        (value("vic_payroll_tax_monthly_threshold") * 100).cast("decimal(18,4)").alias("threshold_cents"),
        value("coinvest_rate").alias("coinvest_rate"),
    )


def _share_of(amount: Column, rate: Column) -> Column:
    """Whole cents times a configured rate with four decimals."""
    return money.ratio(amount.cast(money.WIDE) * (rate * 10_000).cast("bigint"), F.lit(10_000))


def super_compliance(tables: Catalog) -> DataFrame:
    """Superannuation due and paid per month and pay group."""
    expected = _share_of(F.col("gross_wages_cents"), F.col("super_rate"))
    return (
        attach(tables["payroll_monthly"], payroll_rates(tables))
        .select(
            "month_start",
            "pay_group",
            "gross_wages_cents",
            expected.alias("expected_super_cents"),
            F.col("super_guarantee_cents").alias("super_paid_cents"),
            (F.col("super_guarantee_cents") - expected).alias("variance_cents"),
        )
        .orderBy("month_start", "pay_group")
    )


def _taxable(wages: Column, threshold: Column) -> Column:
    """Wages above the threshold (four decimals, because the threshold may be a part of a cent)."""
    over = wages.cast("decimal(22,4)") - threshold
    return F.when(over.isNotNull(), F.greatest(over, F.lit(0).cast("decimal(22,4)")))


def payroll_tax(tables: Catalog) -> DataFrame:
    """Payroll tax due on the wages of each month and the tax recorded."""
    months = (
        tables["payroll_monthly"]
        .groupBy("month_start")
        .agg(F.sum("gross_wages_cents").alias("wages"), F.sum("payroll_tax_cents").alias("recorded"))
    )
    taxable = _taxable(F.col("wages"), F.col("threshold_cents"))
    whole = (taxable * 10_000).cast(money.WIDE)
    due = money.ratio(whole * (F.col("tax_rate") * 10_000).cast("bigint"), F.lit(100_000_000))
    return (
        attach(months, payroll_rates(tables))
        .select(
            "month_start",
            F.col("wages").alias("gross_wages_cents"),
            F.round("threshold_cents").cast("bigint").alias("threshold_cents"),
            F.round(taxable).cast("bigint").alias("taxable_wages_cents"),
            due.alias("expected_payroll_tax_cents"),
            F.col("recorded").alias("payroll_tax_recorded_cents"),
        )
        .orderBy("month_start")
    )


def payroll_compliance_lines(tables: Catalog, payroll: DataFrame) -> DataFrame:
    """Expected and recorded payroll duties; payroll tax is shared out by wages and rounded once."""
    month = Window.partitionBy("month_start")  # a handful of pay groups per month
    wages, total = F.col("gross_wages_cents"), F.col("month_wages")
    super_due = _share_of(wages, F.col("super_rate"))
    coinvest_due = _share_of(wages, F.col("coinvest_rate"))
    whole = (_taxable(total, F.col("threshold_cents")) * 10_000).cast(money.WIDE)
    per_unit = whole * (F.col("tax_rate") * 10_000).cast("bigint")
    tax_due = money.ratio(per_unit * wages, total.cast(money.WIDE) * F.lit(100_000_000))
    return attach(
        payroll.withColumn("month_wages", F.sum("gross_wages_cents").over(month)), payroll_rates(tables)
    ).select(
        F.col("month_start").alias("period"),
        "pay_group",
        "gross_wages_cents",
        super_due.alias("expected_super_cents"),
        F.col("super_guarantee_cents").alias("myob_super_cents"),
        (F.col("super_guarantee_cents") - super_due).alias("super_variance_cents"),
        tax_due.alias("expected_payroll_tax_cents"),
        F.col("payroll_tax_cents").alias("myob_payroll_tax_cents"),
        (F.col("payroll_tax_cents") - tax_due).alias("payroll_tax_variance_cents"),
        coinvest_due.alias("expected_coinvest_cents"),
        F.col("coinvest_cents").alias("myob_coinvest_cents"),
        (F.col("coinvest_cents") - coinvest_due).alias("coinvest_variance_cents"),
    )


def payroll_compliance(tables: Catalog, period: str | date | None = None) -> DataFrame:
    """Payroll duties per pay group for one month, or for all months."""
    payroll = tables["payroll_monthly"]
    if period is not None:
        payroll = payroll.where(F.col("month_start") == F.lit(period_bounds(period)[0]))
    return payroll_compliance_lines(tables, payroll).orderBy("period", "pay_group")


def allocate_payroll_tax(wages: DataFrame, threshold_cents: int, rate: Decimal) -> DataFrame:
    """Monthly payroll tax rounded to cents, then shared out by wages and rounded again."""
    month = Window.partitionBy("month_start")
    total = F.col("_month_wages")
    monthly = money.apply_rate(F.greatest(total - F.lit(threshold_cents), F.lit(0)), rate)
    share = money.ratio(monthly.cast(money.WIDE) * F.col("gross_wages_cents"), total)
    return (
        wages.withColumn("_month_wages", F.sum("gross_wages_cents").over(month))
        .withColumn("payroll_tax_cents", money.cents(share))
        .drop("_month_wages")
    )


def payroll_tax_allocation(
    tables: Catalog, threshold_cents: int = 8_333_300, rate: Decimal = Decimal("0.0485")
) -> DataFrame:
    """Payroll tax of each pay group, rounded per month and per group."""
    wages = tables["payroll_monthly"].select("month_start", "pay_group", "gross_wages_cents")
    return allocate_payroll_tax(wages, threshold_cents, rate)


def payroll_totals(tables: Catalog, period: str | date) -> DataFrame:
    """Payroll duties of one month in total."""
    lines = payroll_compliance(tables, period)
    totals = _total(
        lines,
        super_expected_cents="expected_super_cents",
        super_paid_cents="myob_super_cents",
        payroll_tax_expected_cents="expected_payroll_tax_cents",
        payroll_tax_paid_cents="myob_payroll_tax_cents",
        coinvest_cents="myob_coinvest_cents",
    )
    status = F.when(F.col("coinvest_cents") == 0, "Pending").otherwise("Recorded")
    return totals.withColumn("coinvest_status", status)


# --- fuel tax credit ------------------------------------------------------------------------------


def fuel_tax_credit(tables: Catalog, rules: Rules = DEFAULT_RULES, numbered: bool = False) -> DataFrame:
    """Estimated litres and credit per asset and month of fuel cost."""
    num, den = rules.fuel_credit_rate.as_integer_ratio()
    fuel, price = F.col("fuel_cost_cents"), rules.diesel_cents_per_litre
    estimate = (
        tables["costs"]
        .where("cost_category = 'Fuel' and asset_id is not null")
        .groupBy("asset_id", month_start(F.col("cost_date")).alias("month_start"))
        .agg(F.sum("amount_cents").alias("fuel_cost_cents"))
        .select(
            "asset_id",
            "month_start",
            "fuel_cost_cents",
            F.lit(price).alias("diesel_price_estimate_cents_per_litre"),
            (money.round_div(fuel * 100, price).cast("decimal(20,0)") * F.lit(Decimal("0.01")))
            .cast("decimal(18,2)")
            .alias("litres"),
            F.lit(rules.fuel_credit_rate).cast("decimal(8,2)").alias("ato_eligible_rate_cents_per_litre"),
            money.round_div(fuel * num, price * den).alias("fuel_tax_credit_cents"),
            F.lit("Estimate; renew the rate twice a year").alias("note"),
        )
    )
    order = [F.col("asset_id"), F.col("month_start")]
    return with_sequence_id(estimate, "fuel_tax_credit_id", "FTC", 4, order) if numbered else estimate


def _credits(tables: Catalog, month: str) -> DataFrame:
    fleet = tables["fleet_register"].select("asset_id", "equipment_type")
    return (
        tables["fuel_tax_credit"]
        .join(fleet, "asset_id")
        .select(
            F.col("month_start").alias(month),
            "asset_id",
            "equipment_type",
            "fuel_cost_cents",
            "litres",
            "ato_eligible_rate_cents_per_litre",
            "fuel_tax_credit_cents",
            "note",
        )
    )


def ftc_summary(tables: Catalog) -> DataFrame:
    """Fuel tax credits by month and asset."""
    return _credits(tables, "month_start").orderBy("month_start", "asset_id")


def ftc_period(tables: Catalog, period: str | date) -> DataFrame:
    """Fuel tax credits of one month by asset."""
    start = F.lit(period_bounds(period)[0])
    return _credits(tables, "period").where(F.col("period") == start).orderBy("asset_id")


def ftc_stale(tables: Catalog, as_of: str | date, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Fuel tax credit rows whose rate is too old; a missing update time counts as fresh."""
    limit = as_date(as_of) - timedelta(days=rules.fuel_credit_stale_days)
    return (
        tables["fuel_tax_credit"]
        .where(F.col("updated_at") < F.lit(limit).cast("timestamp"))
        .select("asset_id", "month_start", F.col("updated_at").cast("date").alias("updated_on"))
    )
