"""Finance tables as lazy projections of the star-schema test tables (see FIXTURES.md)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yardbook.functions import money
from yardbook.functions.periods import month_code
from yardbook.sources.catalog import Catalog


def finance_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Catalog of the finance tables over one test-data folder, built as they are used."""

    opened: dict[str, DataFrame] = {}

    def raw(name: str) -> DataFrame:
        if name not in opened:
            opened[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return opened[name]

    def rate_card(_: Catalog) -> DataFrame:
        return raw("nation").selectExpr(
            "concat('RC', lpad(cast(n_nationkey as string), greatest(length(cast(n_nationkey as string)), 3), '0')) as rate_card_id",
            "n_name as equipment_type",
            "cast(14000 + 500 * n_nationkey as bigint) as hourly_rate_cents",
            """cast(case when n_nationkey % 6 = 5 then 0 else 50000 + 2500 * n_nationkey end as bigint)
               as float_fee_cents""",
            "date '1995-01-01' as effective_from",
            "cast(null as date) as effective_to",
            "'Yearly rate review' as source_note",
        )

    def fleet_keys() -> DataFrame:
        return (
            raw("supplier")
            .join(raw("nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
            .selectExpr(
                "s_suppkey as asset_key",
                "concat('A', lpad(cast(s_suppkey as string), greatest(length(cast(s_suppkey as string)), 7), '0')) as asset_id",
                "n_name as equipment_type",
            )
        )

    def fleet_register(_: Catalog) -> DataFrame:
        return fleet_keys().selectExpr(
            "asset_id",
            "equipment_type",
            "concat('SN-', cast(asset_key as string)) as serial_number",
            "date '1994-06-30' as purchase_date",
            """case when asset_key % 10 = 8 then 'In Workshop'
                    when asset_key % 10 = 9 then 'On Hire' else 'Active' end as status""",
            "concat('Depot ', cast(asset_key % 4 as string)) as home_depot",
        )

    def jobs() -> DataFrame:
        job_days = "cast(o_orderkey % 19 as int)"
        return raw("orders").selectExpr(
            "o_orderkey as job_key",
            "o_custkey",
            "concat('J', lpad(cast(o_orderkey as string), greatest(length(cast(o_orderkey as string)), 9), '0')) as job_id",
            "concat('Site ', cast(o_orderkey % 8 as string)) as site_name",
            "cast(o_orderdate as date) as start_date",
            f"date_add(cast(o_orderdate as date), 2 + {job_days}) as end_date",
            f"3 + {job_days} as duration_days",
            """case o_orderstatus when 'F' then 'Completed' when 'P' then 'Invoiced' else 'Open' end
               as status""",
        )

    def job_master(_: Catalog) -> DataFrame:
        customer = raw("customer").select("c_custkey", F.col("c_name").alias("customer_name"))
        return (
            jobs()
            .join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .selectExpr(
                "job_id",
                "customer_name",
                "site_name",
                "concat(site_name, ' Road') as site_address",
                "start_date",
                "end_date",
                "duration_days",
                "status",
                "concat('PO-', cast(job_key as string)) as purchase_order",
            )
        )

    def usage_keys() -> DataFrame:
        """Usage rows with the numeric keys the other projections derive their values from."""
        if "usage" in opened:
            return opened["usage"]
        assets = raw("supplier").count()  # from the file footers
        lines = raw("lineitem").withColumn(
            "line_asset", (F.col("l_orderkey") + 7 * (F.col("l_linenumber") % 2)) % F.lit(assets)
        )
        # Supplier and nation join one after the other: Spark sees two small tables, not their product.
        owned = lines.join(
            raw("supplier").select("s_suppkey", "s_nationkey"), F.col("line_asset") == F.col("s_suppkey")
        ).join(raw("nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
        opened["usage"] = owned.selectExpr(
            """concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string),
                         cast(l_partkey as string), cast(l_suppkey as string),
                         cast(cast(l_shipdate as date) as string)) as usage_id""",
            "concat('J', lpad(cast(l_orderkey as string), greatest(length(cast(l_orderkey as string)), 9), '0')) as job_id",
            "concat('A', lpad(cast(s_suppkey as string), greatest(length(cast(s_suppkey as string)), 7), '0')) as asset_id",
            "n_name as equipment_type",
            "cast(l_shipdate as date) as usage_date",
            "concat('Site ', cast(l_orderkey % 8 as string)) as site_name",
            "cast(4.0 + 0.5 * (cast(l_quantity as int) % 17) as decimal(5,1)) as hours_worked",
            "l_returnflag = 'R' as rain_flag",
            "(l_linestatus = 'O' and l_linenumber <= 3) as float_required",
            "concat('Operator ', cast(l_partkey % 8 as string)) as operator_name",
            "l_orderkey as job_key",
            "l_partkey as part_key",
            "l_suppkey as supp_key",
            "l_linenumber as line_no",
            "cast(round(l_extendedprice) as bigint) as px",
        )
        return opened["usage"]

    def usage_log(_: Catalog) -> DataFrame:
        return usage_keys().drop("job_key", "part_key", "supp_key", "line_no", "px")

    def job_rates(tables: Catalog) -> DataFrame:
        card = tables["rate_card"].select("equipment_type", "hourly_rate_cents")
        return (
            usage_keys()
            .where("job_key % 7 = 0")
            .select("job_key", "job_id", "equipment_type")
            .distinct()
            .join(card, "equipment_type")
            .selectExpr(
                "concat('JR-', job_id, '-', equipment_type) as job_rate_id",
                "job_id",
                "equipment_type",
                "(hourly_rate_cents * (85 + job_key % 31)) div 100 as override_rate_cents",
                "hourly_rate_cents as standard_rate_cents",
                "'Negotiated rate' as override_reason",
            )
        )

    def costs(_: Catalog) -> DataFrame:
        # The usage rows are read once for all kinds. The kinds are a table of constants, so a query for one category
        # or tax code leaves the others out before the join, and reads no usage if none is left.
        kinds = spark.sql(
            """
            select * from values
              ('F', 'Fuel', 'GST', 'Fuel depot'),
              ('L', 'Labour', 'N-T', 'Payroll'),
              ('M', 'Maintenance', 'GST', 'Repairs'),
              ('T', 'Transport/float', 'GST', 'Haulage'),
              ('E', 'E-tag', 'GST', 'Tolls') as t(letter, cost_category, tax_code, supplier_name)
            """
        )
        incurred = """case letter when 'M' then line_no % 3 = 0 when 'T' then float_required
                      when 'E' then part_key % 5 = 0 else true end"""
        per_usage = (
            usage_keys()
            .join(kinds, F.expr(incurred))
            .selectExpr(
                "concat(letter, '-', usage_id) as cost_id",
                "usage_id",
                "case when letter = 'E' and job_key % 97 = 0 then 'J-MISSING' else job_id end as job_id",
                "asset_id",
                "usage_date as cost_date",
                "cost_category",
                """cast(case letter when 'F' then px when 'L' then 38000 + (part_key * 37) % 27000
                        when 'M' then 20000 + (part_key * 53) % 70000 when 'T' then 40000 + (supp_key * 101) % 80000
                        else 2000 + (part_key * 11) % 10000 end as bigint) as amount_cents""",
                "tax_code",
                "supplier_name",
            )
        )
        subcontract = (
            jobs()
            .where("job_key % 20 = 0")
            .selectExpr(
                "concat('S-', job_id) as cost_id",
                "cast(null as string) as usage_id",
                "job_id",
                "cast(null as string) as asset_id",
                "end_date as cost_date",
                "'Subcontract ABN' as cost_category",
                "80000 + (job_key * 17) % 270000 as amount_cents",
                "'ABN' as tax_code",
                "concat('Subcontractor ', cast(job_key % 50 as string)) as supplier_name",
            )
        )
        amount = F.col("amount_cents")
        creditable = F.col("tax_code") == "GST"
        nil = F.lit(0).cast("bigint")
        withheld = money.apply_rate(amount, Decimal("0.47"))
        tax = F.when(creditable, money.gst(amount)).otherwise(nil)
        return per_usage.unionByName(subcontract).select(
            "cost_id",
            "usage_id",
            "job_id",
            "asset_id",
            "cost_date",
            "cost_category",
            "amount_cents",
            tax.alias("gst_input_cents"),
            "tax_code",
            F.when(creditable, amount).otherwise(nil).alias("bas_g11_cents"),
            tax.alias("bas_1b_cents"),
            "supplier_name",
            F.when(F.col("tax_code") == "ABN", withheld).otherwise(nil).alias("withholding_cents"),
        )

    def payg_withholding(tables: Catalog) -> DataFrame:
        return (
            tables["costs"]
            .where("tax_code = 'ABN' and cast(substr(job_id, 2) as bigint) % 60 <> 0")
            .join(tables["job_master"].select("job_id"), "job_id")
            .selectExpr(
                "concat('PAYG-', cost_id) as payg_withholding_id",
                "job_id",
                "cost_id",
                "supplier_name",
                "amount_cents as gross_ex_gst_cents",
                "cast(0.47 as decimal(6,4)) as withholding_rate",
                "withholding_cents",
                "'PAYG Withholding Payable' as liability_account",
                "'W4' as bas_field",
                "'No-ABN withholding' as note",
            )
        )

    def invoice_myob(tables: Catalog) -> DataFrame:
        earned = tables["earned_terms"].selectExpr("job_id", "asset_id", "earned_revenue_cents as earned")
        finished = (
            jobs().where("status in ('Completed', 'Invoiced') and job_key % 11 <> 0").select("job_id", "job_key", "end_date")
        )
        return (
            earned.join(finished, "job_id")
            .withColumn(
                "amount_ex_gst_cents",
                F.expr(
                    """greatest(earned + case job_key % 5 when 1 then -60000 when 2 then 60000
                       when 4 then -30000 else 0 end, 0)"""
                ),
            )
            .withColumn("gst_cents", money.gst(F.col("amount_ex_gst_cents")))
            .selectExpr(
                "concat('INV-', job_id, '-', asset_id) as invoice_id",
                "concat('M-', job_id, '-', asset_id) as myob_invoice_number",
                "job_id",
                "asset_id",
                "date_add(end_date, 3) as invoice_date",
                "amount_ex_gst_cents",
                "gst_cents",
                "amount_ex_gst_cents + gst_cents as amount_inc_gst_cents",
                """case when job_key % 20 = 0 then 'Draft' when job_key % 20 <= 5 then 'Paid' else 'Issued' end
                   as status""",
                "'GST' as tax_code",
            )
        )

    def payroll_config(_: Catalog) -> DataFrame:
        # Fixed values of the payroll configuration.
        return spark.sql(
            """
            select config_key, cast(config_value as decimal(15,4)) as config_value,
                   date '1995-01-01' as effective_from, note
            from values
              ('super_guarantee_rate', 0.12, 'Share of wages'),
              ('vic_payroll_tax_rate', 0.0485, 'Share of wages above the threshold'),
              ('vic_payroll_tax_monthly_threshold', 83333, 'Dollars per month'),
              ('coinvest_rate', 0.0, 'Not confirmed') as t(config_key, config_value, note)
            """
        )

    def payroll_monthly(_: Catalog) -> DataFrame:
        from yardbook.operators.tax import allocate_payroll_tax

        wages = (
            raw("orders")
            .selectExpr(
                "trunc(cast(o_orderdate as date), 'MM') as month_start",
                """case o_orderstatus when 'F' then 'Operators' when 'P' then 'Workshop' else 'Admin' end
                   as pay_group""",
                "cast(round(o_totalprice) as bigint) as wage",
            )
            .groupBy("month_start", "pay_group")
            .agg(F.sum("wage").alias("gross_wages_cents"))
        )
        allocated = allocate_payroll_tax(wages, threshold_cents=8_333_300, rate=Decimal("0.0485"))
        return allocated.select(
            F.concat(F.lit("PAY"), month_code(F.col("month_start")), F.lit("-"), F.upper("pay_group")).alias(
                "payroll_month_id"
            ),
            "month_start",
            "pay_group",
            "gross_wages_cents",
            F.expr("(gross_wages_cents * 12 + 50) div 100 + case when month(month_start) % 4 = 0 then 6000 else 0 end")
            .alias("super_guarantee_cents"),
            F.expr("payroll_tax_cents + case when month(month_start) % 6 = 0 then 7000 else 0 end")
            .alias("payroll_tax_cents"),
            F.lit(0).cast("bigint").alias("coinvest_cents"),
            F.lit("N-T").alias("tax_code"),
        )

    def fuel_tax_credit(tables: Catalog) -> DataFrame:
        from yardbook.operators.tax import fuel_tax_credit as estimate

        return estimate(tables).select(
            F.concat(F.lit("FTC-"), F.col("asset_id"), F.lit("-"), month_code(F.col("month_start"))).alias(
                "fuel_tax_credit_id"
            ),
            "*",
            F.col("month_start").cast("timestamp").alias("updated_at"),
        )

    def myob_gl_extract(tables: Catalog) -> DataFrame:
        from yardbook.operators.tax import gl_extract

        # The ledger differs from the model on purpose, so that reconciliations show a variance.
        tax_rows = gl_extract(tables).withColumn(
            "_shift",
            F.expr("case when account_name = 'GST Collected' and month(period_start) % 3 = 0 then 500 else 0 end"),
        )
        tax_rows = tax_rows.select(
            "gl_extract_id",
            "period_start",
            "account_code",
            "account_name",
            "tax_code",
            "debit_cents",
            (F.col("credit_cents") + F.col("_shift")).alias("credit_cents"),
            (F.col("gst_cents") + F.col("_shift")).alias("gst_cents"),
            "source_reference",
        )
        revenue = tables["revenue_engine"].selectExpr(
            "trunc(usage_date, 'MM') as period_start", "total_revenue_cents as credit", "0L as debit"
        )
        expense = tables["costs"].selectExpr(
            "trunc(cost_date, 'MM') as period_start", "0L as credit", "amount_cents as debit"
        )

        def ledger(rows: DataFrame, code: str, account: str, tag: str) -> DataFrame:
            return (
                rows.groupBy("period_start")
                .agg(F.sum("debit").alias("debit_cents"), F.sum("credit").alias("credit_cents"))
                .select(
                    F.concat(F.lit(f"GL-{tag}-"), month_code(F.col("period_start"))).alias("gl_extract_id"),
                    "period_start",
                    F.lit(code).alias("account_code"),
                    F.lit(account).alias("account_name"),
                    F.lit("N-T").alias("tax_code"),
                    "debit_cents",
                    "credit_cents",
                    F.lit(0).cast("bigint").alias("gst_cents"),
                    F.lit("Ledger extract").alias("source_reference"),
                )
            )

        return tax_rows.unionByName(ledger(revenue, "4-1000", "Hire Revenue", "REV")).unionByName(
            ledger(expense, "6-1000", "Operating Expense", "EXP")
        )

    def exception_log(tables: Catalog) -> DataFrame:
        from yardbook.operators.exceptions import exception_log_lines

        # Severities are spread over the rule types so that every branch of the report is used.
        return exception_log_lines(tables).select(
            F.concat_ws("-", F.lit("EXC"), "exception_type", "reference").alias("exception_id"),
            "exception_type",
            "job_id",
            "asset_id",
            "amount_cents",
            "message",
            F.expr(
                """case exception_type when 'ORPHAN_COST' then 'Critical' when 'OVERBILLING' then 'High'
                   when 'NO_ABN_WITHHOLDING' then 'Closed'
                   else case when amount_cents % 2 = 0 then 'Medium' else 'Open' end end"""
            ).alias("severity"),
        )

    return Catalog(
        spark,
        {
            "rate_card": rate_card,
            "fleet_register": fleet_register,
            "job_master": job_master,
            "usage_log": usage_log,
            "job_rates": job_rates,
            "costs": costs,
            "invoice_myob": invoice_myob,
            "payroll_config": payroll_config,
            "payroll_monthly": payroll_monthly,
            "payg_withholding": payg_withholding,
            "fuel_tax_credit": fuel_tax_credit,
            "myob_gl_extract": myob_gl_extract,
            "exception_log": exception_log,
        },
    )
