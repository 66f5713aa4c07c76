"""Declared schemas of the source tables. Readers never infer types."""

from __future__ import annotations

from pyspark.sql import types as T

# Column lists: name and Spark type, "!" marks a required column.
_DDL = {
    "rate_card": """rate_card_id string!, equipment_type string!, hourly_rate_cents bigint!,
        float_fee_cents bigint!, effective_from date!, effective_to date, source_note string!""",
    "fleet_register": """asset_id string!, equipment_type string!, serial_number string!,
        purchase_date date!, status string!, home_depot string!""",
    "job_master": """job_id string!, customer_name string!, site_name string!, site_address string!,
        start_date date!, end_date date!, duration_days int!, status string!, purchase_order string!""",
    "usage_log": """usage_id string!, job_id string!, asset_id string!, equipment_type string!,
        usage_date date!, site_name string!, hours_worked decimal(5;1)!, rain_flag boolean!,
        float_required boolean!, operator_name string!""",
    "job_rates": """job_rate_id string!, job_id string!, equipment_type string!,
        override_rate_cents bigint!, standard_rate_cents bigint!, override_reason string!""",
    "costs": """cost_id string!, usage_id string, job_id string!, asset_id string, cost_date date!,
        cost_category string!, amount_cents bigint!, gst_input_cents bigint!, tax_code string!,
        bas_g11_cents bigint!, bas_1b_cents bigint!, supplier_name string!, withholding_cents bigint!""",
    "invoice_myob": """invoice_id string!, myob_invoice_number string!, job_id string!, asset_id string!,
        invoice_date date!, amount_ex_gst_cents bigint!, gst_cents bigint!, amount_inc_gst_cents bigint!,
        status string!, tax_code string!""",
    "myob_gl_extract": """gl_extract_id string!, period_start date!, account_code string!,
        account_name string!, tax_code string!, debit_cents bigint!, credit_cents bigint!,
        gst_cents bigint!, source_reference string!""",
    "payroll_config": """config_key string!, config_value decimal(15;4)!, effective_from date!, note string!""",
    "payroll_monthly": """payroll_month_id string!, month_start date!, pay_group string!,
        gross_wages_cents bigint!, super_guarantee_cents bigint!, payroll_tax_cents bigint!,
        coinvest_cents bigint!, tax_code string!""",
    "payg_withholding": """payg_withholding_id string!, job_id string!, cost_id string!,
        supplier_name string!, gross_ex_gst_cents bigint!, withholding_rate decimal(6;4)!,
        withholding_cents bigint!, liability_account string!, bas_field string!, note string!""",
    "fuel_tax_credit": """fuel_tax_credit_id string!, asset_id string!, month_start date!,
        fuel_cost_cents bigint!, diesel_price_estimate_cents_per_litre int!, litres decimal(12;2)!,
        ato_eligible_rate_cents_per_litre decimal(8;2)!, fuel_tax_credit_cents bigint!, note string!,
        updated_at timestamp""",
    "exception_log": """exception_id string!, exception_type string!, job_id string, asset_id string,
        amount_cents bigint!, message string!, severity string""",
    "revenue_engine": """revenue_id string!, usage_id string!, job_id string!, asset_id string!,
        equipment_type string!, usage_date date!, actual_hours decimal(5;1)!, billable_hours decimal(5;1)!,
        rate_used_cents bigint!, rate_source string!, hire_revenue_cents bigint!,
        float_applied_cents bigint!, total_revenue_cents bigint!, gst_output_cents bigint!,
        tax_code string!, bas_g1_cents bigint!, bas_1a_cents bigint!""",
    "forecast_assumptions": """forecast_assumption_id string!, period_start date!, asset_id string,
        equipment_type string!, fleet_count int!, hours_per_day decimal(5;1)!, working_days int!,
        utilisation_pct decimal(6;4)!, rate_cents bigint!, forecast_revenue_cents bigint!""",
    "bas_check": """bas_check_id string!, period_start date!, bas_field string!, amount_cents bigint!,
        source_table string!, notes string!""",
}


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "date": T.DateType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


def _type(kind: str) -> T.DataType:
    if kind.startswith("decimal("):
        precision, scale = kind[len("decimal(") : -1].split(";")
        return T.DecimalType(int(precision), int(scale))
    return _TYPES[kind]


def _struct(ddl: str) -> T.StructType:
    fields = []
    for item in ddl.split(","):
        name, kind = item.split()
        required = kind.endswith("!")
        fields.append(T.StructField(name, _type(kind.rstrip("!")), nullable=not required))
    return T.StructType(fields)


SCHEMAS: dict[str, T.StructType] = {name: _struct(ddl) for name, ddl in _DDL.items()}

# The staging copy holds loaded revenue rows for comparison with the computed ones.
SCHEMAS["staging_revenue_engine"] = SCHEMAS["revenue_engine"]

# Columns that a source file may leave out: filled with NULL by the readers.
OPTIONAL_COLUMNS = {"fuel_tax_credit": ("updated_at",), "exception_log": ("severity",)}

# Tables that arrive as files; all other tables are derived from them.
SOURCE_TABLES = (
    "rate_card",
    "fleet_register",
    "job_master",
    "usage_log",
    "job_rates",
    "costs",
    "invoice_myob",
    "payroll_config",
    "payroll_monthly",
    "payg_withholding",
    "fuel_tax_credit",
    "exception_log",
    "staging_revenue_engine",
)
