"""Work in progress and billing: earned revenue against invoices, per hire term."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardbook.config import DEFAULT_RULES, Rules
from yardbook.functions import money
from yardbook.functions.numbering import with_sequence_id
from yardbook.functions.periods import as_date
from yardbook.functions.scratch import kept
from yardbook.sources.catalog import Catalog

TERM = ["job_id", "asset_id"]


def earned_by_term(lines: DataFrame, *extra: Column) -> DataFrame:
    """Earned revenue per hire term, plus further aggregates."""
    return lines.groupBy(*TERM).agg(F.sum("total_revenue_cents").alias("earned_revenue_cents"), *extra)


def earned_terms(tables: Catalog) -> DataFrame:
    """Earned revenue and last day of use of every hire term over all dates.

    Many measures read it, some of them several times; so it is computed once, unless it comes from stored lines.
    """
    terms = earned_by_term(tables["revenue_engine"], F.max("usage_date").alias("last_usage_date"))
    return terms if tables.stored("revenue_engine") else kept(terms, "earned_terms")


def invoiced_by_term(invoices: DataFrame) -> DataFrame:
    """Invoiced amount per hire term; every invoice status counts."""
    return invoices.groupBy(*TERM).agg(F.sum("amount_ex_gst_cents").alias("invoiced_amount_cents"))


def earned_against_invoiced(lines: DataFrame, invoices: DataFrame, *extra: Column) -> DataFrame:
    """Earned, invoiced and unbilled amount per hire term that has revenue."""
    return terms_against_invoiced(earned_by_term(lines, *extra), invoices)


def terms_against_invoiced(earned: DataFrame, invoices: DataFrame) -> DataFrame:
    """Invoiced and unbilled amount added to hire terms with their earned revenue."""
    invoiced = money.cents(F.col("invoiced_amount_cents"))
    return earned.join(invoiced_by_term(invoices), TERM, "left").select(
        *earned.columns,
        invoiced.alias("invoiced_amount_cents"),
        (F.col("earned_revenue_cents") - invoiced).alias("wip_cents"),
    )


def billing_terms(tables: Catalog) -> DataFrame:
    """Earned, invoiced and unbilled amount of every hire term over all dates."""
    return terms_against_invoiced(tables["earned_terms"].drop("last_usage_date"), tables["invoice_myob"])


def wip_summary(tables: Catalog) -> DataFrame:
    """Unbilled revenue per hire term over all dates, with customer and equipment."""
    return (
        tables["billing_terms"]
        .join(tables["job_master"].select("job_id", "customer_name"), "job_id")
        .join(tables["fleet_register"].select("asset_id", "equipment_type"), "asset_id")
        .select(
            "job_id",
            "customer_name",
            "asset_id",
            "equipment_type",
            "earned_revenue_cents",
            "invoiced_amount_cents",
            "wip_cents",
        )
    )


def _wip_lines(tables: Catalog, measure: Column) -> DataFrame:
    return tables["wip_summary"].select(
        "job_id",
        "customer_name",
        "asset_id",
        "equipment_type",
        "earned_revenue_cents",
        "invoiced_amount_cents",
        measure,
    )


def wip_over_threshold(tables: Catalog, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Hire terms whose unbilled revenue calls for a review."""
    lines = _wip_lines(tables, F.col("wip_cents"))
    return lines.where(F.col("wip_cents") > rules.wip_review_cents).orderBy(
        F.desc("wip_cents"), "job_id", "asset_id"
    )


def underbilled(tables: Catalog, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Hire terms invoiced materially below their revenue."""
    lines = _wip_lines(tables, F.col("wip_cents").alias("underbilled_cents"))
    return lines.where(F.col("underbilled_cents") > rules.billing_tolerance_cents).orderBy(
        F.desc("underbilled_cents"), "job_id", "asset_id"
    )


def overbilled(tables: Catalog, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Hire terms invoiced materially above their revenue."""
    lines = _wip_lines(tables, (-F.col("wip_cents")).alias("overbilled_cents"))
    return lines.where(F.col("overbilled_cents") > rules.billing_tolerance_cents).orderBy(
        F.desc("overbilled_cents"), "job_id", "asset_id"
    )


def billing_status_rule(invoiced: Column, wip: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """Billing state of a hire term; a term without invoices is never just under-billed."""
    return (
        F.when(invoiced == 0, "No Invoice")
        .when(wip > rules.billing_tolerance_cents, "Underbilled")
        .when(wip < -rules.billing_tolerance_cents, "Overbilled")
        .otherwise("OK")
    )


def wip_status(tables: Catalog, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Unbilled revenue and billing state per hire term, without dimension columns."""
    state = billing_status_rule(F.col("invoiced_amount_cents"), F.col("wip_cents"), rules)
    return tables["billing_terms"].withColumn("status", state)


def billing_status(tables: Catalog) -> DataFrame:
    """Billing state per hire term."""
    return wip_status(tables).select(*TERM, "invoiced_amount_cents", "wip_cents", "status")


def wip_ageing(tables: Catalog, as_of: str | date, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Unbilled revenue per hire term with its state and the days since the job ended."""
    jobs = tables["job_master"].select("job_id", "customer_name", "site_name", "end_date")
    age = F.coalesce(F.datediff(F.lit(as_date(as_of)), F.col("end_date")), F.lit(0))
    return (
        wip_status(tables, rules)
        .join(jobs, "job_id", "left")
        .join(tables["fleet_register"].select("asset_id", "equipment_type"), "asset_id", "left")
        .select(
            *TERM,
            "earned_revenue_cents",
            "invoiced_amount_cents",
            "wip_cents",
            "customer_name",
            "site_name",
            "end_date",
            "equipment_type",
            "status",
            age.alias("age_days"),
        )
    )


def wip_by_job(tables: Catalog, as_of: str | date, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Unbilled revenue per job, marked as aged after a month.

    All hire terms of a job share the job's end date, so the age joins after the job totals.
    """
    jobs = tables["job_master"].select("job_id", "customer_name", "end_date")
    age = F.coalesce(F.datediff(F.lit(as_date(as_of)), F.col("end_date")), F.lit(0))
    state = (
        F.when((F.col("WIP") > 0) & (F.col("age_days") > rules.aged_wip_days), "Aged")
        .when(F.col("WIP") > 0, "Open")
        .otherwise("OK")
    )
    return (
        tables["billing_terms"]
        .groupBy("job_id")
        .agg(
            F.sum("earned_revenue_cents").alias("earned"),
            F.sum("invoiced_amount_cents").alias("invoiced"),
            F.sum("wip_cents").alias("WIP"),
        )
        .join(jobs, "job_id")
        .withColumn("age_days", age)
        .select("job_id", "customer_name", "earned", "invoiced", "WIP", "age_days", state.alias("status"))
    )


def wip_by_customer(tables: Catalog, as_of: str | date) -> DataFrame:
    """Unbilled revenue per customer, largest first."""
    return (
        wip_by_job(tables, as_of)
        .groupBy("customer_name")
        .agg(F.sum("WIP").alias("WIP"))
        .orderBy(F.desc("WIP"), "customer_name")
    )


def billing_candidates(tables: Catalog, as_of: str | date) -> DataFrame:
    """Jobs with revenue to invoice, largest first."""
    return wip_by_job(tables, as_of).where("WIP > 0").orderBy(F.desc("WIP"), "job_id")


def billing_variance_exceptions(
    lines: DataFrame, invoices: DataFrame, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """Hire terms without an invoice or billed outside the tolerance."""
    invoiced, variance = F.col("invoiced_amount_cents"), F.col("wip_cents")
    issue = (
        F.when(invoiced == 0, "No invoice")
        .when(variance > rules.billing_tolerance_cents, "Underbilling")
        .when(variance < -rules.billing_tolerance_cents, "Overbilling")
    )
    return (
        earned_against_invoiced(lines, invoices)
        .select(
            issue.alias("issue_type"),
            *TERM,
            F.col("earned_revenue_cents").alias("earned_cents"),
            invoiced.alias("invoiced_cents"),
            variance.alias("variance_cents"),
        )
        .where("issue_type is not null")
    )


def billing_run(tables: Catalog) -> DataFrame:
    """Invoices to raise: one per hire term of a finished job, numbered by job and asset."""
    finished = tables["job_master"].where(F.col("status").isin("Completed", "Invoiced")).select("job_id")
    amount = F.col("earned_revenue_cents")
    bills = (
        tables["earned_terms"]
        .join(finished, "job_id")
        .select(
            *TERM,
            amount.alias("amount_ex_gst_cents"),
            money.gst(amount).alias("gst_cents"),
            (amount + money.gst(amount)).alias("amount_inc_gst_cents"),
            F.lit("GST").alias("tax_code"),
        )
    )
    return with_sequence_id(bills, "invoice_id", "INV", 5, [F.col(c) for c in TERM])
