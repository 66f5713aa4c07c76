"""Month-end journal packs and their balance check."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardbook.config import DEFAULT_RULES, Rules
from yardbook.functions import money
from yardbook.functions.periods import as_date, in_period, observed_months, period_bounds
from yardbook.functions.scalars import side_by_side
from yardbook.sources.catalog import Catalog

# Journal, name, debit account, credit account (code and name), memo, short note.
JOURNALS = {
    "JE001": (
        "WIP Accrual",
        ("1-1300", "Unbilled Revenue"),
        ("4-1000", "Hire Revenue"),
        "Recognise earned but uninvoiced hire revenue by job and asset",
    ),
    "JE002": (
        "Cost Accrual",
        ("6-1000", "Operating Expense"),
        ("2-1400", "Accrued Expenses"),
        "Accrue job operating costs incurred in the period",
    ),
    "JE003": (
        "Depreciation",
        ("6-3000", "Depreciation Expense"),
        ("1-1900", "Accumulated Depreciation"),
        "Synthetic monthly fleet depreciation estimate; replace with fixed-asset register depreciation",
    ),
    "JE004": (
        "PAYG No-ABN",
        ("2-1100", "Trade Payables"),
        ("2-2300", "PAYG Withholding Payable"),
        "Reclassify no-ABN withholding from supplier payable to PAYG W4 liability",
    ),
}


def _nil():
    return F.lit(0).cast("bigint")


def _open_wip(tables: Catalog) -> DataFrame:
    """Positive unbilled revenue over all dates; one row, NULL without hire terms."""
    return tables["wip_summary"].agg(F.sum(F.greatest("wip_cents", _nil())).alias("wip"))


def _two_sides(amounts: DataFrame) -> DataFrame:
    """A debit and a credit line for every row (journal_id, journal_date, amount)."""

    def side(kind: str, code, account):
        debit = kind == "DR"
        return F.struct(
            F.lit(kind).alias("line_type"),
            code.alias("account_code"),
            account.alias("account_name"),
            (F.col("amount") if debit else _nil()).alias("dr"),
            (_nil() if debit else F.col("amount")).alias("cr"),
        )

    def by_journal(pick):
        column = None
        for journal, spec in JOURNALS.items():
            test = F.col("journal_id") == journal
            column = F.when(test, pick(spec)) if column is None else column.when(test, pick(spec))
        return column

    debit = side("DR", by_journal(lambda s: s[1][0]), by_journal(lambda s: s[1][1]))
    credit = side("CR", by_journal(lambda s: s[2][0]), by_journal(lambda s: s[2][1]))
    return amounts.select(
        "journal_id",
        "journal_date",
        by_journal(lambda s: s[0]).alias("journal_name"),
        by_journal(lambda s: s[3]).alias("memo"),
        F.inline(F.array(debit, credit)),
    )


def journal_pack(
    tables: Catalog,
    wip_date: str | date,
    months: DataFrame | None = None,
    rules: Rules = DEFAULT_RULES,
) -> DataFrame:
    """Journal lines of all months; every amount is computed once and unfolded to both sides.

    ``wip_date`` dates the accrual of unbilled revenue, which is left out if nothing is unbilled.
    """
    if months is None:
        months = observed_months(tables["usage_log"], "usage_date")

    def journal(df: DataFrame, journal_id: str, day, amount) -> DataFrame:
        return df.select(F.lit(journal_id).alias("journal_id"), day.alias("journal_date"), amount.alias("amount"))

    month_end = F.last_day("cost_date")
    wip = journal(_open_wip(tables).where("wip > 0"), "JE001", F.lit(as_date(wip_date)), F.col("wip"))
    costs = tables["costs"].groupBy(month_end.alias("day")).agg(F.sum("amount_cents").alias("total"))
    withheld = tables["dated_withholding"].groupBy(month_end.alias("day")).agg(F.sum("withholding_cents").alias("total"))
    fleet = tables["fleet_register"].agg(F.count("*").alias("n"))
    depreciation = months.select(
        F.lit("JE003").alias("journal_id"),
        F.last_day("month_start").alias("journal_date"),
        (fleet.scalar() * rules.depreciation_cents).alias("amount"),
    ).where("amount > 0")
    amounts = (
        wip.unionByName(journal(costs, "JE002", F.col("day"), F.col("total")))
        .unionByName(depreciation)
        .unionByName(journal(withheld, "JE004", F.col("day"), F.col("total")))
    )
    return (
        _two_sides(amounts)
        .select(
            "journal_id",
            "journal_date",
            "journal_name",
            "line_type",
            "account_code",
            "account_name",
            "dr",
            "cr",
            "memo",
        )
        .orderBy("journal_id", "journal_date", "line_type", "account_code")
    )


def balance_of(journal: DataFrame) -> DataFrame:
    """Total debit and credit of a journal as one row; a missing column counts as zero."""
    sides = [
        (money.cents(F.sum(c)) if c in journal.columns else _nil()).alias(c) for c in ("dr", "cr")
    ]
    return journal.agg(F.count("*").alias("lines"), *sides).select("dr", "cr", (F.col("dr") == F.col("cr")).alias("balanced"))


def journal_balance(tables: Catalog, wip_date: str | date) -> DataFrame:
    """Whether the debits of the journal pack equal its credits."""
    return balance_of(journal_pack(tables, wip_date)).select("balanced")


def assert_balanced(journal: DataFrame) -> None:
    """Raise ``ValueError`` for a journal whose sides differ. This runs a Spark job."""
    row = balance_of(journal).first()
    if row["dr"] != row["cr"]:
        raise ValueError(f"Journal pack is not balanced: DR {row['dr']} != CR {row['cr']}")


def _period_amounts(tables: Catalog, period: str | date, rules: Rules) -> DataFrame:
    """The four journal amounts of one month as one row, zero where there is nothing."""
    costs = in_period(tables["costs"], "cost_date", period).agg(money.cents(F.sum("amount_cents")).alias("JE002"))
    withheld = in_period(tables["dated_withholding"], "cost_date", period)
    return side_by_side(
        _open_wip(tables).select(money.cents(F.col("wip")).alias("JE001")),
        costs,
        tables["fleet_register"].agg((F.count("*") * rules.depreciation_cents).alias("JE003")),
        withheld.agg(money.cents(F.sum("withholding_cents")).alias("JE004")),
    )


def _period_rows(tables: Catalog, period: str | date, rules: Rules) -> DataFrame:
    entries = [F.struct(F.lit(j).alias("journal_id"), F.col(j).alias("amount")) for j in JOURNALS]
    return _period_amounts(tables, period, rules).select(
        F.lit(period_bounds(period)[0]).alias("journal_date"), F.inline(F.array(*entries))
    )


def journal_pack_period(
    tables: Catalog, period: str | date, rules: Rules = DEFAULT_RULES, check: bool = False
) -> DataFrame:
    """The eight journal lines of one month; unbilled revenue covers all dates.

    ``check=True`` runs the balance check at once and raises if it fails.
    """
    pack = _two_sides(_period_rows(tables, period, rules)).select(
        "journal_id",
        F.col("journal_date").alias("period"),
        "journal_name",
        "account_name",
        "dr",
        "cr",
    )
    if check:
        assert_balanced(pack)
    return pack


def journal_wide(tables: Catalog, period: str | date, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """One row per journal of a month with both accounts."""

    def pick(position: int, part: int | None = None):
        pairs = []
        for journal, spec in JOURNALS.items():
            value = spec[position] if part is None else spec[position][part]
            pairs += [F.lit(journal), F.lit(value)]
        return F.create_map(*pairs)[F.col("journal_id")]

    return _period_rows(tables, period, rules).select(
        "journal_id",
        pick(0).alias("description"),
        pick(1, 1).alias("dr_account"),
        pick(2, 1).alias("cr_account"),
        F.col("amount").alias("amount_cents"),
        F.lit("OK").alias("status"),
    )
