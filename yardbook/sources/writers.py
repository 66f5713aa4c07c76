"""Writers: derived tables at rest, and the month-end pack."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardbook.functions.periods import MONTH_KEY, by_month, in_period, period_bounds
from yardbook.operators.exceptions import exception_scan
from yardbook.operators.journals import journal_pack_period
from yardbook.operators.profit import asset_profit, job_profit
from yardbook.operators.revenue import lines_by_month, revenue_id_seq
from yardbook.operators.tax import bas_period
from yardbook.sources.catalog import Catalog
from yardbook.sources.store import Change, TableStore

# Large source tables, their date column for monthly partitions.
FACT_DATES = {"usage_log": "usage_date", "costs": "cost_date", "invoice_myob": "invoice_date"}

# Derived table, its date column for monthly partitions (None: one folder).
DERIVED_TABLES = {
    "revenue_engine": "usage_date",
    "forecast_assumptions": "period_start",
    "myob_gl_extract": None,
    "bas_check": None,
    "job_profit": None,
    "asset_profit": None,
}


def write_table(df: DataFrame, path: str, day: str | None = None) -> None:
    """Write a table for other readers; with a date column it is partitioned by month.

    An existing table is written over in place. Tables that are read meanwhile belong in a ``TableStore``.
    """
    if day is None:
        df.write.mode("overwrite").parquet(path)
    else:
        by_month(df, day).write.mode("overwrite").partitionBy(MONTH_KEY).parquet(path)


def store_sources(tables: Catalog, folder: str, monthly: bool = True) -> Catalog:
    """Store the source tables of a catalog as one version and return a catalog that reads them.

    Each table is written before the next one, so tables that are derived from others read the stored
    form. Facts are stored by month unless ``monthly`` is off.
    """
    with TableStore(tables.spark, folder).change() as change:
        for name in tables.sources():
            stored = change.replace(name, tables[name], FACT_DATES.get(name) if monthly else None)
            tables = tables.with_tables(**{name: stored})
    return tables


def build_derived(
    change: Change, tables: Catalog, names: Iterable[str], numbered: bool = True, monthly: bool = True
) -> Catalog:
    """Write derived tables in order of dependency; each fact is computed once.

    Revenue lines without running ids of usage that is stored by month keep its layout.
    """
    for name in names:
        laid = name == "revenue_engine" and not numbered and monthly and not tables.stored(name) and MONTH_KEY in tables["usage_log"].columns
        if laid:
            built = lines_by_month(tables, tables["usage_log"])
        else:
            built = revenue_id_seq(tables) if name == "revenue_engine" and numbered else tables[name]
        stored = change.replace(name, built, DERIVED_TABLES[name] if monthly else None, laid)
        tables = tables.with_tables(**{name: stored})
    return tables


def materialise(tables: Catalog, folder: str, numbered: bool = True, monthly: bool = True) -> Catalog:
    """Store the derived tables as one version and return a catalog that reads them.

    Readers of the folder see all of them or none. A table the catalog already stores is left alone. With
    ``numbered`` the revenue rows carry their running id.
    """
    with TableStore(tables.spark, folder).change() as change:
        missing = [name for name in DERIVED_TABLES if not tables.stored(name)]
        return build_derived(change, tables, missing, numbered, monthly)


def month_end_datasets(tables: Catalog, period: str | date, as_of: str | date) -> dict[str, DataFrame]:
    """The seven datasets of the month-end pack."""
    return {
        "revenue": revenue_lines(tables, period),
        "wip": tables["wip_summary"].orderBy(F.desc("wip_cents"), "job_id", "asset_id"),
        "job_profit": job_profit(tables, period),
        "asset_profit": asset_profit(tables, period),
        "bas": bas_period(tables, period),
        "journal_pack": journal_pack_period(tables, period),
        "exceptions": exception_scan(tables, period, as_of),
    }


def revenue_lines(tables: Catalog, period: str | date) -> DataFrame:
    """Revenue rows of one month in the order of the report."""
    rows = in_period(tables["revenue_engine"], "usage_date", period).drop(MONTH_KEY)
    return rows.orderBy("usage_date", "job_id", "asset_id", "usage_id")


def write_datasets(datasets: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """One folder per dataset. CSV output has a header line, also for an empty dataset."""
    for name, df in datasets.items():
        writer = df.write.mode("overwrite")
        path = f"{folder.rstrip('/')}/{name}"
        if fmt == "csv":
            writer.option("header", True).csv(path)
        else:
            writer.format(fmt).save(path)


def month_end_export(
    tables: Catalog, period: str | date, folder: str, as_of: str | date, fmt: str = "parquet"
) -> str:
    """Write the month-end pack below ``folder/period=yyyy-MM-dd`` and return that path."""
    target = f"{folder.rstrip('/')}/period={period_bounds(period)[0].isoformat()}"
    write_datasets(month_end_datasets(tables, period, as_of), target, fmt)
    return target
