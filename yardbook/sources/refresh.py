"""Bringing stored tables up to date after usage rows of some months changed.

A revenue line hangs on its own usage row, except for the float fee: that doubles if the hours of the whole
hire term, in all months, are below a limit. So a change in one month can alter lines of another one. What
has to be rewritten follows from the change itself: terms whose hours changed, of these the ones that cross the
limit, and the months in which such a term charges a fee.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardbook.config import DEFAULT_RULES, Rules
from yardbook.functions.keys import may_meet, with_mark
from yardbook.functions.periods import by_month, in_months, month_start, period_bounds
from yardbook.operators.revenue import REVENUE_COLUMNS, TERM, revenue_engine, with_revenue_id
from yardbook.sources.catalog import Catalog
from yardbook.sources.store import Change, TableStore
from yardbook.sources.writers import DERIVED_TABLES, build_derived


@dataclass(frozen=True)
class Refreshed:
    """What a refresh did: the version it published, the months whose usage was replaced, the months of
    revenue it wrote."""

    version: int
    usage_months: list[str]
    revenue_months: list[str]


def crossing_terms(before: DataFrame, after: DataFrame, log: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Hire terms that a change of usage rows takes across the hour limit of the float fee.

    ``before`` and ``after`` are the changed rows, ``log`` all rows after the change. Hours are summed to the
    term on either side first; only terms whose sum differs look at the whole log.
    """
    signed = after.select(*TERM, F.col("hours_worked").alias("_hours")).unionByName(
        before.select(*TERM, (-F.col("hours_worked")).alias("_hours"))
    )
    moved = signed.groupBy(*TERM).agg(F.sum("_hours").alias("_moved")).where("_moved <> 0")
    # Rows without a job or asset have no term, as in the fee itself.
    totals = may_meet(log.select(*TERM, "hours_worked"), moved, TERM).join(moved.select(*TERM), TERM, "left_semi")
    totals = totals.groupBy(*TERM).agg(F.sum("hours_worked").alias("_total"))
    limit = F.lit(rules.short_term_hours)
    return moved.join(totals, TERM).where(((F.col("_total") - F.col("_moved")) < limit) != (F.col("_total") < limit)).select(*TERM)


def dependent_months(change: Change, months: Iterable[date], terms: DataFrame) -> list[date]:
    """``months`` and those in which one of ``terms`` charges a float fee."""
    charged = may_meet(change.read("usage_log").where("float_required").select(*TERM, "usage_date"), terms, TERM).join(terms, TERM, "left_semi")
    found = charged.select(month_start(F.col("usage_date")).alias("m")).distinct().collect()  # a row a month
    return sorted({*months, *(r["m"] for r in found)})


def _refreshed_lines(
    tables: Catalog, old: DataFrame, terms: DataFrame, starts: list[date], affected: list[date], rules: Rules, hour_rounding: str
) -> DataFrame:
    """Revenue lines of the affected months: in the replaced months all are priced, in the others those of the terms that cross.

    All other lines are taken as they are stored and are not shuffled.
    """
    others = sorted(set(affected) - set(starts))
    log = tables["usage_log"]
    crossed = may_meet(in_months(log, "usage_date", others), terms, TERM).join(terms, TERM, "left_semi")
    usage = in_months(log, "usage_date", starts).unionByName(crossed.select(*log.columns))
    stored = with_mark(in_months(old, "usage_date", others).select(*REVENUE_COLUMNS), terms, TERM, "_met")
    near = by_month(stored.where("_met").drop("_met").join(terms, TERM, "left_anti"), "usage_date")
    same = stored.where("not _met").drop("_met").unionByName(near.select(*REVENUE_COLUMNS))
    return same.unionByName(revenue_engine(tables, None, hour_rounding, rules, None, usage))


def _renumbered_months(change: Change, old: DataFrame, new: DataFrame, months: list[date]) -> list[date]:
    """Months whose lines or running ids differ: from the first one with other rows or another order on."""
    keys = "usage_date", "job_id", "asset_id", "usage_id"
    sums = [F.count("*").alias("n"), F.sum(F.xxhash64(*keys).cast("decimal(38,0)")).alias("h")]

    def by_month(df: DataFrame) -> DataFrame:
        return in_months(df, "usage_date", months).groupBy(month_start(F.col("usage_date")).alias("m")).agg(*sums)

    pairs = by_month(old).alias("a").join(by_month(new).alias("b"), "m", "full")
    differ = ~(F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.h").eqNullSafe(F.col("b.h")))
    first = pairs.where(differ).agg(F.min("m")).first()[0]
    if first is None:
        return months
    every = {date.fromisoformat(m) for m in change.folders("revenue_engine")}
    return sorted({*months, *(m for m in every if m >= first)})


def refresh_usage(
    store: TableStore, usage: DataFrame, months: Iterable[str | date], rules: Rules = DEFAULT_RULES, hour_rounding: str = "none"
) -> Refreshed:
    """Replace the usage rows of ``months`` and all that hangs on them, as one new version.

    ``usage`` holds the new rows of these months (other rows are not looked at). Of ``revenue_engine``
    the months that depend on the change are written, the others keep their files; where the table carries
    the running id, the months whose ids move are written too. The other derived tables that the store holds are
    built anew. Until the end readers see the version before; if anything fails they keep it.
    """
    starts = sorted({period_bounds(month)[0] for month in months})
    with store.change() as change:
        before = in_months(change.read("usage_log"), "usage_date", starts)
        log = change.replace_months("usage_log", usage, starts)
        after = in_months(log, "usage_date", starts)
        crossing = change.aside("crossing_terms", crossing_terms(before, after, log, rules))
        affected = dependent_months(change, starts, crossing)
        names = [name for name in DERIVED_TABLES if change.has(name)]
        if "revenue_engine" in names:
            old = change.read("revenue_engine")
            tables = Catalog(store.spark, {name: change.read(name) for name in change.tables() if name not in DERIVED_TABLES})
            numbered = "revenue_id" in old.columns
            if numbered:
                lines = revenue_engine(tables, None, hour_rounding, rules, affected)
                rest = {date.fromisoformat(m) for m in change.folders("revenue_engine")} - set(affected)
                affected = _renumbered_months(change, old, lines, affected)
                kept = in_months(old, "usage_date", sorted(rest)).select(*REVENUE_COLUMNS)
                lines = with_revenue_id(kept.unionByName(lines))
            else:
                lines = _refreshed_lines(tables, old, crossing, starts, affected, rules, hour_rounding)
            change.replace_months("revenue_engine", lines, affected, laid=not numbered)
        others = [name for name in names if name != "revenue_engine"]
        tables = Catalog(store.spark, {name: change.read(name) for name in change.tables() if name not in others})
        build_derived(change, tables, others)
    return Refreshed(change.base + 1, [d.isoformat() for d in starts], [d.isoformat() for d in affected])
