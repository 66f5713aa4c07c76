"""Data-quality rules of the tables, and the comparison of loaded with computed revenue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardbook.functions.keys import print_of, repeated_prints, with_mark
from yardbook.functions.scratch import kept
from yardbook.operators.revenue import REVENUE_COLUMNS
from yardbook.sources.catalog import Catalog
from yardbook.sources.schemas import SCHEMAS

# Unique keys of each table (the first one is the primary key).
UNIQUE_KEYS = {
    "rate_card": [["rate_card_id"], ["equipment_type"]],
    "fleet_register": [["asset_id"]],
    "job_master": [["job_id"]],
    "usage_log": [["usage_id"]],
    "job_rates": [["job_rate_id"], ["job_id", "equipment_type"]],
    "costs": [["cost_id"]],
    "invoice_myob": [["invoice_id"], ["myob_invoice_number"]],
    "payroll_config": [["config_key"]],
    "payroll_monthly": [["payroll_month_id"], ["month_start", "pay_group"]],
    "payg_withholding": [["payg_withholding_id"]],
    "fuel_tax_credit": [["fuel_tax_credit_id"], ["asset_id", "month_start"]],
    "exception_log": [["exception_id"]],
    "revenue_engine": [["revenue_id"], ["usage_id"]],
    "forecast_assumptions": [["forecast_assumption_id"]],
    "myob_gl_extract": [["gl_extract_id"]],
    "job_profit": [["job_id"]],
    "asset_profit": [["asset_id"]],
    "bas_check": [["bas_check_id"]],
}

# Row conditions of each table beyond required columns.
CHECKS = {
    "rate_card": ["hourly_rate_cents >= 0", "float_fee_cents >= 0"],
    "fleet_register": ["status in ('Active', 'In Workshop', 'On Hire')"],
    "job_master": [
        "duration_days > 0",
        "status in ('Open', 'Completed', 'Invoiced')",
        "end_date >= start_date",
    ],
    "usage_log": ["hours_worked >= 0"],
    "job_rates": ["override_rate_cents >= 0", "standard_rate_cents >= 0"],
    "costs": ["amount_cents >= 0", "gst_input_cents >= 0", "withholding_cents >= 0"],
    "invoice_myob": [
        "amount_ex_gst_cents >= 0",
        "gst_cents >= 0",
        "amount_inc_gst_cents >= 0",
        "status in ('Issued', 'Paid', 'Draft')",
    ],
    "payroll_monthly": [
        "gross_wages_cents >= 0",
        "super_guarantee_cents >= 0",
        "payroll_tax_cents >= 0",
        "coinvest_cents >= 0",
    ],
    "payg_withholding": ["gross_ex_gst_cents >= 0", "withholding_cents >= 0", "bas_field = 'W4'"],
    "fuel_tax_credit": [
        "fuel_cost_cents >= 0",
        "diesel_price_estimate_cents_per_litre > 0",
        "litres >= 0",
        "ato_eligible_rate_cents_per_litre >= 0",
        "fuel_tax_credit_cents >= 0",
    ],
    "revenue_engine": [
        "rate_used_cents >= 0",
        "hire_revenue_cents >= 0",
        "float_applied_cents >= 0",
        "total_revenue_cents >= 0",
        "gst_output_cents >= 0",
    ],
    "forecast_assumptions": [
        "fleet_count >= 0",
        "hours_per_day >= 0",
        "working_days >= 0",
        "utilisation_pct >= 0",
        "rate_cents >= 0",
        "forecast_revenue_cents >= 0",
    ],
}

# Column, parent table; the parent column has the same name.
REFERENCES = {
    "fleet_register": [("equipment_type", "rate_card")],
    "usage_log": [
        ("job_id", "job_master"),
        ("asset_id", "fleet_register"),
        ("equipment_type", "rate_card"),
    ],
    "job_rates": [("job_id", "job_master"), ("equipment_type", "rate_card")],
    "costs": [("usage_id", "usage_log"), ("job_id", "job_master"), ("asset_id", "fleet_register")],
    "invoice_myob": [("job_id", "job_master"), ("asset_id", "fleet_register")],
    "payg_withholding": [("job_id", "job_master"), ("cost_id", "costs")],
    "fuel_tax_credit": [("asset_id", "fleet_register")],
    "exception_log": [("job_id", "job_master"), ("asset_id", "fleet_register")],
    "revenue_engine": [
        ("usage_id", "usage_log"),
        ("job_id", "job_master"),
        ("asset_id", "fleet_register"),
        ("equipment_type", "rate_card"),
    ],
    "forecast_assumptions": [("asset_id", "fleet_register"), ("equipment_type", "rate_card")],
    "job_profit": [("job_id", "job_master")],
    "asset_profit": [("asset_id", "fleet_register")],
}


# Columns of the stored profit tables, all required.
_PROFIT = ["revenue_cents", "fuel_direct_cents", "labour_direct_cents", "maintenance_cents", "transport_cents",
           "other_costs_cents", "total_cost_cents", "profit_cents", "margin_pct"]
_REQUIRED = {"job_profit": ["job_id", *_PROFIT], "asset_profit": ["asset_id", *_PROFIT]}


def required_columns(table: str) -> list[str]:
    """Columns of a table that must not be NULL."""
    return _REQUIRED.get(table) or [f.name for f in SCHEMAS[table].fields if not f.nullable]


# The key of a fact that few rows of other tables name. Its values are told apart by their prints first.
PRINTED = {"costs": "cost_id"}


class _Rules:
    """The rules of some tables, each with the domain its keys are compared in and a slot there.

    A domain is one column of a parent table, or belongs to one rule. Slot -1 holds the rows that own a key, the
    others the rows that name it; a row that breaks a row rule names a key that nothing owns. ``measure`` tells what
    of a slot breaks the rule: keys that are "lost", as nothing owns them, or "again", on more than one row.
    """

    def __init__(self):
        self.rules: list[tuple[str, str, str, int, int, str]] = []
        self._domains: dict[tuple, int] = {}
        self._slots: dict[int, int] = {}

    def domain(self, *name: str) -> int:
        return self._domains.setdefault(name, len(self._domains))

    def add(self, table: str, kind: str, text: str, domain: int, owns: bool = False) -> int:
        slot = -1 if owns else self._slots.get(domain, 0)
        if not owns:
            self._slots[domain] = slot + 1
        self.rules.append((table, kind, text, domain, slot, "again" if owns else "lost"))
        return slot

    def add_unique(self, table: str, text: str, domain: int, slot: int) -> None:
        """The keys of a slot that has been added must not be repeated."""
        self.rules.append((table, "unique", text, domain, slot, "again"))

    def slots(self) -> int:
        return max(self._slots.values(), default=0)


def _entry(when: Column, domain: int, slot: int, key: Column) -> Column:
    return F.when(when, F.struct(F.lit(domain).alias("domain"), F.lit(slot).alias("slot"), key.cast("string").alias("key")))


def _entries(df: DataFrame, table: str, rules: _Rules, owned: list[str], whole: bool) -> DataFrame | None:
    """(domain, slot, key) of every key and broken row rule of a table, in one pass over it.

    ``owned``: columns whose values others refer to. Without ``whole`` only these count. Of a key that has a column
    ``_wanted_<key>`` only the rows that it marks count.
    """
    nothing, parts = F.lit(None).cast("string"), []
    if whole:
        for column in [c for c in required_columns(table) if c in df.columns]:
            domain = rules.domain(table, "not null", column)
            parts.append(_entry(F.col(column).isNull(), domain, rules.add(table, "not null", column, domain), nothing))
        for check in CHECKS.get(table, []):
            domain = rules.domain(table, "check", check)
            # A condition on a NULL value is not violated.
            broken = F.coalesce(F.expr(f"not ({check})"), F.lit(False))
            parts.append(_entry(broken, domain, rules.add(table, "check", check, domain), nothing))
    named = {}
    for column, parent in REFERENCES.get(table, []) if whole else []:
        domain = rules.domain(parent, column)
        named[column] = domain, rules.add(table, "reference", f"{column} -> {parent}", domain)
        parts.append(_entry(F.col(column).isNotNull(), *named[column], F.col(column)))
    for key in [k for k in UNIQUE_KEYS.get(table, []) if set(k) <= set(df.columns)]:
        single = len(key) == 1 and key[0] in owned
        if not single and len(key) == 1 and key[0] in named:
            # The rows that name the parent's key are the rows that own this one.
            rules.add_unique(table, key[0], *named[key[0]])
        elif whole or single:
            domain = rules.domain(table, key[0]) if single else rules.domain(table, "unique", *key)
            if whole:
                rules.add(table, "unique", ", ".join(key), domain, owns=True)
            present = reduce(Column.__and__, [F.col(c).isNotNull() for c in key])
            if f"_wanted_{key[0]}" in df.columns:
                present = present & F.col(f"_wanted_{key[0]}")
            parts.append(_entry(present, domain, -1, F.concat_ws("\u0001", *[F.col(c).cast("string") for c in key])))
    if not parts:
        return None
    found = F.filter(F.array(*parts), lambda entry: entry.isNotNull())
    return df.select(F.inline(found))


def _wanted(tables: Catalog, table: str, key: str, chosen: list[str]) -> DataFrame:
    """A table with a column that marks the rows whose key may be repeated, or may be named by another table.

    The prints of the keys are compared first. The keys themselves are only needed of rows that this marks; all
    others are on one row, and no row refers to them.
    """
    children = [child for child in chosen if (key, table) in REFERENCES.get(child, [])]
    wanted = [tables[child].dropna(subset=[key]).select(print_of([key]).alias("_print")) for child in children]
    if table in chosen:
        wanted.append(repeated_prints(tables[table], [key]))
    placed = tables[table].withColumn("_print", F.when(F.col(key).isNotNull(), print_of([key])))
    return with_mark(placed, reduce(DataFrame.unionByName, wanted), ["_print"], f"_wanted_{key}").drop("_print")


def _found(tables: Catalog, chosen: list[str]) -> tuple[_Rules, DataFrame]:
    """The rules of the chosen tables, and the (domain, slot, key) of all rows that count for them."""
    needed = {(parent, column) for table in chosen for column, parent in REFERENCES.get(table, [])}
    rules, found = _Rules(), []
    for table in [*chosen, *sorted({parent for parent, _ in needed} - set(chosen))]:
        owned = [column for parent, column in needed if parent == table]
        rows = _wanted(tables, table, PRINTED[table], chosen) if table in PRINTED else tables[table]
        found.append(_entries(rows, table, rules, owned, table in chosen))
    return rules, reduce(DataFrame.unionByName, [f for f in found if f is not None])


def dq_constraints(tables: Catalog, names: list[str] | None = None) -> DataFrame:
    """Violations of every key, required-column, condition and reference rule.

    Each table is read once: its rows give the keys they own, the keys they name and the row rules they break, and one
    grouping by key over all tables tells repeated keys and keys that nothing owns. Counts are summed within
    the tasks first, so a frequent key is a few rows. The ids of costs, of which there are most, are shuffled as
    short prints before (a second look at this column); in the grouping only those count whose print is repeated or
    named. ``names`` limits the report to some tables. Revenue lines that are not stored are computed once, as other
    tables derive from them.
    """
    chosen = names or list(UNIQUE_KEYS)
    if "revenue_engine" in chosen and not tables.stored("revenue_engine"):
        tables = tables.with_tables(revenue_engine=kept(tables["revenue_engine"], "revenue_engine"))
        tables = tables.with_tables(earned_terms=kept(tables["earned_terms"], "earned_terms"))
    rules, entries = _found(tables, chosen)
    slots = [-1, *range(rules.slots())]
    by_key = entries.groupBy("domain", "key").agg(*[F.count_if(F.col("slot") == k).alias(f"n{k}") for k in slots])
    zero, sums, counts = F.lit(0), [], []
    for k in slots:
        n = F.col(f"`n{k}`")
        sums.append(F.sum(F.when(F.col("`n-1`") == 0, n).otherwise(zero)).alias(f"lost{k}"))
        sums.append(F.sum(F.greatest(n - 1, zero)).alias(f"again{k}"))
        for measure in ("lost", "again"):
            counts.append(F.struct(F.lit(k).alias("slot"), F.lit(measure).alias("measure"), F.col(f"`{measure}{k}`").alias("n")))
    broken = by_key.groupBy("domain").agg(*sums).select("domain", F.inline(F.array(*counts)))
    schema = "table_name string, kind string, rule string, domain int, slot int, measure string"
    listed = tables.spark.createDataFrame(rules.rules, schema)
    violations = F.coalesce("n", F.lit(0)).cast("bigint").alias("violations")
    joined = listed.join(broken, ["domain", "slot", "measure"], "left")
    return joined.select("table_name", "kind", "rule", violations)


def missing_rate_cards(tables: Catalog) -> DataFrame:
    """Equipment types with usage but without a rate-card line; their usage earns no revenue."""
    return (
        tables["usage_log"]
        .groupBy("equipment_type")
        .agg(F.count("*").alias("usage_rows"))
        .join(tables["rate_card"].select("equipment_type"), "equipment_type", "left_anti")
    )


def staging_diff(loaded: DataFrame, computed: DataFrame) -> DataFrame:
    """Revenue rows that differ between two sources, with a flag per compared column."""
    compared = [c for c in REVENUE_COLUMNS if c != "usage_id"]
    both = loaded.select("usage_id", F.struct(*compared).alias("a")).join(
        computed.select("usage_id", F.struct(*compared).alias("b")), "usage_id", "full"
    )
    side = F.when(F.col("b").isNull(), "loaded only").when(F.col("a").isNull(), "computed only").otherwise("both")
    flags = [(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(f"{c}_differs") for c in compared]
    total = [F.coalesce(F.col(f"{s}.total_revenue_cents"), F.lit(0)) for s in "ab"]
    return (
        both.where(~F.col("a").eqNullSafe(F.col("b")))
        .select("usage_id", side.alias("found_in"), *flags, (total[0] - total[1]).alias("total_revenue_delta_cents"))
    )
