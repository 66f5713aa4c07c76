"""What the data-quality rules shuffle, and that they count the same for repeated, unknown and missing keys."""

from datetime import date

from pyspark.sql import functions as F

from yardbook.functions.keys import repeated_prints
from yardbook.operators import exceptions, quality, revenue, tax
from yardbook.sources.catalog import Catalog
from yardbook.sources.testdata import finance_catalog

DAY = date(2026, 1, 10)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def counts(tables, names):
    return {(r.table_name, r.kind, r.rule): r.violations for r in quality.dq_constraints(tables, names).collect()}


def test_cost_ids_that_are_alone_and_unnamed_are_not_shuffled_as_text(mini):
    ids = [f"C{i:04d}" for i in range(500)] + ["C0007", "C0007", "C0008", None, None]
    costs = [dict(cost_id=i, usage_id="U1", job_id="J1", asset_id="A1", cost_date=DAY) for i in ids]
    entries = [dict(payg_withholding_id=f"P{i}", job_id="J1", cost_id=c, bas_field="W4") for i, c in enumerate(("C0001", "C0007", "C9999", None))]
    tables = mini(costs=costs, payg_withholding=entries)
    names = ["costs", "payg_withholding"]
    got = counts(tables, names)
    assert got["costs", "unique", "cost_id"] == 3 and got["costs", "not null", "cost_id"] == 2
    assert got["payg_withholding", "reference", "cost_id -> costs"] == 1
    assert counts(tables, ["payg_withholding"])["payg_withholding", "reference", "cost_id -> costs"] == 1
    assert counts(tables, ["costs"])["costs", "unique", "cost_id"] == 3
    rules, found = quality._found(tables, names)
    (domain,) = {domain for table, kind, rule, domain, *_ in rules.rules if (table, kind) == ("costs", "unique")}
    owners = sorted(r.key for r in found.where(F.col("domain") == domain).where("slot = -1").collect())
    assert owners == ["C0001", "C0007", "C0007", "C0007", "C0008", "C0008"]


def test_ids_that_name_a_parent_are_counted_as_keys_by_the_same_entries(mini):
    usage = [dict(usage_id=f"U{i}", job_id="J1", usage_date=DAY) for i in (1, 2, 2, 3)]
    lines = [dict(revenue_id=f"R{i}", usage_id=u, job_id="J1") for i, u in enumerate(("U1", "U1", "U2", "U9", "U9", "U9", None))]
    tables = mini(usage_log=usage, revenue_engine=lines)
    names = ["usage_log", "revenue_engine"]
    got = counts(tables, names)
    assert got["revenue_engine", "unique", "usage_id"] == 3 and got["revenue_engine", "unique", "revenue_id"] == 0
    assert got["revenue_engine", "reference", "usage_id -> usage_log"] == 3
    assert got["usage_log", "unique", "usage_id"] == 1
    rules, found = quality._found(tables, names)
    assert found.where("key in ('U1', 'U2', 'U3', 'U9')").count() == 4 + 6


def test_repeated_prints_tell_repeated_keys(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), (None, 2), (None, 2), ("b", 1)], "k string, v int")
    assert repeated_prints(rows, ["k", "v"]).count() == 1
    assert repeated_prints(rows, ["k"]).count() == 1 and repeated_prints(rows.where("k = 'b'"), ["k"]).count() == 0


def test_few_costs_are_shuffled_for_unknown_jobs_and_withholding(mini, stored):
    for rows in (exceptions.orphan_cost_rows(stored), tax.dated_withholding(stored)):
        assert "bitmap_construct_agg" in plan_of(rows)
    costs = [dict(cost_id=f"C{i}", job_id=j, cost_date=DAY) for i, j in enumerate(("J1", "J1", "J8", "J9", "J8"))]
    entries = [dict(payg_withholding_id=f"P{i}", job_id="J1", cost_id=c, withholding_cents=5) for i, c in enumerate(("C1", "C1", "C3", "C7"))]
    jobs = [dict(job_id="J1", start_date=DAY, end_date=DAY)]
    tables = mini(costs=costs + [costs[3]], payg_withholding=entries, job_master=jobs)
    assert sorted(r.cost_id for r in exceptions.orphan_cost_rows(tables).collect()) == ["C2", "C3", "C3", "C4"]
    assert sorted(r.cost_id for r in tax.dated_withholding(tables).collect()) == ["C1", "C1", "C3", "C3"]


def test_rows_without_a_rate_of_their_job_are_not_shuffled_for_it(spark, stored):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = plan_of(revenue.priced_usage(stored))
        assert "bitmap_construct_agg" in plan
        whole = stored["usage_log"].join(stored["rate_card"].select("equipment_type"), "equipment_type").count()
        assert revenue.priced_usage(stored).count() == whole
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_costs_read_the_usage_once_and_only_if_a_kind_is_left(spark, tmp_path):
    day = "date '1996-02-03'"
    spark.sql("select 0 as n_nationkey, 'Crane' as n_name").write.parquet(f"{tmp_path}/nation.parquet")
    spark.sql("select id as s_suppkey, 0 as s_nationkey from range(3)").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sql(f"""select id as o_orderkey, 1L as o_custkey, {day} as o_orderdate, 'F' as o_orderstatus, 10.0D as o_totalprice
                  from range(200)""").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql(f"""select id as l_orderkey, id * 3 as l_partkey, 1L as l_suppkey, cast(id % 7 as int) as l_linenumber, {day} as l_shipdate,
                  5 as l_quantity, if(id % 2 = 0, 'R', null) as l_returnflag, if(id % 3 = 0, 'O', null) as l_linestatus,
                  100.4D as l_extendedprice from range(200)""").write.parquet(f"{tmp_path}/lineitem.parquet")
    costs = finance_catalog(spark, str(tmp_path))["costs"]
    scans = lambda df: plan_of(df).count("FileScan parquet [l_")
    assert scans(costs) == 1
    assert scans(costs.where("tax_code = 'ABN'")) == 0 and scans(costs.where("cost_category = 'Fuel'")) == 1
    rows = range(200)
    want = {
        "Fuel": 200, "Labour": 200, "Maintenance": sum(i % 7 % 3 == 0 for i in rows),
        "Transport/float": sum(i % 3 == 0 and i % 7 <= 3 for i in rows), "E-tag": sum(i * 3 % 5 == 0 for i in rows),
        "Subcontract ABN": 10,
    }
    assert {r.cost_category: r["count"] for r in costs.groupBy("cost_category").count().collect()} == want
    lost = costs.where("job_id = 'J-MISSING'").collect()
    assert sorted(r.cost_category for r in lost) == ["E-tag"] and lost[0].amount_cents == 2000
    fuel = costs.where("cost_category = 'Fuel'").first()
    assert (fuel.amount_cents, fuel.tax_code, fuel.gst_input_cents, fuel.supplier_name) == (100, "GST", 10, "Fuel depot")
