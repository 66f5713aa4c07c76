"""Revenue lines of usage that is stored by month: which rows a build and a refresh shuffle, and that none is lost."""

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from yardbook.functions.keys import may_meet, with_mark
from yardbook.operators.revenue import REVENUE_COLUMNS, revenue_engine
from yardbook.sources.catalog import Catalog
from yardbook.sources.refresh import refresh_usage
from yardbook.sources.store import Change, TableStore
from yardbook.sources.writers import build_derived, store_sources

USAGE = "usage_id string, job_id string, asset_id string, equipment_type string, usage_date date, hours_worked decimal(5,1), rain_flag boolean, float_required boolean"


def test_marks_miss_no_key_and_no_row(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3), ("c", None)], "k string, v long")
    keys = spark.createDataFrame([("a", 1), ("a", 1), (None, 3), ("c", None)], "k string, v long")
    found = sorted(map(str, ((r.k, r.v, r.met) for r in with_mark(rows, keys, ["k", "v"], "met").collect())))
    assert found == sorted(map(str, [("a", 1, True), ("a", 1, True), ("b", 2, False), (None, 3, False), ("c", None, False)]))
    numbers = spark.range(20000).selectExpr("cast(id as string) as k")
    assert may_meet(numbers, numbers.where("k % 3 = 0"), ["k"]).join(numbers.where("k % 3 = 0"), "k").count() == 6667
    assert may_meet(numbers, numbers.where("k % 3 = 0"), ["k"]).count() < 6700
    assert may_meet(numbers, numbers.where("false"), ["k"]).count() == 0


def test_plain_lines_of_stored_months_are_not_dealt_again(spark, tmp_path, monkeypatch):
    def row(n, job, day, hours, floats, rain=False):
        return (f"u{n}", job, "a1", "crane" if n % 2 else "digger", date.fromisoformat(day), Decimal(str(hours)), rain, floats)

    usage = [row(n, f"j{n % 9}", f"1998-0{1 + n % 7}-1{n % 10}", 4 + n % 5, False, n % 3 == 0) for n in range(60)]
    usage += [row(60, "jx", "1998-06-03", 4, True), row(61, "jx", "1998-03-04", 3, True), row(62, "jx", "1998-03-05", 2, None)]
    usage += [row(63, None, "1998-03-06", 2, True), row(61, "jx", "1998-03-04", 3, True)]
    tables = Catalog(
        spark,
        {
            "usage_log": spark.createDataFrame(usage, USAGE),
            "rate_card": spark.createDataFrame([("crane", 10000, 500), ("digger", 7000, 0)], "equipment_type string, hourly_rate_cents long, float_fee_cents long"),
            "job_rates": spark.createDataFrame([("j1", "crane", 9000), ("j2", "digger", None), (None, "crane", 1)], "job_id string, equipment_type string, override_rate_cents long"),
        },
    )
    laid = []
    write = Change._write

    def watched(self, name, df, day, *more):
        laid.append((name, df._jdf.queryExecution().optimizedPlan().toString(), more))
        return write(self, name, df, day, *more)

    monkeypatch.setattr(Change, "_write", watched)
    stored = store_sources(tables, str(tmp_path))
    store = TableStore(spark, str(tmp_path))
    with store.change() as change:
        build_derived(change, stored, ["revenue_engine"], numbered=False)
    built = store.read("revenue_engine").select(*REVENUE_COLUMNS)
    whole = revenue_engine(tables)
    assert built.exceptAll(whole).count() == 0 and whole.exceptAll(built).count() == 0

    longer = tables["usage_log"].where("month(usage_date) = 6").withColumn("hours_worked", (F.col("hours_worked") + 8).cast("decimal(5,1)"))
    done = refresh_usage(store, longer, ["1998-06"])
    assert done.revenue_months == ["1998-03-01", "1998-06-01"]
    after = store.read("revenue_engine").select(*REVENUE_COLUMNS)
    whole = revenue_engine(tables.with_tables(usage_log=tables["usage_log"].where("month(usage_date) <> 6").unionByName(longer)))
    assert after.exceptAll(whole).count() == 0 and whole.exceptAll(after).count() == 0

    # Both times the lines are written as they come: straight from the stored months, or dealt by month below a union.
    writes = [(plan, more) for name, plan, more in laid if name == "revenue_engine"]
    assert len(writes) == 2 and all(more == (True,) for _, more in writes)
    for plan, _ in writes:
        assert "Union" in plan.split("RebalancePartitions")[0]
    assert store._list(f"{store.folder}/data/crossing_terms") == []
