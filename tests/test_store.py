"""Versioned tables: what readers see when a change ends, stops or collides, and what a refresh rewrites."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from yardbook.functions.periods import in_months
from yardbook.operators.revenue import revenue_engine, revenue_id_seq
from yardbook.sources import writers
from yardbook.sources.catalog import Catalog
from yardbook.sources.readers import load_tables
from yardbook.sources.refresh import refresh_usage
from yardbook.sources.store import TableStore, VersionConflict


def lines(spark, *rows):
    return spark.createDataFrame([(date.fromisoformat(d), v) for d, v in rows], "day date, v long")


def values(df):
    return sorted((r.day.isoformat(), r.v) for r in df.collect())


OLD = (("2026-01-05", 1), ("2026-01-09", 2), ("2026-03-01", 3))


@pytest.fixture
def store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    with store.change() as change:
        change.replace("facts", lines(spark, *OLD), "day")
        change.replace("names", spark.createDataFrame([("a",)], "name string"))
    return store


def test_a_change_is_seen_as_a_whole(spark, store):
    assert store.version() == 1 and store.tables() == ["facts", "names"]
    assert values(store.read("facts")) == sorted(OLD)
    with store.change() as change:
        staged = change.replace("facts", lines(spark, ("2026-02-01", 9)), "day")
        assert values(staged) == [("2026-02-01", 9)]
        assert values(store.read("facts")) == sorted(OLD)  # not yet
        change.drop("names")
    assert store.version() == 2 and store.tables() == ["facts"]
    assert values(store.read("facts")) == [("2026-02-01", 9)]
    assert values(store.read("facts", 1)) == sorted(OLD)


@pytest.mark.parametrize("step", ["second table", "manifest", "switch"])
def test_a_stop_leaves_the_old_rows(spark, store, monkeypatch, step):
    before = store.catalog()

    def stop(*_):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError, match="stopped"):
        with store.change() as change:
            change.replace_months("facts", lines(spark, ("2026-01-20", 7)), ["2026-01"])
            if step == "second table":
                stop()
            change.replace("names", spark.createDataFrame([("b",)], "name string"))
            if step == "manifest":
                monkeypatch.setattr(store, "_publish", stop)
            if step == "switch":  # as if the driver died after writing the manifest aside
                real = store._files
                monkeypatch.setattr(store, "_publish", lambda n, t: (real().create(store._path(f"{store.folder}/manifests/.half.json"), False).close(), stop()))
                monkeypatch.setattr(change, "discard", lambda: None)
    monkeypatch.undo()
    again = TableStore(spark, store.folder)
    assert again.version() == 1
    assert values(again.read("facts")) == values(before["facts"]) == sorted(OLD)
    assert [r.name for r in again.read("names").collect()] == ["a"]
    if step == "switch":  # what the lost change wrote is removed by an explicit call only
        assert again.vacuum(hours=0) == 2 and values(again.read("facts")) == sorted(OLD)


def test_two_changes_from_one_version_collide(spark, store):
    first, second = store.change(), store.change()
    first.replace("names", spark.createDataFrame([("first",)], "name string"))
    second.replace("names", spark.createDataFrame([("second",)], "name string"))
    assert first.commit() == 2
    with pytest.raises(VersionConflict):
        second.commit()
    assert [r.name for r in store.read("names").collect()] == ["first"] and store.version() == 2
    assert not [p for p in store._list(f"{store.folder}/manifests") if "/." in p]


def test_months_keep_their_files(spark, store):
    old = store.folders("facts")
    with store.change() as change:
        change.replace_months("facts", lines(spark, ("2026-03-02", 5), ("2026-01-01", 99)), ["2026-02", "2026-03"])
    new = store.folders("facts")
    assert new["2026-01-01"] == old["2026-01-01"] and new["2026-03-01"] != old["2026-03-01"]
    assert values(store.read("facts")) == [("2026-01-05", 1), ("2026-01-09", 2), ("2026-03-02", 5)]
    with store.change() as change:
        change.replace_months("facts", lines(spark), ["2026-01"])
    assert list(store.folders("facts")) == ["2026-03-01"]


def test_vacuum_keeps_what_kept_versions_name(spark, store):
    for v in (10, 20):
        with store.change() as change:
            change.replace_months("facts", lines(spark, ("2026-01-31", v)), ["2026-01"])
    assert store.vacuum(keep=2) == 0  # too young
    assert store.vacuum(keep=2, hours=0) == 1 and sorted(store._numbers()) == [2, 3]
    assert values(store.read("facts", 2)) == [("2026-01-31", 10), ("2026-03-01", 3)]
    assert values(store.read("facts")) == [("2026-01-31", 20), ("2026-03-01", 3)]
    assert store.vacuum(hours=0) == 1 and values(store.read("facts")) == [("2026-01-31", 20), ("2026-03-01", 3)]
    with pytest.raises(ValueError, match="at least one"):
        store.vacuum(keep=0)


def test_empty_tables_and_pruning(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    assert store.version() == 0 and store.tables() == []
    with store.change() as change:
        change.replace("facts", lines(spark), "day")
    assert store.read("facts").columns == ["day", "v", "month_key"] and store.read("facts").count() == 0
    with store.change() as change:
        change.replace_months("facts", lines(spark, *OLD), ["2026-01", "2026-03"])
    plan = in_months(store.read("facts"), "day", ["2026-03"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_key" in plan or "PartitionFilters: [month_key" in plan


def test_readers_resolve_the_version(spark, seeded, stored, tmp_path):
    folder = str(tmp_path / "s")
    names = ["job_master", "usage_log", "rate_card", "job_rates"]
    writers.store_sources(Catalog(spark, {n: stored[n].drop("month_key") for n in names}), folder)
    tables = load_tables(spark, folder, fmt="parquet", allow_missing=True)
    assert tables["usage_log"].count() == stored["usage_log"].count() and tables["costs"].count() == 0
    writers.materialise(tables, folder)
    again = load_tables(spark, folder, fmt="parquet")
    assert again.stored("job_profit") and again["revenue_engine"].count() == seeded["revenue_engine"].count()


# --- refresh -----------------------------------------------------------------------------------------

CARD = [{"rate_card_id": "R1", "equipment_type": "Dozer", "hourly_rate_cents": 10000, "float_fee_cents": 50000}]


def usage(i, job, day, hours, floats=True):
    return {"usage_id": f"U{i}", "job_id": job, "asset_id": "A1", "equipment_type": "Dozer", "usage_date": date.fromisoformat(day),
            "hours_worked": hours, "rain_flag": False, "float_required": floats, "site_name": "S", "operator_name": "O"}


def hire_rows(dec):
    return [
        usage(1, "J1", "2026-01-10", dec("9.0")), usage(2, "J1", "2026-03-10", dec("6.0")),  # 15 hours in two months
        usage(3, "J2", "2026-01-11", dec("9.0")), usage(4, "J2", "2026-02-11", dec("9.0")), usage(5, "J2", "2026-03-12", dec("1.0"), False),
        usage(6, "J3", "2026-04-01", dec("4.0")),
    ]


@pytest.fixture
def hired(spark, mini, tmp_path):
    from decimal import Decimal

    def build(rows):
        tables = mini(usage_log=rows, rate_card=CARD)
        return Catalog(spark, {n: tables[n] for n in ("usage_log", "rate_card", "job_rates")})

    def stored(rows, numbered):
        store = TableStore(spark, str(tmp_path / "hire"))
        tables = writers.store_sources(build(rows), store.folder)
        with store.change() as change:
            writers.build_derived(change, tables, ["revenue_engine"], numbered)
        return store

    return Decimal, build, stored


def same(a, b):
    b = b.select(*[c for c in a.columns if c != "month_key"])
    a = a.select(*b.columns)
    return a.exceptAll(b).count() == 0 == b.exceptAll(a).count() and a.count() > 0


@pytest.mark.parametrize("numbered", [False, True])
@pytest.mark.parametrize("case", ["crosses up", "crosses down", "stays", "row added", "month emptied"])
def test_refresh_equals_a_full_rebuild(spark, hired, numbered, case):
    dec, build, stored = hired
    rows = hire_rows(dec)
    store = stored(rows, numbered)
    old = store.folders("revenue_engine")
    new = {
        "crosses up": [usage(2, "J1", "2026-03-10", dec("8.0")), rows[4]],
        "crosses down": [rows[1]],
        "stays": [usage(2, "J1", "2026-03-10", dec("5.5")), rows[4]],
        "row added": [rows[1], rows[4], usage(7, "J2", "2026-03-01", dec("3.0"))],
        "month emptied": [],
    }[case]
    if case == "crosses down":  # J2 goes from 19 to 18 - 9 hours by its February row
        month, new = "2026-02", []
    else:
        month = "2026-03"
    after = [r for r in rows if r["usage_date"].isoformat()[:7] != month] + new
    done = refresh_usage(store, build(new or rows[:1])["usage_log"], [month])
    full = build(after)
    expected = revenue_id_seq(full) if numbered else revenue_engine(full)
    assert same(expected, store.read("revenue_engine"))
    assert store.read("usage_log").count() == len(after)
    changed = {m for m, folder in store.folders("revenue_engine").items() if old.get(m) != folder} | (set(old) - set(store.folders("revenue_engine")))
    assert changed == set(done.revenue_months) & (set(old) | changed)
    rewritten = {
        "crosses up": {"2026-01-01", "2026-03-01"},
        "crosses down": {"2026-01-01", "2026-02-01"},
        "stays": {"2026-03-01"},
        "row added": {"2026-03-01"},
        "month emptied": {"2026-03-01"},
    }[case]
    moved = {"crosses down": {"2026-03-01", "2026-04-01"}, "row added": {"2026-04-01"}, "month emptied": {"2026-04-01"}}
    assert changed == rewritten | (moved.get(case, set()) if numbered else set())
    assert done.version == store.version() == 3


def test_a_failed_refresh_changes_nothing(hired, monkeypatch):
    from yardbook.sources import refresh

    dec, build, stored = hired
    store = stored(hire_rows(dec), False)
    before, files = store.read("revenue_engine").collect(), store.folders("usage_log")
    monkeypatch.setattr(refresh, "revenue_engine", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        refresh_usage(store, build([usage(2, "J1", "2026-03-10", dec("8.0"))])["usage_log"], ["2026-03"])
    assert store.version() == 2 and store.folders("usage_log") == files
    assert sorted(store.read("revenue_engine").collect()) == sorted(before)
    folder = f"{store.folder}/data/usage_log"
    assert len([f for f in os.listdir(folder) if not f.startswith(".")]) == 1


def test_refresh_of_the_test_tables_updates_every_derived_table(spark, stored, seeded, tmp_path):
    folder = str(tmp_path / "all")
    names = [n for n in stored.sources() if not stored[n].isEmpty()]
    tables = writers.store_sources(Catalog(spark, {n: stored[n].drop("month_key") for n in stored.sources()}), folder)
    with TableStore(spark, folder).change() as change:
        writers.build_derived(change, tables, ["revenue_engine", "job_profit"], numbered=False)
    store = TableStore(spark, folder)
    changed = stored["usage_log"].drop("month_key").withColumn("hours_worked", F.lit(20).cast("decimal(5,1)"))
    done = refresh_usage(store, changed, ["1998-06"])
    log = in_months(stored["usage_log"].drop("month_key"), "usage_date", ["1998-06"]).select("usage_id").withColumn("hit", F.lit(True))
    mixed = stored["usage_log"].drop("month_key").join(log, "usage_id", "left").withColumn("hours_worked", F.when(F.col("hit"), F.lit(20).cast("decimal(5,1)")).otherwise(F.col("hours_worked"))).drop("hit")
    full = Catalog(spark, {n: stored[n] for n in stored.sources()}).with_tables(usage_log=mixed)
    assert names and same(revenue_engine(full), store.read("revenue_engine"))
    assert same(full["job_profit"], store.read("job_profit"))
    assert len(done.revenue_months) < len(store.folders("revenue_engine"))
