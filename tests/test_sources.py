"""Readers and writers."""

import pytest
from pyspark.sql import functions as F

from yardbook.operators.revenue import revenue_engine
from yardbook.sources import readers, writers
from yardbook.sources.schemas import SCHEMAS, SOURCE_TABLES

RATES = """rate_card_id,equipment_type,hourly_rate_cents,float_fee_cents,effective_from,effective_to,source_note
R1,Dozer,14000,50000,2026-01-01,,first
R2,Loader,{amount},60000,{day},2026-12-31,second
"""


def folder_with(tmp_path, **values):
    (tmp_path / "rate_card.csv").write_text(RATES.format(**{"amount": "15000", "day": "2026-01-01", **values}))
    return str(tmp_path)


def test_csv_has_declared_types_and_nulls(spark, tmp_path):
    table = readers.load_tables(spark, folder_with(tmp_path))["rate_card"]
    assert [f.dataType for f in table.schema] == [f.dataType for f in SCHEMAS["rate_card"]]
    assert [r.effective_to is None for r in table.orderBy("rate_card_id").collect()] == [True, False]


def test_csv_refuses_bad_values(spark, tmp_path):
    table = readers.load_tables(spark, folder_with(tmp_path, amount="many"))["rate_card"]
    with pytest.raises(Exception, match="Malformed records"):
        table.collect()


def test_lenient_reader_repairs_bad_values(spark, tmp_path):
    path = folder_with(tmp_path, amount="many", day="soon") + "/rate_card.csv"
    row = readers.read_csv_lenient(spark, path, "rate_card").where("rate_card_id = 'R2'").first()
    assert row.hourly_rate_cents == 0 and row.effective_from is None and row.float_fee_cents == 60000


def test_missing_table_is_empty_with_its_schema(spark, tmp_path):
    tables = readers.load_tables(spark, str(tmp_path), allow_missing=True)
    for name in SOURCE_TABLES:
        assert tables[name].columns == SCHEMAS[name].fieldNames() and tables[name].count() == 0


def test_optional_columns_may_be_absent(spark, tmp_path):
    (tmp_path / "exception_log.csv").write_text("exception_id,exception_type,job_id,asset_id,amount_cents,message\n")
    assert readers.load_tables(spark, str(tmp_path))["exception_log"].columns[-1] == "severity"


def test_boolean_words(spark):
    raw = spark.createDataFrame([(w,) for w in ("TRUE", " t", "1", "Yes", "y", "no", "0", "false")], "rain_flag string")
    got = [r.rain_flag for r in readers.coerce_table(raw, "usage_log").collect()]
    assert got == [True] * 5 + [False] * 3


def test_parquet_round_trip_keeps_month_folders(spark, stored, tmp_path):
    writers.write_table(stored["usage_log"].drop("month_key"), str(tmp_path / "usage_log.parquet"), "usage_date")
    table = readers.load_tables(spark, str(tmp_path), fmt="parquet")["usage_log"]
    assert table.columns[-1] == "month_key" and table.count() == stored["usage_log"].count()


def test_period_reads_one_month_folder(stored):
    plan = revenue_engine(stored, "1998-06")._jdf.queryExecution().executedPlan().toString()
    assert "month_key" in plan and "PushedFilters: [IsNotNull(usage_date)" in plan


def test_materialised_revenue_equals_computed(stored, seeded):
    computed, kept = revenue_engine(stored), seeded["revenue_engine"]
    assert kept.select(*computed.columns).exceptAll(computed).count() == 0
    assert kept.select("revenue_id").distinct().count() == kept.count() == computed.count()


def test_large_keys_keep_their_digits(spark, tmp_path):
    from yardbook.sources.testdata import finance_catalog

    for name in ("region", "nation", "customer", "part", "lineitem", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    orders, suppliers = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("orders", "supplier"))
    grown = orders.withColumn("o_orderkey", F.col("o_orderkey") + F.when(F.col("o_orderkey") % 2 == 0, 10_000_000_000).otherwise(0))
    grown.write.parquet(f"{tmp_path}/orders.parquet")
    suppliers.withColumn("s_suppkey", F.col("s_suppkey") + F.when(F.col("s_suppkey") % 2 == 0, 100_000_000).otherwise(0)).write.parquet(
        f"{tmp_path}/supplier.parquet"
    )
    tables = finance_catalog(spark, str(tmp_path))
    assert tables["job_master"].select("job_id").distinct().count() == orders.count()
    assert tables["fleet_register"].select("asset_id").distinct().count() == suppliers.count()
    assert tables["job_master"].where("length(job_id) = 12").count() > 0


def test_month_end_export(spark, stored, tmp_path):
    target = writers.month_end_export(stored, "1998-06", str(tmp_path), "2001-12-31")
    assert target.endswith("period=1998-06-01")
    names = ["revenue", "wip", "job_profit", "asset_profit", "bas", "journal_pack", "exceptions"]
    counts = {n: spark.read.parquet(f"{target}/{n}").count() for n in names}
    assert counts["bas"] == 1 and counts["journal_pack"] == 8 and all(counts.values())


def test_empty_csv_export_keeps_its_header(spark, tmp_path):
    writers.write_datasets({"empty": readers.empty_table(spark, "exception_log")}, str(tmp_path), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "empty")).columns == SCHEMAS["exception_log"].fieldNames()


def test_views(stored):
    stored.register_views("v_")
    assert stored.spark.sql(
        "select count(*) n from v_wip_summary where wip_cents > :limit", args={"limit": 500000}
    ).first().n == stored["wip_summary"].where("wip_cents > 500000").count()
