"""Shapes that must hold for large and skewed data."""

import os

from pyspark.sql import functions as F

from yardbook.functions.numbering import padded, with_position, with_rank_desc, with_sequence_id
from yardbook.functions.scratch import kept
from yardbook.operators import exceptions, quality, revenue
from yardbook.plans.registry import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hot_rows(spark, n=30_000):
    """A third of the rows share one key."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 997).alias("k"), F.col("id").alias("row")
    )


def test_positions_match_row_number_under_a_hot_key(spark):
    df = hot_rows(spark)
    got = with_position(df, [F.col("k"), -F.col("row")]).orderBy("position").collect()
    want = sorted(((r.k, r.row) for r in df.collect()), key=lambda r: (r[0], -r[1]))
    assert [(r.k, r.row) for r in got] == want
    assert [r.position for r in got] == list(range(1, len(want) + 1))


def test_numbering_writes_nothing_and_counts_order_columns_only(spark, tmp_path):
    path = str(tmp_path / "rows")
    hot_rows(spark).withColumn("wide", F.repeat(F.lit("x"), 50)).write.parquet(path)
    folders = {*os.listdir("."), *os.listdir(tmp_path)}
    numbered = with_position(spark.read.parquet(path), [F.col("k"), F.col("row")])
    scans = [line for line in plan_of(numbered).splitlines() if "FileScan parquet" in line]
    assert sorted("wide" in line for line in scans) == [False, True]
    numbered.collect()
    assert {*os.listdir("."), *os.listdir(tmp_path)} == folders


def test_positions_are_the_same_in_every_execution(spark):
    df = hot_rows(spark)
    numbered = with_position(df, [F.col("k")])  # ties in the order
    assert sorted(map(tuple, numbered.collect())) == sorted(map(tuple, numbered.repartition(5).collect()))


def test_small_tables_are_one_range(spark):
    df = spark.createDataFrame([(3,), (None,), (1,)], "n long")
    assert {r.n: r.position for r in with_position(df, [F.col("n")]).collect()} == {None: 1, 1: 2, 3: 3}
    assert with_position(df.where("false"), [F.col("n")]).collect() == []


def test_rank_of_a_value_that_fills_many_ranges(spark):
    df = spark.range(4_000).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") % 40 == 0, F.col("id")).when(F.col("id") % 41 != 0, 0).alias("v"))
    got = {(r.v, r.place) for r in with_rank_desc(df, "v", ["name"], "place").collect()}
    values = [r.v for r in df.collect()]
    order = sorted(values, key=lambda v: (v is not None, -(v or 0)))
    assert got == {(v, order.index(v) + 1) for v in set(values)}


def test_rank_gives_ties_the_same_place(spark):
    df = spark.createDataFrame([(f"c{i:04d}", 0 if i % 3 else i % 50) for i in range(3_000)], "name string, v long")
    values = sorted((r.v for r in df.collect()), reverse=True)
    for r in with_rank_desc(df, "v", ["name"], "place").collect():
        assert r.place == values.index(r.v) + 1


def test_ids_grow_beyond_their_width(spark):
    rows = spark.createDataFrame([(1,), (99_999,), (123_456,)], "n long")
    ids = [r.v for r in rows.select(padded("REV", F.col("n"), 5).alias("v")).collect()]
    assert ids == ["REV00001", "REV99999", "REV123456"]


def test_site_changes_of_a_hot_asset(spark, mini, stored):
    usage = stored["usage_log"].withColumn(
        "asset_id", F.when(F.crc32("usage_id") % 3 == 0, "HOT").otherwise(F.col("asset_id"))
    )
    tables = stored.with_tables(usage_log=usage)
    got = {r.usage_id: r.float_required for r in revenue.float_required_by_site(tables).collect()}
    last, want = {}, {}
    rows = usage.select("asset_id", "usage_date", "job_id", "usage_id", "site_name").collect()
    for r in sorted(rows, key=lambda r: (r.asset_id, r.usage_date, r.job_id, r.usage_id)):
        want[r.usage_id] = last.get(r.asset_id) != r.site_name
        last[r.asset_id] = r.site_name
    assert got == want


def test_skewed_override_join_is_split(spark, stored):
    """One job holds a third of the usage; without broadcasts Spark splits its join partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        usage = stored["usage_log"].repartition(16).withColumn(
            "job_id", F.when(F.crc32("usage_id") % 3 == 0, "J000000007").otherwise(F.col("job_id"))
        )
        df = revenue.rate_selection(stored.with_tables(usage_log=usage))
        assert df.count() == usage.count()
        rows = df.collect()
        assert len(rows) == usage.count()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_orphans_compare_distinct_jobs(stored):
    plan = plan_of(exceptions.orphan_cost_rows(stored))
    assert "LeftAnti" in plan and "LeftSemi" in plan


def test_no_query_pairs_rows_without_a_key(stored):
    for name in ("exception_scan", "overview_kpis", "forecast_assumptions", "cost_mix", "payroll_compliance"):
        plan = plan_of(QUERIES[name](stored))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_unflagged_usage_is_not_shuffled_for_float_fees(stored):
    """Only rows that charge a float fee meet the term hours."""
    plan = plan_of(revenue.revenue_engine(stored))
    assert plan.count("total_term_hours") and "Union" in plan


def test_sequence_ids_compute_their_rows_once(spark):
    numbered = with_sequence_id(hot_rows(spark), "row_id", "R", 5, [F.col("k"), F.col("row")])
    plan = plan_of(numbered)
    assert "FileScan parquet" in plan and "Range (" not in plan
    want = sorted((r.k, r.row) for r in hot_rows(spark).collect())
    assert [(r.k, r.row) for r in numbered.orderBy("row_id").collect()] == want


def test_shuffled_rows_hold_their_order_columns_once(spark):
    numbered = with_position(hot_rows(spark), [F.col("k"), F.col("row")])
    sorts = [line for line in plan_of(numbered).splitlines() if " Sort [_range" in line]
    assert sorts and not any("_key" in line for line in sorts)


def test_billing_reads_computed_terms_once(raw):
    """Earned and invoiced amounts come from the hire terms, neither prices the usage again."""
    assert not any("lineitem" in file for file in raw["billing_terms"].inputFiles())
    assert not any("lineitem" in file for file in raw["invoice_myob"].inputFiles())


def test_quality_rules_compute_revenue_once(raw, monkeypatch):
    labels = []
    monkeypatch.setattr(quality, "kept", lambda df, label: labels.append(label) or kept(df, label))
    quality.dq_constraints(raw)
    assert labels == ["revenue_engine", "earned_terms"]
