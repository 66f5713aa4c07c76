import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from yardbook.session import local_session

    session = local_session("yardbook-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw(spark):
    """Finance tables as lazy projections of the test tables."""
    from yardbook.sources.testdata import finance_catalog

    return finance_catalog(spark, SF_DIR)


@pytest.fixture(scope="session")
def stored(raw, tmp_path_factory):
    """The same source tables, stored as Parquet by month."""
    from yardbook.sources.writers import store_sources

    return store_sources(raw, str(tmp_path_factory.mktemp("sources")))


@pytest.fixture(scope="session")
def seeded(stored, tmp_path_factory):
    """Source and derived tables, all stored."""
    from yardbook.sources.writers import materialise

    return materialise(stored, str(tmp_path_factory.mktemp("derived")))


@pytest.fixture(scope="session")
def sql():
    from compare import sql_connection

    return sql_connection(SF_DIR)


@pytest.fixture(scope="session")
def mini(spark):
    """Builds a small catalog from rows, with unused columns filled in."""
    from yardbook.sources.catalog import Catalog
    from yardbook.sources.readers import empty_table
    from yardbook.sources.schemas import SCHEMAS
    from pyspark.sql import types as T

    filler = {
        T.StringType: "x", T.LongType: 0, T.IntegerType: 1, T.BooleanType: False,
    }

    def build(**tables):
        frames = {}
        for name in SCHEMAS:
            rows = tables.get(name)
            if rows is None:
                if name not in ("revenue_engine", "forecast_assumptions", "bas_check", "staging_revenue_engine"):
                    frames[name] = empty_table(spark, name)
                continue
            schema = SCHEMAS[name]
            full = [
                tuple(row.get(f.name, filler.get(type(f.dataType)) if not f.nullable else None) for f in schema)
                for row in rows
            ]
            loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
            frames[name] = spark.createDataFrame(full, loose)
        return Catalog(spark, frames)

    return build
