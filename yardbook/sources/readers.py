"""Readers of the source tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yardbook.functions.periods import MONTH_KEY
from yardbook.sources.catalog import Catalog
from yardbook.sources.schemas import OPTIONAL_COLUMNS, SCHEMAS, SOURCE_TABLES
from yardbook.sources.store import TableStore

# Texts that count as true in a boolean column.
TRUE_WORDS = ("true", "t", "1", "yes", "y")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on whatever file system the path names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def _file_schema(spark: SparkSession, path: str, name: str) -> T.StructType:
    """The declared schema without optional columns that the file leaves out."""
    header = spark.read.option("header", True).csv(path).columns
    optional = OPTIONAL_COLUMNS.get(name, ())
    return T.StructType([f for f in SCHEMAS[name].fields if f.name in header or f.name not in optional])


def _complete(df: DataFrame, name: str) -> DataFrame:
    """All declared columns in order; optional ones that are missing become NULL."""
    return df.select(
        *[
            F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in SCHEMAS[name].fields
        ]
    )


def read_csv_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A CSV table under its declared schema; bad values and wrong headers stop the job."""
    reader = spark.read.schema(_file_schema(spark, path, name)).options(
        header=True, nullValue="", mode="FAILFAST", enforceSchema=False
    )
    return _complete(reader.csv(path), name)


def read_parquet_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A Parquet table; the month folders of a partitioned table stay visible for pruning."""
    stored = spark.read.parquet(path)
    table = _complete(stored, name)
    return table if MONTH_KEY not in stored.columns else stored.select(*table.columns, MONTH_KEY)


def table_or_empty(spark: SparkSession, folder: str, name: str, fmt: str = "csv") -> DataFrame:
    """A table of a folder, or an empty one with the declared schema if it is missing."""
    path = f"{folder.rstrip('/')}/{name}.{fmt}"
    if not _exists(spark, path):
        return empty_table(spark, name)
    read = {"csv": read_csv_table, "parquet": read_parquet_table}[fmt]
    return read(spark, path, name)


def load_tables(spark: SparkSession, folder: str, fmt: str = "csv", allow_missing: bool = False) -> Catalog:
    """Catalog of the source tables in a folder, one file or folder per table.

    A missing table is an error unless ``allow_missing`` is set; then it is empty. For a folder with
    versions (``TableStore``) Parquet tables are those of the current version, derived ones included.
    """
    if fmt == "parquet" and (store := TableStore(spark, folder)).version():
        kept = store.catalog()
        missing = [name for name in SOURCE_TABLES if not kept.stored(name)]
        empty = {name: empty_table(spark, name) for name in missing if allow_missing}
        return kept.with_tables(**empty)

    def loader(name: str):
        def read(_: Catalog) -> DataFrame:
            # The staging copy comes from a file of the revenue rows.
            file = "revenue_engine" if name == "staging_revenue_engine" else name
            if allow_missing:
                return table_or_empty(spark, folder, file, fmt)
            reader = {"csv": read_csv_table, "parquet": read_parquet_table}[fmt]
            return reader(spark, f"{folder.rstrip('/')}/{file}.{fmt}", file)

        return read

    return Catalog(spark, {name: loader(name) for name in SOURCE_TABLES})


def _lenient(field: T.StructField) -> Column:
    """One column of raw text in its declared type: bad dates become NULL, bad money zero."""
    raw = F.col(field.name)
    if isinstance(field.dataType, T.DateType):
        return raw.try_cast("date")
    if isinstance(field.dataType, T.BooleanType):
        return F.lower(F.trim(raw.cast("string"))).isin(*TRUE_WORDS)
    if field.name.endswith("_cents") and isinstance(field.dataType, T.LongType):
        return F.coalesce(raw.try_cast("bigint"), F.lit(0).cast("bigint"))
    return raw.try_cast(field.dataType)


def coerce_table(raw: DataFrame, name: str) -> DataFrame:
    """Raw text columns as the declared table, without failing on bad values.

    Columns that the source does not have become NULL (money: zero).
    """
    padded = raw.select(
        *[
            (F.col(f.name) if f.name in raw.columns else F.lit(None).cast("string")).alias(f.name)
            for f in SCHEMAS[name].fields
        ]
    )
    return padded.select(*[_lenient(f).alias(f.name) for f in SCHEMAS[name].fields])


def read_csv_lenient(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A CSV table with bad values repaired instead of refused."""
    return coerce_table(spark.read.options(header=True, nullValue="").csv(path), name)
