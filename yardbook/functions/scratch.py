"""A folder of the session's own below the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; on one machine, where none is named, beside the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return base.rstrip("/")


def session_folder(spark: SparkSession, label: str) -> str:
    """A new folder for tables that results of this session read; deleted when the session's program ends."""
    path = f"{shared_folder(spark)}/yardbook-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"

    def delete() -> None:
        if spark.sparkContext._jsc is not None:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    atexit.register(delete)
    return path


def kept(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df``, computed once and read from a folder of the session by all that use them."""
    path = session_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
