"""Exact duplicates by sorting contents.

The normalised bytes of every text are range partitioned at sampled splitters and sorted, on disk
where a partition is large, so equal texts become neighbours. Splitters hold the first bytes and a
hash of the rest, so that the sample is of bounded size. One pass over each sorted partition
compares every row with the one before it, whole bytes against whole bytes, and names the head of
its run. Document length and identifier are part of the sort key, so a splitter may fall inside a
group of copies: a group that holds a third of all rows is spread over many partitions. Runs that
cross a border are joined afterwards through one small row per partition.

Defined results: null text counts as empty and all empty texts form one group; of equal texts the
one with the most code points stays, then the smallest identifier, null identifiers last; repeated
rows are ordinary copies; an empty table gives an empty result. Texts are compared whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, Scratch, free_name, text_of

def normalised(df: DataFrame, column: str = "text"):
    """The text without white space."""
    return F.regexp_replace(text_of(df, column), f"[{SPACE}]+", "")


def _number_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours in one sorted partition, numbered from 0, with the digest of each."""
    before, run, sha = None, -1, ""
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index("key")).cast(pa.large_binary())
        if len(keys) == 0:
            continue
        same = [before is not None and keys[0].as_py() == before]
        same += pc.equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_pylist()
        runs, shas = [], []
        for i, equal in enumerate(same):
            if not equal:
                run, sha = run + 1, hashlib.sha256(keys[i].as_py()).hexdigest()
            runs.append(run)
            shas.append(sha)
        before = keys[-1].as_py()
        kept = [name for name in batch.schema.names if name != "key"]
        columns = [batch.column(batch.schema.get_field_index(name)) for name in kept]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(runs, pa.int64()), pa.array(shas, pa.string())], names=[*kept, "run", "sha"]
        )


def exact_groups(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", row_key: str | None = None, partitions: int | None = None
) -> DataFrame:
    """One row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``stays``.

    Exactly one row of each group has ``stays`` set, also where identifiers repeat; ``kept`` compares
    the identifier with that of the row that stays. ``row_key`` names a column to carry along and to
    break the last ties.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "content-sort")
    texts = df.select(
        df[doc_id].alias("id"),
        df[row_key].alias("at") if row_key else F.lit(0).alias("at"),
        F.length(text_of(df, text)).alias("chars"),
        F.encode(normalised(df, text), "UTF-8").alias("key"),
    )
    # Splitters are sampled on the driver, so the order starts with a part of fixed size: the first bytes
    # and a hash of all bytes. The whole bytes follow within a partition and decide which rows are equal.
    coarse = [F.substring("key", 1, 32), F.xxhash64("key")]
    rest = [F.col("chars").desc(), F.col("id").asc_nulls_last(), F.col("at")]
    split = [*coarse, *rest]
    ranged = texts.repartitionByRange(partitions, *split) if partitions else texts.repartitionByRange(*split)
    # The row number is the place in the total order, the part the number of the range partition.
    ordered = ranged.sortWithinPartitions(*coarse, F.col("key"), *rest).withColumn("row", F.monotonically_increasing_id())
    placed = ordered.select("row", F.shiftright("row", 33).alias("part"), "id", "at", "key")
    fields = [f for f in placed.schema if f.name != "key"]
    schema = T.StructType([*fields, T.StructField("run", T.LongType()), T.StructField("sha", T.StringType())])
    stored = scratch.store(placed.mapInArrow(_number_runs, schema), "runs")
    # One row per partition: its first and last run. Bounded by the number of partitions.
    last = stored.groupBy("part").agg(
        F.max("run").alias("last"), F.min_by("sha", "run").alias("first_sha"), F.max_by("sha", "run").alias("last_sha")
    )
    border = Window.orderBy("part")
    joined = last.withColumn("joins", F.coalesce(F.lag("last_sha").over(border) == F.col("first_sha"), F.lit(False)))
    # A partition's first run starts where the nearest earlier partition that does not just continue ends.
    own_end = F.when(~F.col("joins") | (F.col("last") > 0), F.struct("part", "last"))
    starts = joined.withColumn(
        "from", F.last(own_end, ignorenulls=True).over(border.rowsBetween(Window.unboundedPreceding, -1))
    ).where("joins")
    starts = starts.select(
        "part", F.lit(0).cast("long").alias("run"), F.col("from.part").alias("head_part"), F.col("from.last").alias("head_run")
    )
    # Size bound of the broadcast: one row per range partition.
    headed = stored.join(F.broadcast(starts), ["part", "run"], "left")
    headed = headed.withColumns(
        {"g_part": F.coalesce("head_part", "part"), "g_run": F.coalesce("head_run", "run")}
    ).select("row", "id", "at", "g_part", "g_run", "sha")
    heads = headed.groupBy("g_part", "g_run").agg(
        F.min_by("id", "row").alias("keep"), F.min("row").alias("head"), F.count("*").alias("size")
    )
    out = headed.join(heads, ["g_part", "g_run"])
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.coalesce(F.col("id") == F.col("keep"), F.col("row") == F.col("head")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        (F.col("row") == F.col("head")).alias("stays"),
        *([F.col("at").alias(row_key)] if row_key else []),
    )


def keep_first(df: DataFrame, text: str = "text", doc_id: str = "doc_id", row_key: str | None = None) -> DataFrame:
    """The rows of ``df`` without their copies; all columns stay as they are, but for ``row_key``, which goes.

    ``row_key`` names a column that tells all rows apart and is the same in every pass; without one the rows
    are stored with a number.
    """
    key, numbered = row_key, df
    if key is None:
        key = free_name(df, "_row")
        numbered = Scratch(df.sparkSession, "content-keep").store(df.withColumn(key, F.monotonically_increasing_id()), "docs")
    stay = exact_groups(numbered, text, doc_id, row_key=key).where("stays").select(key)
    return numbered.join(stay, key, "left_semi").select(*[c for c in df.columns if c != key])
