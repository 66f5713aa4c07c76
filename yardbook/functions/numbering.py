"""Global row numbers and ranks without sending the table to one task and without a copy of it.

A plain ``row_number() over (order by ...)`` needs a single partition. Here a bounded sample of the order
columns gives range bounds once, and the bounds go into the plan as constants. So a row's range depends
on its values alone and is the same in every execution, also after an executor is lost: one branch counts
the rows of each range (and reads the order columns only), the other numbers the rows inside each range,
and the counts of the ranges before are added. Positions write nothing; sequence ids keep rows that are computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yardbook.functions.scratch import kept

SAMPLE_PER_RANGE = 16


def _sampled_bounds(keyed: DataFrame) -> list:
    """Ascending keys that cut the rows into about as many ranges as a shuffle has partitions.

    The sample is the rows with the smallest hash of their key, so it is the same in every run. A table
    that is smaller than the sample is left whole.
    """
    ranges = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = SAMPLE_PER_RANGE * ranges
    sample = keyed.select("_key").orderBy(F.xxhash64("_key")).limit(size)
    keys = [r["_key"] for r in sample.orderBy("_key").collect()]  # at most `size` keys
    if len(keys) < size:
        return []
    return [keys[at] for at in range(SAMPLE_PER_RANGE, size, SAMPLE_PER_RANGE)]


def _range_of(key: Column, bounds: Column, count: int) -> Column:
    """Number of bounds up to ``key``, by bisection."""

    def halve(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        middle = F.floor((low + high) / 2).cast("int")
        above = F.get(bounds, middle) <= key
        found = F.struct(
            F.when(above, middle + 1).otherwise(low).alias("low"), F.when(above, high).otherwise(middle).alias("high")
        )
        return F.when(low < high, found).otherwise(state)

    start = F.struct(F.lit(0).alias("low"), F.lit(count).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(count.bit_length())), start, halve)["low"]


def _ranged(df: DataFrame, keys: list[Column]) -> tuple[DataFrame, bool]:
    """``df`` with the struct ``_key`` and the number of its range, and whether there are several ranges.

    Rows that are equal in all keys are in one range, so the keys should tell rows apart.
    """
    keyed = df.withColumn("_key", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]))
    bounds = _sampled_bounds(keyed)
    if not bounds:
        return keyed.withColumn("_range", F.lit(0)), False
    schema = T.StructType([T.StructField("bounds", T.ArrayType(keyed.schema["_key"].dataType))])
    constant = df.sparkSession.createDataFrame([(bounds,)], schema).scalar()
    keyed = keyed.withColumn("_bounds", constant)
    return keyed.withColumn("_range", _range_of(F.col("_key"), F.col("_bounds"), len(bounds))).drop("_bounds"), True


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Add the 1-based position of each row by ascending ``order`` columns, nulls first.

    Rows that are equal in them follow by a hash of the whole row, so they too keep their places.
    """
    ranged, several = _ranged(df, order)
    # The order columns are in the rows already, so their struct is not shuffled beside them.
    row = F.row_number().over(Window.partitionBy("_range").orderBy(*order, F.xxhash64(*df.columns)))
    if not several:
        return ranged.select(*df.columns, row.cast("long").alias(name))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    starts = starts.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    # One row per range, so its size is fixed by the number of shuffle partitions.
    placed = ranged.drop("_key").withColumn("_row", row).join(F.broadcast(starts), "_range")
    return placed.select(*df.columns, (F.col("_start") + F.col("_row")).alias(name))


def padded(prefix: str, number: Column, width: int) -> Column:
    """``prefix`` plus the number, zero-filled to ``width``; longer numbers keep all digits."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0")))


def with_sequence_id(
    df: DataFrame, name: str, prefix: str, width: int, order: list[Column], stored: bool = False
) -> DataFrame:
    """Put a sequential id column in front.

    Numbering reads its rows three times, so they are computed once and kept for the session; rows that come
    from stored tables as they are (``stored``) need no copy.
    """
    if not stored:
        df = kept(df, name)
    numbered = with_position(df, order, "_position")
    return numbered.select(padded(prefix, F.col("_position"), width).alias(name), *df.columns)


def with_rank_desc(df: DataFrame, value: str, tie_order: list[str], name: str) -> DataFrame:
    """Add the competition rank of a numeric ``value``, largest first, nulls before; equal values share a rank.

    Ties in ``tie_order`` spread a frequent value over ranges. Inside a range Spark ranks the rows; a value
    that a range continues from the one before has its rank from there, through one small row per range.
    """
    high_first = [F.col(value).isNotNull(), -F.col(value)]
    ranged, _ = _ranged(df, [*high_first, *map(F.col, tie_order)])
    ranged = ranged.withColumn("_value", F.struct(F.col("_key.k0").alias("k0"), F.col("_key.k1").alias("k1")))
    by_value = ranged.groupBy("_range", "_value").agg(F.count("*").alias("_rows"))
    spans = by_value.groupBy("_range").agg(
        F.sum("_rows").alias("_rows"), F.min("_value").alias("_first"), F.max("_value").alias("_last"),
        F.max_by("_rows", "_value").alias("_last_rows"),
    )
    by_range = Window.orderBy("_range")
    upto = by_range.rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumns({"_end": F.sum("_rows").over(upto), "_before": F.lag("_last").over(by_range)})
    # The last value of a range begins in it, unless the range holds nothing but what the one before ends with.
    begins = (F.col("_first") != F.col("_last")) | F.col("_before").isNull() | (F.col("_before") != F.col("_first"))
    begun = F.last(F.when(begins, F.col("_end") - F.col("_last_rows") + 1), ignorenulls=True)
    spans = spans.withColumn("_begun", begun.over(upto)).select(
        "_range", "_before", F.lag("_begun").over(by_range).alias("_earlier"), (F.col("_end") - F.col("_rows")).alias("_start")
    )
    inside = F.col("_start") + F.rank().over(Window.partitionBy("_range").orderBy("_value"))
    rank = F.when(F.col("_value") == F.col("_before"), F.col("_earlier")).otherwise(inside)
    # One row per range, so its size is fixed by the number of shuffle partitions.
    return ranged.join(F.broadcast(spans), "_range").select(*df.columns, rank.alias(name))
