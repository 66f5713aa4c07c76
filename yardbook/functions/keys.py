"""Telling rows that can meet a set of keys from rows that cannot, without a shuffle of the rows.

A join with a large table shuffles all rows of the other side, also those without a partner. One bit per hashed
key, in a table of bounded size that is broadcast, shows most of these beforehand; the others still go through the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardbook.functions.scratch import kept

# Fixed value: bits of the broadcast table (8 MB). More keys than bits only let more rows through.
BITS = 1 << 26


def with_mark(rows: DataFrame, keys: DataFrame, columns: list[str], mark: str) -> DataFrame:
    """``rows`` with a boolean column: false where no row of ``keys`` has the same ``columns``, true where one may.

    A null equals nothing. The columns must have the same types on either side. Row counts do not change.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(BITS)) + 1
    bits = (
        keys.dropna(subset=columns)
        .select(place.alias("_place"))
        .groupBy(F.bitmap_bucket_number("_place").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    )
    position = F.bitmap_bit_position("_place")
    byte = F.substr("_bits", (position / 8).cast("int") + 1, F.lit(1))
    found = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (position % 8).cast("int")) == 1
    whole = F.lit(True)
    for column in columns:
        whole = whole & F.col(column).isNotNull()
    placed = rows.withColumn("_place", place).withColumn("_bucket", F.bitmap_bucket_number("_place"))
    met = placed.join(F.broadcast(bits), "_bucket", "left")
    return met.select(*rows.columns, (whole & F.coalesce(found, F.lit(False))).alias(mark))


def may_meet(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that a semi join with ``keys`` can keep, and a few others."""
    return with_mark(rows, keys, columns, "_met").where("_met").drop("_met")


def print_of(columns: list[str]) -> Column:
    """A hash of the columns as text, five bytes however long they are. Among 10**9 keys one in a thousand shares its print."""
    return F.shiftrightunsigned(F.xxhash64(*[F.col(c).cast("string") for c in columns]), 24)


def repeated_prints(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The prints that stand on more than one row, kept for the session; rows with a null are left out.

    Equal keys have equal prints, so a key whose print is not here is on one row. A print that is here may
    belong to two keys, so its rows still have to be compared by the keys themselves.
    """
    prints = rows.dropna(subset=columns).select(print_of(columns).alias("_print"))
    counted = prints.groupBy("_print").agg(F.count("*").alias("_rows"))
    return kept(counted.where("_rows > 1").select("_print"), "repeated_prints")
