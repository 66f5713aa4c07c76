"""One-row frames put beside other rows without a cross join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar_row(one_row: DataFrame) -> Column:
    """All columns of a one-row frame as one struct column, evaluated once per query."""
    return one_row.select(F.struct(*one_row.columns).alias("row")).scalar()


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` plus the columns of a one-row frame, as a scalar subquery."""
    return df.withColumn("_row", scalar_row(one_row)).select(
        *[F.col(c) for c in df.columns], *[F.col("_row")[c].alias(c) for c in one_row.columns]
    )


def side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """Several one-row frames as one row.

    The rows are stacked with NULL in each other's columns and folded together, so all of them are
    computed in one job.
    """
    types = {f.name: f.dataType.simpleString() for frame in one_row_frames for f in frame.schema.fields}

    def padded(frame: DataFrame) -> DataFrame:
        own = set(frame.columns)
        return frame.selectExpr(
            *[f"`{name}`" if name in own else f"cast(null as {kind}) as `{name}`" for name, kind in types.items()]
        )

    stacked = reduce(DataFrame.union, [padded(frame) for frame in one_row_frames])
    return stacked.selectExpr(*[f"max(`{name}`) as `{name}`" for name in types])
