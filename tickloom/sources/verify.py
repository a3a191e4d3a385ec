"""Checks of written tables against what they were made from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other: all columns, side (`left` or `right`). Columns are matched by name."""
    r = right.select(*left.columns)
    return left.exceptAll(r).withColumn("side", F.lit("left")).unionByName(r.exceptAll(left).withColumn("side", F.lit("right")))


def digest(df: DataFrame) -> DataFrame:
    """n_rows and a digest of the rows that doesn't depend on their order: the sum of a 64-bit hash of each, as decimal."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).alias("digest"))


def outline(df: DataFrame, time: str) -> DataFrame:
    """n_rows, first and last of `time`, and how many rows lack it."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(time).alias("first"), F.max(time).alias("last"), F.count_if(F.col(time).isNull()).alias("without_time"))
