"""Overlapping intervals merged to continuous periods, and the gaps between them.

session_window with each row's own length merges overlapping spans natively, first within the map tasks (so an entity with
a third of the spans is mostly merged before the shuffle), then per entity and block of starts; a span belongs to the block it starts in, however
long it is. The pieces, which a table keeps, are joined where they overlap or touch: a piece that begins after all earlier ones have ended begins a period,
and the period before has ended at the greatest end so far.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .shards import running, sharded_neighbours

#: Length of a block of starts, a day.
BLOCK_MICROS = 86_400_000_000
#: Merges sessions within the map tasks; set while the pieces are made.
_LOCAL = "spark.sql.sessionWindow.merge.sessions.in.local.partition"
_LAST = (1 << 63) - 1


def _pieces(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans (keys, _block, _s, _e) merged within their blocks, as a table."""
    length = F.concat((F.col("_e") - F.col("_s")).cast("string"), F.lit(" microseconds"))
    merged = rows.withColumn("_at", F.timestamp_micros("_s")).groupBy(*keys, "_block", F.session_window("_at", length)).agg(F.count(F.lit(1)).alias("_n"))
    pieces = merged.select(*keys, "_block", F.unix_micros("session_window.start").alias("_s"), F.unix_micros("session_window.end").alias("_e"))
    spark = rows.sparkSession
    before = spark.conf.get(_LOCAL, None)
    spark.conf.set(_LOCAL, "true")
    try:
        return written(pieces, "pieces")
    finally:
        spark.conf.unset(_LOCAL) if before is None else spark.conf.set(_LOCAL, before)


def continuous_periods(spans: DataFrame, keys: Sequence[str], start: str, end: str, block: int = BLOCK_MICROS) -> DataFrame:
    """Continuous periods of left-closed spans [start, end) in micros: keys, period_start, period_end, gap_end.

    `gap_end` is the start of the entity's next period, null at its last. Spans that overlap or touch are one period. Spans
    without both bounds or not ending after their start are left out; repeated spans change nothing; null keys are equal keys.
    """
    rows = spans.select(*keys, F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e")).where("_s < _e")
    pieces = _pieces(rows.withColumn("_block", F.floor(F.col("_s") / F.lit(block)).cast("bigint")), keys)
    reached = running(pieces, keys, "_block", ["_s"], {"_reach": F.col("_e")}, "max")
    heads = reached.where("_reach is null or _reach < _s").select(*keys, "_block", "_s", "_reach")
    # After the last period of an entity comes a mark that knows where all its spans have ended.
    marks = pieces.groupBy(*keys).agg(F.max("_e").alias("_reach")).select(*keys, F.lit(_LAST).alias("_block"), F.lit(_LAST).alias("_s"), "_reach")
    x = sharded_neighbours(heads.unionByName(marks), keys, "_block", ["_s"], F.struct("_s", "_reach"), 0, 1).where(F.col("_s") < _LAST)
    after = F.col("`_n+1`")
    return x.select(*keys, F.col("_s").alias("period_start"), after["_reach"].alias("period_end"), F.when(after["_s"] < _LAST, after["_s"]).alias("gap_end"))


def gaps(periods: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The gaps between consecutive periods: keys, gap_start_micros, gap_end_micros."""
    return periods.where("gap_end is not null").select(*keys, F.col("period_end").alias("gap_start_micros"), F.col("gap_end").alias("gap_end_micros"))
