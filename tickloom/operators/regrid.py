"""Irregular readings on a regular grid, filled by a shape-preserving cubic.

Readings are reduced to one per grid period before anything is ordered. Periods are worked on in time shards of bounded
size; the two knots that a shard needs beyond each border come from the neighbouring shards' border rows. Between knots of
one segment the missing periods get the monotone piecewise cubic (slopes by the weighted harmonic mean, one-sided at
segment ends); a silence longer than `max_fill` periods ends the segment and stays marked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shards import sharded_neighbours

PERIOD_MICROS = 60_000_000
#: Missing periods that are still filled; longer silences are marked.
MAX_FILL = 30
#: Periods in a time shard, and in one step of the expansion of a silence.
SHARD_PERIODS = 1_440


def period_readings(readings: DataFrame, *, entity: str = "generation", time: str = "event_time_micros", value: str = "price", tie: str = "tick_id", period: int = PERIOD_MICROS) -> DataFrame:
    """The last reading of each period: entity, period_no (since the epoch), value, n_readings. Readings without time or value don't count."""
    rows = readings.select(F.col(entity), F.unix_micros(time).alias("_t"), F.col(value).cast("double").alias("value"), F.col(tie).alias("_i")).where("_t is not null and value is not null")
    rows = rows.withColumn("period_no", F.floor(F.col("_t") / F.lit(period)).cast("bigint"))
    return rows.groupBy(entity, "period_no").agg(F.max_by("value", F.struct("_t", "_i")).alias("value"), F.count(F.lit(1)).alias("n_readings"))


def _slope(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
    """At an inner knot between intervals of lengths h0, h1 and secants d0, d1: zero at a turn, else the weighted harmonic mean."""
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(d0 * d1 <= 0, 0.0).otherwise((w0 + w1) / (w0 / d0 + w1 / d1))


def _end_slope(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
    """At an end knot of a segment, from its own interval (h0, d0) and the next (h1, d1), kept within the shape."""
    m = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return F.when(m * d0 <= 0, 0.0).when((d0 * d1 <= 0) & (F.abs(m) > 3 * F.abs(d0)), 3 * d0).otherwise(m)


def regular_grid(periods: DataFrame, *, entity: str = "generation", period: int = PERIOD_MICROS, max_fill: int = MAX_FILL, shard_periods: int = SHARD_PERIODS) -> DataFrame:
    """Every period from each entity's first to its last reading: entity, period_start_micros, value, n_readings, fill.

    `periods` as from period_readings. fill: `observed`, `filled` (interpolated) or `gap` (in a silence of more than
    `max_fill` periods; value null). A segment of one reading interpolates nothing, one of two readings linearly. A null entity
    is an entity of its own; non-finite readings fill nothing next to them (their neighbours' value is null).
    """
    rows = periods.withColumn("_shard", F.floor(F.col("period_no") / F.lit(shard_periods)))
    rows = sharded_neighbours(rows, [entity], "_shard", ["period_no"], F.struct(F.col("period_no").alias("x"), F.col("value").alias("y")), 1, 2)
    x, y, far = F.col("period_no"), F.col("value"), F.lit(max_fill + 1)
    back, near, next_ = F.col("`_n-1`"), F.col("`_n+1`"), F.col("`_n+2`")
    h = near["x"] - x
    d = (near["y"] - y) / h
    hb, hn = x - back["x"], next_["x"] - near["x"]
    db, dn = (y - back["y"]) / hb, (next_["y"] - near["y"]) / hn
    has_back, has_next = F.coalesce(hb <= far, F.lit(False)), F.coalesce(hn <= far, F.lit(False))
    left = F.when(has_back, _slope(hb, db, h, d)).when(has_next, _end_slope(h, d, hn, dn)).otherwise(d)
    right = F.when(has_next, _slope(h, d, hn, dn)).when(has_back, _end_slope(h, d, hb, db)).otherwise(d)
    knots = rows.select(entity, "period_no", "value", "n_readings", h.alias("_h"), near["y"].alias("_y1"), F.when(h <= far, left).alias("_m0"), F.when(h <= far, right).alias("_m1"))
    # A long silence is expanded in two steps, so no array grows with it.
    step = F.lit(shard_periods)
    missing = F.coalesce(F.col("_h"), F.lit(1)) - 1
    knots = knots.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor(missing / step))))
    knots = knots.withColumn("_j", F.explode(F.sequence(F.when(F.col("_block") == 0, F.lit(0)).otherwise(F.col("_block") * step), F.least(missing, (F.col("_block") + 1) * step - 1))))
    t = F.col("_j") / F.col("_h")
    cubic = (1 + 2 * t) * (1 - t) * (1 - t) * y + t * (1 - t) * (1 - t) * F.col("_h") * F.col("_m0") + t * t * (3 - 2 * t) * F.col("_y1") + t * t * (t - 1) * F.col("_h") * F.col("_m1")
    seen, short = F.col("_j") == 0, F.col("_h") <= far
    return knots.select(
        entity, ((F.col("period_no") + F.col("_j")) * F.lit(period)).cast("bigint").alias("period_start_micros"), F.when(seen, y).when(short, cubic).alias("value"),
        F.when(seen, F.col("n_readings")).otherwise(F.lit(0)).alias("n_readings"), F.when(seen, "observed").when(short, "filled").otherwise("gap").alias("fill"),
    )
