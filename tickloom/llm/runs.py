"""Runs of equal consecutive events, collapsed to one event with count and duration.

A row's number within its entity minus its number within (entity, canonical value) is constant along a run and changes
between runs of the same value. The numbers are taken within ordered shards; the first and last run of each shard are then
stitched to those of the neighbouring shards, so no entity is ever ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prices import price_units
from ..operators.shards import lookup_join, ordered_shards


def collapse_runs(events: DataFrame, value: Column, *, entity: str = "generation", time: str = "event_time_micros", tie: str = "tick_id", min_records: int = 1, shards: int | None = None) -> DataFrame:
    """One row per longest stretch of consecutive events of one entity with equal `value`: entity, value, first_id, first_micros,
    last_micros, n_records, duration_micros.

    Order is (`time`, `tie`); `tie` should be unique, rows tied in both are taken as one instant in any order. Rows with a null
    value or time are left out before runs are formed. A null entity is an entity of its own. `min_records` drops shorter
    runs from the result, not from the forming. Empty input gives an empty result; other columns are ignored.
    """
    rows = events.select(F.col(entity).alias("_e"), F.unix_micros(time).alias("_t"), F.col(tie).alias("_i"), value.alias("_v")).where("_t is not null and _v is not null")
    rows = ordered_shards(rows, ["_e"], ["_t", "_i"], shards=shards)
    order = (F.col("_t"), F.col("_i"))
    at = F.row_number().over(Window.partitionBy("_e", "_shard").orderBy(*order))
    alike = F.row_number().over(Window.partitionBy("_e", "_shard", "_v").orderBy(*order))
    first = F.min(F.struct("_t", "_i"))
    runs = rows.withColumn("_at", at).withColumn("_run", F.col("_at") - alike).groupBy("_e", "_shard", "_v", "_run").agg(first.alias("_f"), F.max("_t").alias("_l"), F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"), F.max("_at").alias("_to"))
    runs = runs.withColumn("_head", F.col("_from") == 1).withColumn("_tail", F.col("_to") == F.max("_to").over(Window.partitionBy("_e", "_shard")))
    # Only border runs can grow; they meet in one group per entity, at most two of each shard.
    runs = runs.where((F.col("_n") >= min_records) | F.col("_head") | F.col("_tail")).withColumn("_group", F.when(~F.col("_head") & ~F.col("_tail"), F.col("_shard")))
    w = Window.partitionBy("_e", "_group").orderBy("_f")
    joined = F.col("_group").isNull() & F.col("_head") & (F.lag("_shard").over(w) != F.col("_shard")) & (F.lag("_v").over(w) == F.col("_v"))
    runs = runs.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    runs = runs.withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("_e", "_group", "_no").agg(F.min("_f").alias("_f"), F.max("_l").alias("_l"), F.sum("_n").alias("_n"), F.first("_v").alias("_v")).where(F.col("_n") >= min_records)
    return out.select(
        F.col("_e").alias(entity), F.col("_v").alias("value"), F.col("_f._i").alias("first_id"), F.col("_f._t").alias("first_micros"), F.col("_l").alias("last_micros"),
        F.col("_n").alias("n_records"), (F.col("_l") - F.col("_f._t")).alias("duration_micros"),
    )


def standing_prices(ticks: DataFrame, generations: DataFrame, min_records: int = 2) -> DataFrame:
    """Stretches in which a generation's price, at its `price_scale`, comes again and again."""
    scales = generations.groupBy("generation").agg(F.max("price_scale").alias("_scale"))
    rows = ticks.select("generation", "event_time_micros", "tick_id", "price").where("price is not null and event_time_micros is not null")
    return collapse_runs(lookup_join(rows, scales, "generation"), price_units(F.col("price"), F.col("_scale")), min_records=min_records)
