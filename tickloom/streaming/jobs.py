"""Streams of ticks: candles behind a watermark, and retractions of late records."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import identifier
from ..session import shared_dir

TICKS = "tick_id bigint, instrument string, generation string, event_time_micros timestamp, known_at_micros timestamp, price double, acquisition_id string, page_ordinal bigint"


def tick_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A folder of tick files, or one file, as a stream in the order of its files."""
    head, _, name = path.rstrip("/").rpartition("/")
    path = f"{head}/[{name[0]}]{name[1:]}"  # a pattern may name a file, where a plain path must be a folder
    return spark.readStream.schema(TICKS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def candle_stream(ticks: DataFrame, duration: str = "60 seconds", lateness: str = "30 minutes") -> DataFrame:
    """Candles of streamed ticks; one is emitted when the watermark has passed its end, later ticks for it are dropped by the watermark."""
    rows = ticks.where("event_time_micros is not null and price is not null").withWatermark("event_time_micros", lateness)
    at = F.struct("event_time_micros", "tick_id")
    return rows.groupBy("generation", F.window("event_time_micros", duration).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("observations")
    ).select("generation", F.unix_micros("w.start").alias("open_micros"), "open", "high", "low", "close", "observations")


def retractions(ticks: DataFrame, receipts: DataFrame | None = None, period: int = 300_000_000, cutoff: int = 1_800_000_000, disorder: str = "30 minutes") -> DataFrame:
    """Changes of per-period counts and sums as ticks stream in: generation, period_start_micros, version, change, n, n_values, total.

    The rules are those of late_events.revisions: a tick arrives at known_at, or where that is null at the earliest receipt of its page, and counts up to the
    cut-off after its period's end; a null price counts in n only, a null generation is one of its own. Each batch that changes a period takes its old aggregate back
    and puts the new one in its place. The watermark runs over arrivals, in whose order ticks stream: a key's state is given up when all that may
    still count has arrived, and only arrivals that come `disorder` behind the newest one are lost.
    """
    p = F.unix_micros("event_time_micros") - F.pmod(F.unix_micros("event_time_micros"), F.lit(period))
    rows = ticks.where("event_time_micros is not null").withColumn("p", p).withColumn("arrival", F.col("known_at_micros"))
    if receipts is not None:
        first = receipts.select(identifier(F.col("acquisition_id")).alias("_a"), F.col("ordinal").alias("_o"), "receipt_time_utc").dropna().groupBy("_a", "_o").agg(F.min("receipt_time_utc").alias("_k"))
        rows = rows.join(first.withColumnsRenamed({"_a": "_ra", "_o": "_ro"}), (identifier(F.col("acquisition_id")) == F.col("_ra")) & (F.col("page_ordinal") == F.col("_ro")), "left")
        rows = rows.withColumn("arrival", F.coalesce("arrival", "_k"))
    rows = rows.where(F.unix_micros("arrival") <= F.col("p") + period + cutoff).select("generation", "p", "arrival", "price").withWatermark("arrival", disorder)

    def change(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        generation, p = None if pd.isna(key[0]) else key[0], int(key[1])
        if state.hasTimedOut:
            state.remove()
            return
        version, n, known, total = state.get if state.exists else (-1, 0, 0, 0.0)
        version, n, known, total = int(version), int(n), int(known), float(total)
        old = (n, known, total)
        for df in frames:
            price = df["price"][np.isfinite(df["price"].to_numpy(float))]
            n, known, total = n + len(df), known + len(price), total + float(price.sum())
        out = ([(generation, p, version + 1, -1, *old)] if version >= 0 else []) + [(generation, p, version + 1, 1, n, known, total)]
        state.update((version + 1, n, known, total))
        state.setTimeoutTimestamp(max((p + period + cutoff) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["generation", "period_start_micros", "version", "change", "n", "n_values", "total"])

    schema = "generation string, period_start_micros bigint, version int, change int, n bigint, n_values bigint, total double"
    return rows.groupBy("generation", "p").applyInPandasWithState(change, schema, "version int, n bigint, known bigint, total double", "append", "EventTimeTimeout")


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into a new table of the shared folder, and returns that table."""
    spark = stream.sparkSession
    at = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    stream.writeStream.format("parquet").outputMode(mode).option("path", at).option("checkpointLocation", at + "-progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(at)
