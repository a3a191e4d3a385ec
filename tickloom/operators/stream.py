"""Ordered tick streams: validation, candles on an epoch grid, quality flags and profiles.

A stream is one generation's records in order of arrival. Ordered work on ticks runs in shards (see shards.py), so no
generation passes through one task; candles, which are few per generation, use plain windows. The shards here are fixed
ranges of the order itself, not sampled ones, since totals per shard are computed apart from the rows they are added to.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prices import bps_change, float_units, interval_open, relative_move
from .shards import lookup_join, running, sharded_neighbours

E = "generation"
MICRO = 1_000_000
#: Arrivals in a shard of validation, and micros in a shard of ordered records.
SHARD_ARRIVALS, SHARD_MICROS = 65_536, 900 * MICRO


@dataclass(frozen=True)
class Checks:
    """Thresholds of the quality flags; a check that is None is off and its flag false."""

    min_observations: int | None = 3
    hard_min_observations: int | None = 2
    gap_max: int | None = 30 * MICRO
    gap_reopen: int | None = 600 * MICRO
    frozen_observations: int | None = 8
    frozen_micros: int | None = 60 * MICRO
    jump_bps: int | None = 40
    span_percent: int | None = 20


CHECKS = Checks()


def classified(ticks: DataFrame, generations: DataFrame) -> DataFrame:
    """Every tick with `reason`: null if accepted, else missing_value, unknown_scale, off_scale, backwards_time or conflicting_duplicate.

    Adds t (micros), seq (order of arrival), units. A record is held against the last accepted ones: one before the newest
    accepted time is backwards; one at that time with another price than the first there conflicts. Identical repeats are accepted.
    """
    scales = generations.groupBy(E).agg(F.max("price_scale").alias("_scale"))
    rows = lookup_join(ticks.select(E, F.col("tick_id").alias("seq"), F.unix_micros("event_time_micros").alias("t"), "price"), scales, E)
    units, exact = float_units(F.col("price"), F.col("_scale"))
    rows = rows.withColumn("units", units).withColumn(
        "_bad", F.when(F.col("t").isNull() | F.col("price").isNull(), "missing_value").when(F.col("_scale").isNull(), "unknown_scale").when(~exact, "off_scale")
    )
    rows = rows.withColumn("_shard", F.floor(F.col("seq") / F.lit(SHARD_ARRIVALS)))
    rows = running(rows, [E], "_shard", ["seq"], {"_newest": F.when(F.col("_bad").isNull(), F.col("t"))}, "max")
    late = F.coalesce(F.col("t") < F.col("_newest"), F.lit(False))
    rows = rows.withColumn("_bad", F.coalesce("_bad", F.when(late, "backwards_time")))
    at = Window.partitionBy(E, "t", F.col("_bad").isNull()).orderBy("seq")
    clash = F.col("_bad").isNull() & (F.first("units").over(at) != F.col("units"))
    return rows.select(E, "seq", "t", "price", "units", F.coalesce("_bad", F.when(clash, "conflicting_duplicate")).alias("reason"))


def accepted(ticks: DataFrame, generations: DataFrame) -> DataFrame:
    """The accepted records: generation, seq, t, units."""
    return classified(ticks, generations).where("reason is null").select(E, "seq", "t", "units")


def rejects(ticks: DataFrame, generations: DataFrame) -> DataFrame:
    """Rejected records per generation and reason: generation, reason, n, first_seq."""
    return classified(ticks, generations).where("reason is not null").groupBy(E, "reason").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


REJECTS = ("missing_value", "unknown_scale", "off_scale", "backwards_time", "conflicting_duplicate")


def audit(ticks: DataFrame, generations: DataFrame) -> DataFrame:
    """Per generation what a stream holds: n_records, n_accepted, n_REASON for each reject, first_micros and last_micros of what was accepted, days with accepted records."""
    ok = F.col("reason").isNull()
    return classified(ticks, generations).groupBy(E).agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(ok).alias("n_accepted"), *[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in REJECTS],
        F.min(F.when(ok, F.col("t"))).alias("first_micros"), F.max(F.when(ok, F.col("t"))).alias("last_micros"), F.count_distinct(F.when(ok, F.floor(F.col("t") / F.lit(86_400 * MICRO)))).alias("n_days"),
    )


def moves(records: DataFrame, checks: Checks = CHECKS) -> DataFrame:
    """Accepted records with what led into each: delta (micros since the record before), before (its units), duplicate, context, bps, run (number of the same-price run)."""
    rows = sharded_neighbours(records.withColumn("_shard", F.floor(F.col("t") / F.lit(SHARD_MICROS))), [E], "_shard", ["t", "seq"], F.struct("t", "units"), 1, 0)
    prev = F.col("`_n-1`")
    delta = F.col("t") - prev["t"]
    context = F.when(delta.isNull(), None).when((delta <= checks.gap_max) if checks.gap_max is not None else F.lit(True), "contiguous")
    if checks.gap_max is not None:
        context = context.when(delta >= checks.gap_reopen, "reopen").otherwise("delayed") if checks.gap_reopen is not None else context.otherwise("delayed")
    rows = rows.select(
        E, "seq", "t", "units", "_shard", delta.alias("delta"), prev["units"].alias("before"), F.coalesce((delta == 0) & (prev["units"] == F.col("units")), F.lit(False)).alias("duplicate"),
        context.alias("context"), relative_move(prev["units"], F.col("units")).alias("bps"), F.abs(bps_change(F.col("units"), prev["units"])).alias("exact_bps"),
    )
    breaks = F.coalesce((F.col("before") != F.col("units")).cast("int"), F.lit(1))
    return running(rows, [E], "_shard", ["t", "seq"], {"_runs": breaks}).withColumn("run", F.col("_runs") + breaks).drop("_runs", "_shard")


def candles(records: DataFrame, duration: int = 60, offset: int = 0, checks: Checks = CHECKS, moved: DataFrame | None = None) -> DataFrame:
    """Finalized candles of `duration` seconds: prices, counts, gaps, jumps, same-price runs and flags.

    A candle is known when the first later record arrives (known_at); the last bucket of a stream, which no record has closed,
    is withheld. Buckets without records give no candle, their number is in missing_buckets_before of the next.
    """
    d = duration * MICRO
    rows = (moved if moved is not None else moves(records, checks)).withColumn("open_micros", interval_open(F.col("t"), d, offset * MICRO))
    # Runs first: one row for each candle and same-price run, then one for each candle.
    runs = rows.groupBy(E, "open_micros", "run").agg(
        F.min(F.struct("t", "seq", "units", "delta")).alias("_first"), F.max(F.struct("t", "seq", "units")).alias("_last"), F.count(F.lit(1)).alias("_n"), (F.max("t") - F.min("t")).alias("_span"),
        F.sum(F.col("duplicate").cast("int")).alias("_dup"), F.max(F.when(F.col("t") - F.col("delta") >= F.col("open_micros"), F.col("delta"))).alias("_inside"),
        *[F.max(F.when(F.col("context") == c, F.col("bps"))).alias(f"_{c}") for c in ("contiguous", "delayed", "reopen")],
        F.max("exact_bps").alias("_x"), *[F.max(F.when(F.col("context") == c, F.col("exact_bps"))).alias(f"_x{c}") for c in ("contiguous", "reopen")],
    )
    c = runs.groupBy(E, "open_micros").agg(
        F.min("_first").alias("_f"), F.max("_last").alias("_l"), F.max("_first.units").alias("high_units"), F.min("_first.units").alias("low_units"), F.sum("_n").alias("observations"), F.sum("_dup").alias("duplicates"),
        F.max("_n").alias("frozen_observations"), F.max("_span").alias("frozen_micros"), F.max("_inside").alias("_inside"), *[F.max(f"_{x}").alias(f"_{x}") for x in ("contiguous", "delayed", "reopen", "x", "xcontiguous", "xreopen")],
    )
    w = Window.partitionBy(E).orderBy("open_micros")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("bigint")
    c = c.withColumn("known_at_micros", F.lead("_f.t").over(w)).withColumn("missing_buckets_before", F.coalesce(((F.col("open_micros") - F.lag("open_micros").over(w)) / d).cast("bigint") - 1, F.lit(0)))
    c = c.withColumn("ordinal", F.row_number().over(w).cast("bigint") - 1).where("known_at_micros is not null")
    c = c.select(
        E, "ordinal", "open_micros", (F.col("open_micros") + d).alias("close_micros"), "known_at_micros", F.col("_f.t").alias("first_event_micros"), F.col("_l.t").alias("last_event_micros"),
        (F.col("_l.t") - F.col("_f.t")).alias("active_span_micros"), F.col("_f.units").alias("open_units"), "high_units", "low_units", F.col("_l.units").alias("close_units"), "observations", "duplicates",
        F.col("_f.delta").alias("gap_before_micros"), zero("_inside").alias("max_gap_inside_micros"), "missing_buckets_before", "frozen_observations", "frozen_micros",
        zero("_contiguous").alias("max_jump_bps"), zero("_delayed").alias("max_delayed_jump_bps"), zero("_reopen").alias("max_reopen_jump_bps"),
        *[F.coalesce(x, F.lit(0.0)).alias(y) for x, y in (("_x", "max_abs_move_bps"), ("_xcontiguous", "max_true_move_bps"), ("_xreopen", "max_reopen_move_bps"))],
    )
    return flagged(c, d, checks)


def flagged(c: DataFrame, duration_micros: int, checks: Checks = CHECKS) -> DataFrame:
    """Candles with the ten flags, complete and clean."""
    off = F.lit(False)
    less = lambda x, n: F.col(x) < n if n is not None else off
    more = lambda x, n: F.coalesce(F.col(x) > n, off) if n is not None else off
    from_ = lambda x, n: F.col(x) >= n if n is not None else off
    flags = {
        "low_activity": less("observations", checks.min_observations), "hard_low_activity": less("observations", checks.hard_min_observations),
        "gap_before": more("gap_before_micros", checks.gap_max), "gap_inside": more("max_gap_inside_micros", checks.gap_max), "missing_before": F.col("missing_buckets_before") > 0,
        "frozen": from_("frozen_observations", checks.frozen_observations) | from_("frozen_micros", checks.frozen_micros),
        "jump": from_("max_jump_bps", checks.jump_bps), "delayed_jump": from_("max_delayed_jump_bps", checks.jump_bps), "reopen_jump": from_("max_reopen_jump_bps", checks.jump_bps),
        "short_span": F.col("active_span_micros") < duration_micros * checks.span_percent // 100 if checks.span_percent is not None else off,
    }
    c = c.withColumns(flags)
    complete = ~(F.col("hard_low_activity") | F.col("gap_before") | F.col("gap_inside") | F.col("missing_before"))
    dirty = F.col("low_activity") | F.col("frozen") | F.col("jump") | F.col("delayed_jump") | F.col("reopen_jump") | F.col("short_span")
    return c.withColumn("complete", complete).withColumn("clean", complete & ~dirty)


FLAGS = ("low_activity", "hard_low_activity", "gap_before", "gap_inside", "missing_before", "frozen", "jump", "delayed_jump", "reopen_jump", "short_span", "complete", "clean")


def withheld(records: DataFrame, duration: int = 60, offset: int = 0) -> DataFrame:
    """Records of each stream's unfinished last bucket: generation, open_micros, n."""
    rows = records.withColumn("open_micros", interval_open(F.col("t"), duration * MICRO, offset * MICRO)).groupBy(E, "open_micros").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy(E).agg(F.max(F.struct("open_micros", "n")).alias("_l")).select(E, "_l.*")


def resampled(bars: DataFrame, duration: int, period: int) -> DataFrame:
    """Bars (generation, open_micros, open, high, low, close units, volume) of `period` seconds folded to candles of `duration`; a bar is known at its own end, and a candle when a bar reaches its close.

    Ties in open_micros are broken by the prices, so repeated bars give one defined result.
    """
    d = duration * MICRO
    at = F.struct("open_micros", "open_units", "close_units", "high_units", "low_units")
    rows = bars.withColumn("bucket", interval_open(F.col("open_micros"), d))
    c = rows.groupBy(E, "bucket").agg(
        F.min_by("open_units", at).alias("open_units"), F.max("high_units").alias("high_units"), F.min("low_units").alias("low_units"), F.max_by("close_units", at).alias("close_units"),
        F.count(F.lit(1)).alias("observations"), F.sum("volume").alias("volume"), (F.max("open_micros") + period * MICRO).alias("_end"),
    )
    later = F.lead(F.col("bucket")).over(Window.partitionBy(E).orderBy("bucket"))
    whole = F.col("_end") >= F.col("bucket") + d
    return c.withColumn("_later", later).where(whole | F.col("_later").isNotNull()).select(E, F.col("bucket").alias("open_micros"), "open_units", "high_units", "low_units", "close_units", "observations", "volume")


# Profiles


def gap_facts(moved: DataFrame) -> DataFrame:
    """Inter-arrival facts: generation, n_gaps, min, max and the median gap."""
    gaps = moved.where("delta is not null")
    return gaps.groupBy(E).agg(F.count(F.lit(1)).alias("n_gaps"), F.min("delta").alias("min_gap"), F.max("delta").alias("max_gap"), F.percentile("delta", F.lit(0.5)).alias("median_gap"))


def log2_histogram(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Counts per log2 bucket: bucket 0 holds zero, bucket k holds [2^(k-1), 2^k). Nulls and negatives don't count."""
    v = F.col(value)
    bucket = F.when(v == 0, 0).otherwise(F.length(F.bin(v)))
    return rows.where(v >= 0).groupBy(*keys, bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _divisors(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Greatest common divisor and count per generation, of each batch or of all batches of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, tuple[int, int]] = {}
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], names=[E, "step_units", "n_moves"])
        for b in batches:
            e = b.column(0).dictionary_encode()
            code = e.indices.fill_null(len(e.dictionary)).to_numpy(zero_copy_only=False)
            names = [*e.dictionary.to_pylist(), None]
            order = np.argsort(code, kind="stable")
            code, step, n = code[order], b.column(1).to_numpy()[order], b.column(2).to_numpy()[order]
            cuts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else ()
            if len(cuts):
                for k, g, m in zip(code[cuts].tolist(), np.gcd.reduceat(step, cuts).tolist(), np.add.reduceat(n, cuts).tolist()):
                    a, c = held.get(names[k], (0, 0))
                    held[names[k]] = (math.gcd(a, g), c + m)
            if not whole:
                yield out()
                held.clear()
        if whole and held:
            yield out()

    return run


def price_facts(moved: DataFrame) -> DataFrame:
    """generation, min_units, max_units, n_moves, step_units: the greatest common divisor of all price moves (null without moves).

    Each batch of rows folds its own to one number a generation before the shuffle, and those are folded as they stream by: no moves are collected.
    """
    steps = moved.where("before is not null and before <> units").select(E, F.abs(F.col("units") - F.col("before")).alias("step_units"), F.lit(1).cast("bigint").alias("n_moves"))
    kinds = f"{E} string, step_units bigint, n_moves bigint"
    folded = steps.mapInArrow(_divisors(False), kinds).repartition(E).mapInArrow(_divisors(True), kinds)
    bounds = moved.groupBy(E).agg(F.min("units").alias("min_units"), F.max("units").alias("max_units"))
    folded = folded.withColumnRenamed(E, "_e")
    return bounds.join(folded, bounds[E].eqNullSafe(folded["_e"]), "left").select(E, "min_units", "max_units", F.coalesce("n_moves", F.lit(0)).alias("n_moves"), "step_units")


def run_facts(moved: DataFrame) -> DataFrame:
    """Same-price runs of whole streams: generation, n_runs, longest (records), longest_micros."""
    runs = moved.groupBy(E, "run").agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("span"))
    return runs.groupBy(E).agg(F.count(F.lit(1)).alias("n_runs"), F.max("n").alias("longest"), F.max("span").alias("longest_micros"))


def flag_counts(c: DataFrame) -> DataFrame:
    return c.groupBy(E).agg(F.count(F.lit(1)).alias("candles"), *[F.count_if(F.col(f)).alias(f) for f in FLAGS])


def profile(moved: DataFrame, c: DataFrame) -> DataFrame:
    """One nested document per generation: prices, gaps, runs, flags."""
    out = price_facts(moved).select(E, F.struct("min_units", "max_units", "n_moves", "step_units").alias("prices"))
    out = out.join(gap_facts(moved).select(E, F.struct("n_gaps", "min_gap", "max_gap", "median_gap").alias("gaps")), E, "left")
    out = out.join(run_facts(moved).select(E, F.struct("n_runs", "longest", "longest_micros").alias("runs")), E, "left")
    return out.join(flag_counts(c).select(E, F.struct("candles", *FLAGS).alias("flags")), E, "left")
