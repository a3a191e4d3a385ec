"""Per-period aggregates that late records correct, as a stream of retractions.

Every record falls into the period of its event time. What has arrived by the period's end makes version 0 of the period's
aggregate; what arrives later, up to the cut-off, makes further versions. Each version is a delta: the old aggregate is
taken back (change -1) and the new one put in its place (change +1). Whoever keeps sums downstream adds `change * n`,
whoever keeps extremes takes the highest version per key.

Records that arrive in the same revision step (a minute) make one version, so that a period has at most
cutoff / step + 1 versions however many records it holds, and all counting is done before any shuffle of versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identifier

PERIOD_MICROS = 300_000_000
CUTOFF_MICROS = 1_800_000_000
STEP_MICROS = 60_000_000

#: Values from this size on have no exact decimal; they are summed apart, as doubles.
EXACT = 1e18

#: Partial aggregate of a group of records: count, known values, the exact sum of those below EXACT, the sum of the others, extremes.
_MERGE = (("n", F.sum), ("n_values", F.sum), ("total", F.sum), ("total_large", F.sum), ("low", F.min), ("high", F.max))


def _revision(arrival: Column, period: Column, length: int, cutoff: int, step: int) -> Column:
    """0 for what arrived in time, 1, 2, ... for the step after the period's end, -1 beyond the cut-off."""
    late = arrival - period - F.lit(length)
    return F.when(late <= 0, F.lit(0)).when(late > cutoff, F.lit(-1)).otherwise(F.ceil(late / step)).cast("int")


def revisions(events: DataFrame, receipts: DataFrame | None = None, *, entity: str = "generation", event_time: str = "event_time_micros", known_at: str = "known_at_micros", value: str = "price", acquisition: str = "acquisition_id", ordinal: str = "page_ordinal", receipt_acquisition: str = "acquisition_id", receipt_ordinal: str = "ordinal", receipt_time: str = "receipt_time_utc", period: int = PERIOD_MICROS, cutoff: int = CUTOFF_MICROS, step: int = STEP_MICROS) -> DataFrame:
    """One row per entity, period and revision: entity, period_start_micros, revision, n, n_values, total, total_large, low, high.

    A record arrives at `known_at`, or where that is null at the earliest receipt of its page (same acquisition, but for case
    and outer blanks, and ordinal). Records without event time or arrival are left out. Records without arrival of their own
    are counted per page before they meet the receipts, so one page with a third of the records is one row of that join.
    A null entity is an entity of its own; a null or non-finite value counts in `n` only. Values are taken to nine digits; total is the exact sum of
    those below EXACT in size, total_large that of the others (null if there are none). Repeats all count.
    """
    length, at = F.lit(period), F.col("_t")
    own = (("n", F.count(F.lit(1))), ("n_values", F.count("_d")), ("total", F.sum(F.when(F.abs("_d") < EXACT, F.col("_v").try_cast("decimal(28,9)")))), ("total_large", F.sum(F.when(F.abs("_d") >= EXACT, F.col("_d")))), ("low", F.min("_d")), ("high", F.max("_d")))
    rows = events.select(
        F.col(entity).alias("_e"), F.unix_micros(event_time).alias("_t"), F.unix_micros(known_at).alias("_k"), F.col(value).cast("double").alias("_v"),
        F.col(acquisition).alias("_a"), F.col(ordinal).alias("_o"),
    ).where("_t is not null").withColumn("_p", at - F.pmod(at, length)).withColumn("_d", F.when(F.abs("_v") < float("inf"), F.round("_v", 9)))
    known = rows.where("_k is not null").withColumn("_r", _revision(F.col("_k"), F.col("_p"), period, cutoff, step)).groupBy("_e", "_p", "_r").agg(*[f.alias(c) for c, f in own])
    if receipts is not None:
        open_ = rows.where("_k is null").withColumn("_a", identifier(F.col("_a"))).where("_a is not null and _o is not null")
        pages = open_.groupBy("_e", "_p", "_a", "_o").agg(*[f.alias(c) for c, f in own])
        first = receipts.select(identifier(F.col(receipt_acquisition)).alias("_a"), F.col(receipt_ordinal).alias("_o"), F.unix_micros(receipt_time).alias("_k")).dropna().groupBy("_a", "_o").agg(F.min("_k").alias("_k"))
        known = known.unionByName(pages.join(first, ["_a", "_o"]).withColumn("_r", _revision(F.col("_k"), F.col("_p"), period, cutoff, step)).select(*known.columns))
    return known.groupBy(F.col("_e").alias(entity), F.col("_p").alias("period_start_micros"), F.col("_r").alias("revision")).agg(*[f(c).alias(c) for c, f in _MERGE])


def changelog(revised: DataFrame, entity: str = "generation", *, period: int = PERIOD_MICROS, step: int = STEP_MICROS) -> DataFrame:
    """The deltas of `revisions`: entity, period_start_micros, version, revised_at_micros, change, n, n_values, total, total_large, low, high.

    Version 0 stands at the period's end, for what had arrived by then (where nothing had, the first version is a late one
    and takes nothing back). Too late records make no version.
    """
    state = Window.partitionBy(entity, "period_start_micros").orderBy("revision").rowsBetween(Window.unboundedPreceding, 0)
    by = Window.partitionBy(entity, "period_start_micros").orderBy("revision")
    now = F.struct(*[f(c).over(state).alias(c) for c, f in _MERGE])
    rows = revised.where("revision >= 0").withColumn("_new", now).withColumn("_old", F.lag("_new").over(by))
    deltas = F.array(F.struct(F.lit(-1).alias("change"), F.col("_old").alias("agg")), F.struct(F.lit(1).alias("change"), F.col("_new").alias("agg")))
    return (
        rows.select(entity, "period_start_micros", F.col("revision").alias("version"), (F.col("period_start_micros") + period + F.col("revision").cast("long") * step).alias("revised_at_micros"), F.explode(deltas).alias("_d"))
        .where("_d.agg is not null")
        .select(entity, "period_start_micros", "version", "revised_at_micros", F.col("_d.change").alias("change"), *[F.col(f"_d.agg.{c}").alias(c) for c, _ in _MERGE])
    )


def consolidate(changes: DataFrame, entity: str = "generation", grain: int | None = None) -> DataFrame:
    """Keyed state after all changes, per period or per coarser `grain` micros: entity, period_start_micros, n, n_values, total, total_large, low, high, versions.

    Counts and exact sums are the signed sums of the deltas, so an old aggregate and its retraction cancel; extremes and total_large, which would
    not cancel to the last digit, come from each period's newest version.
    """
    signed = [F.sum(F.col("change") * F.col(c)).alias(c) for c in ("n", "n_values", "total")]
    newest = F.max(F.when(F.col("change") == 1, F.struct("version", "low", "high", "total_large"))).alias("_x")
    one = changes.groupBy(entity, "period_start_micros").agg(*signed, newest, F.sum((F.col("change") == 1).cast("int")).alias("versions"))
    one = one.select(entity, "period_start_micros", "n", "n_values", "total", F.col("_x.total_large").alias("total_large"), F.col("_x.low").alias("low"), F.col("_x.high").alias("high"), "versions")
    if grain is None:
        return one
    up = F.col("period_start_micros") - F.pmod(F.col("period_start_micros"), F.lit(grain))
    return one.groupBy(entity, up.alias("period_start_micros")).agg(*[f(c).alias(c) for c, f in _MERGE], F.sum("versions").alias("versions"))


def corrected_periods(changes: DataFrame, entity: str = "generation") -> DataFrame:
    """Keys of the periods that a late record changed, before the cut-off."""
    return changes.where("version > 0 and change = 1").select(entity, "period_start_micros").distinct()
