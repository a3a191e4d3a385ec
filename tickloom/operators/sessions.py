"""Trading calendars, and candles on a continuous grid of the calendar's buckets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .asof import asof
from .shards import sharded_neighbours

E = "generation"
MICRO = 1_000_000


@dataclass(frozen=True)
class Weekly:
    """Local opening times by weekday (Monday 0) as seconds of the day, closed dates and early closes (seconds of the day)."""

    zone: str = "America/New_York"
    days: dict[int, tuple[int, int]] = field(default_factory=lambda: {d: (9 * 3600 + 1800, 16 * 3600) for d in range(5)})
    closed: tuple[str, ...] = ()
    early: dict[str, int] = field(default_factory=dict)


def local_time(micros: Column, zone: str) -> Column:
    """Wall-clock timestamp of an instant in `zone`, by its daylight saving rules."""
    return F.from_utc_timestamp(F.timestamp_micros(micros), zone)


def boundary(local: Column, zone: str) -> Column:
    """Micros of a local wall-clock time; null where daylight saving skips the time or has it twice."""
    at = F.to_utc_timestamp(local, zone)
    hour = F.expr("interval 1 hour")
    twice = (F.from_utc_timestamp(at + hour, zone) == local) | (F.from_utc_timestamp(at - hour, zone) == local)
    return F.when((F.from_utc_timestamp(at, zone) == local) & ~twice, F.unix_micros(at))


def daily_window(micros: Column, zone: str, start: str, end: str) -> Column:
    """Is the local clock (HH:MM:SS) at or after `start` and before `end`?"""
    clock = F.date_format(local_time(micros, zone), "HH:mm:ss")
    return (clock >= start) & (clock < end)


def intervals(days: DataFrame, s: Weekly) -> DataFrame:
    """The session of each local day (day: date): day, open_micros, close_micros. Closed dates and weekdays without a session have none; a session whose bound daylight saving skips or doubles has a null there."""
    d = days.select("day").distinct()
    if s.closed:
        d = d.where(~F.date_format("day", "yyyy-MM-dd").isin(*s.closed))
    open_, close = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k, (a, b) in s.days.items():
        open_, close = F.when(F.weekday("day") == k, F.lit(a)).otherwise(open_), F.when(F.weekday("day") == k, F.lit(b)).otherwise(close)
    for day, b in s.early.items():
        close = F.when(F.col("day") == F.lit(day).cast("date"), F.least(close, F.lit(b))).otherwise(close)
    wall = lambda c: F.timestamp_seconds(F.unix_date("day").cast("bigint") * 86_400 + c)
    d = d.withColumns({"_a": open_, "_b": close}).where("_a <= _b")
    return d.select("day", boundary(wall(F.col("_a")), s.zone).alias("open_micros"), boundary(wall(F.col("_b")), s.zone).alias("close_micros"))


def next_buckets(rows: DataFrame, sessions: DataFrame, duration: int, offset: int = 0) -> DataFrame:
    """Adds `bucket` to rows (at, limit: micros): the first grid bucket at or after `at` that opens within a session (both ends count) and closes by `limit`; null if there is none.

    `sessions` as from intervals(), of all days that may count. A session's first bucket of the grid is known beforehand, so a row looks at the session that is
    on or next at its instant, and at the next one after it that has a bucket.
    """
    d = F.lit(duration * MICRO)
    up = lambda c: c + F.pmod(F.lit(offset * MICRO) - c, d)
    w = Window.orderBy("open_micros")  # a row a day
    known = written(sessions.dropna().select("open_micros", "close_micros"), "sessions").withColumn("_first", F.when(up(F.col("open_micros")) <= F.col("close_micros"), up(F.col("open_micros"))))
    known = known.withColumn("_later", F.min("_first").over(w.rowsBetween(1, Window.unboundedFollowing))).withColumn("_k", F.lit(0))
    x = asof(rows.withColumn("_k", F.lit(0)), known, "_k", "at", "close_micros", ["open_micros", "_later"], "_on", forward=True)
    here = up(F.greatest("at", F.col("_on.open_micros")))
    bucket = F.coalesce(F.when(here <= F.col("_on.close_micros"), here), F.col("_on._later"))
    return x.withColumn("bucket", F.when(bucket + d <= F.col("limit"), bucket)).drop("_k", "_on")


def in_session(micros: Column, s: Weekly) -> Column:
    """Is the instant within the session of its local day? Both ends count."""
    at = local_time(micros, s.zone)
    day, second = F.date_format(at, "yyyy-MM-dd"), F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    open_, close = F.lit(None).cast("int"), F.lit(None).cast("int")
    for d, (a, b) in s.days.items():
        here = F.weekday(at) == d
        open_, close = F.when(here, F.lit(a)).otherwise(open_), F.when(here, F.lit(b)).otherwise(close)
    for d, b in s.early.items():
        close = F.when(day == d, F.least(close, F.lit(b))).otherwise(close)
    inside = (second >= open_) & (second <= close)
    if s.closed:
        inside = inside & ~day.isin(*s.closed)
    return F.coalesce(inside, F.lit(False))


def fill_kind(candles: DataFrame) -> Column:
    """`source` for a flat candle without volume, else `none`."""
    flat = (F.col("open_units") == F.col("high_units")) & (F.col("open_units") == F.col("low_units")) & (F.col("open_units") == F.col("close_units"))
    return F.when(flat & (F.col("volume") == 0), "source").otherwise("none")


def continuous(candles: DataFrame, duration: int = 60, session: Weekly | None = None, step: int = 1_440, shard_buckets: int = 1_440) -> DataFrame:
    """Candles (generation, open_micros, close_units, ...) with every missing bucket between a generation's candles: generation, open_micros, open, high, low, close units, observations, fill.

    A missing bucket carries the last close, flat, with no observations and fill `engine`; with a session only its buckets are filled.
    Nothing is filled before the first or after the last candle. Gaps are expanded in steps, so no array grows with a gap.
    """
    d = duration * MICRO
    c = candles.withColumn("_b", F.floor(F.col("open_micros") / F.lit(d))).withColumn("_shard", F.floor(F.col("_b") / F.lit(shard_buckets)))
    c = sharded_neighbours(c, [E], "_shard", ["_b"], F.struct("_b"), 0, 1).withColumn("_missing", F.coalesce(F.col("`_n+1`._b") - F.col("_b") - 1, F.lit(0)))
    own = c.select(E, "open_micros", "open_units", "high_units", "low_units", "close_units", "observations", "fill")
    x = c.where("_missing > 0").withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_missing") - 1) / F.lit(step)))))
    x = x.withColumn("_j", F.explode(F.sequence(F.col("_block") * step + 1, F.least(F.col("_missing"), (F.col("_block") + 1) * step))))
    filled = x.select(E, ((F.col("_b") + F.col("_j")) * F.lit(d)).alias("open_micros"), *[F.col("close_units").alias(f"{k}_units") for k in ("open", "high", "low", "close")], F.lit(0).cast("bigint").alias("observations"), F.lit("engine").alias("fill"))
    if session is not None:
        filled = filled.where(in_session(F.col("open_micros"), session))
    return own.unionByName(filled)


def continuous_known(candles: DataFrame, coverage: DataFrame, duration: int = 60, session: Weekly | None = None) -> DataFrame:
    """The grid of `continuous` with known_at_micros, and behind the last candle further fills up to the end of what is covered.

    candles carry known_at_micros; coverage: generation, start, end (micros) of what is verified, one stretch a generation. A fill within it is known at its own close, any other
    when the next candle is; behind the last candle only buckets that close within the stretch are filled.
    """
    d = duration * MICRO
    w = Window.partitionBy(E).orderBy("open_micros")
    cover = coverage.select(F.col(E).alias("_e"), F.col("start").alias("_from"), F.col("end").alias("_to"))
    last = candles.groupBy(E).agg(F.max_by(F.struct("open_micros", "close_units"), "open_micros").alias("_l")).join(cover, F.col(E).eqNullSafe(F.col("_e")))
    last = last.withColumn("_n", F.floor((F.col("_to") - F.col("_l.open_micros")) / d) - 1).where("_n > 0").withColumn("_j", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))))
    tail = last.select(E, (F.col("_l.open_micros") + F.col("_j") * d).alias("open_micros"), *[F.col("_l.close_units").alias(f"{k}_units") for k in ("open", "high", "low", "close")], F.lit(0).cast("bigint").alias("observations"), F.lit("engine").alias("fill"))
    if session is not None:
        tail = tail.where(in_session(F.col("open_micros"), session))
    grid = continuous(candles, duration, session).unionByName(tail)
    own = candles.select(F.col(E).alias("_e"), F.col("open_micros").alias("_o"), F.col("known_at_micros").alias("_k"))
    x = grid.join(own, F.col(E).eqNullSafe(F.col("_e")) & (F.col("open_micros") == F.col("_o")) & (F.col("fill") != "engine"), "left").drop("_e", "_o")
    x = x.join(cover, F.col(E).eqNullSafe(F.col("_e")), "left")
    x = x.withColumn("_next", F.first("_k", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    within = (F.col("open_micros") >= F.col("_from")) & (F.col("open_micros") + d <= F.col("_to"))
    known = F.when(F.col("fill") != "engine", F.col("_k")).when(F.coalesce(within, F.lit(False)), F.col("open_micros") + d).otherwise(F.col("_next"))
    return x.select(*grid.columns, known.alias("known_at_micros"))


def carried_gaps(candles: DataFrame) -> DataFrame:
    """Real candles (fill `none`) with what the source's flat fills before them hide: generation, open_micros, n_fills, carried_missing (missing buckets of those fills and its own)."""
    w = Window.partitionBy(E).orderBy("open_micros")
    real = F.col("fill") == "none"
    # A real candle closes the stretch of fills before it.
    x = candles.withColumn("_stretch", F.coalesce(F.sum(real.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = x.groupBy(E, "_stretch").agg(F.max(F.when(real, F.col("open_micros"))).alias("open_micros"), F.count_if(~real).alias("n_fills"), F.sum(F.coalesce("missing_buckets_before", F.lit(0))).alias("carried_missing"))
    return out.where("open_micros is not null").drop("_stretch")
