"""Causal features of clean candles: every window ends at the current row.

All finalized candles advance the ordinal, only clean ones become rows. Rolling, statistical and structural state goes on over
all rows of a generation; shape ratios and moving averages begin anew after a row whose ordinal doesn't follow on.

Whatever a bounded or running window can say is a built-in window function over (generation, ordinal). Three recurrences
cannot be said so (moving averages, trend legs, breakouts that fail later); they run in one Arrow pass over sorted rows
which carries a few numbers per generation and holds no group in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.prices import bps_change, gap_class, interval_open, ladder, six
from ..session import written
from .stream import MICRO, E


@dataclass(frozen=True)
class Settings:
    """Window lengths and thresholds of all stages."""

    windows: tuple[int, ...] = (5, 10, 20)
    periods: tuple[int, ...] = (20, 50)
    swing_left: int = 2
    swing_right: int = 2
    epsilon_units: int = 0
    direction_window: int = 10
    min_momentum_bps: float = 2.0
    trend_efficiency: float = 0.35
    range_efficiency: float = 0.30
    compression: float = 0.70
    expanded: float = 1.35
    extreme: float = 2.25
    trend_reset_bars: int = 3
    pullback_min_age: int = 2
    breakout_max_bars: int = 5
    relative_window: int = 20
    relative_min_history: int = 5


SETTINGS = Settings()

#: Added before rounding where exact ties are common, so that they go up whatever the order of summation.
TIE = 1e-9


def by_row() -> WindowSpec:
    return Window.partitionBy(E).orderBy("ordinal")


def last(n: int, before: int = 0) -> WindowSpec:
    return by_row().rowsBetween(-(n - 1) - before, -before)


def tick_path(moved: DataFrame, duration: int = 60, offset: int = 0) -> DataFrame:
    """Within each bucket, what the moves between its ticks say: generation, open_micros and the tick_path_* outputs.

    Only moves between two ticks of the bucket count. Buckets without moves have zero counts and `insufficient_tick_path` labels.
    """
    rows = moved.withColumn("open_micros", interval_open(F.col("t"), duration * MICRO, offset * MICRO))
    inside = F.coalesce(F.col("t") - F.col("delta") >= F.col("open_micros"), F.lit(False))
    move = F.col("units") - F.col("before")
    ends = rows.groupBy(E, "open_micros").agg(
        F.min(F.struct("t", "seq", "units"))["units"].alias("o"), F.max(F.struct("t", "seq", "units"))["units"].alias("c"), F.max("units").alias("h"), F.min("units").alias("l"),
        F.coalesce(F.sum(F.when(inside, F.abs(move))), F.lit(0)).alias("way"), F.count_if(inside & (move > 0)).alias("up"), F.count_if(inside & (move < 0)).alias("down"), F.count_if(inside & (move == 0)).alias("flat"),
    )
    w = Window.partitionBy(E, "open_micros").orderBy("t", "seq")
    turns = rows.where(inside & (move != 0)).withColumn("_s", F.signum(move)).withColumn("_turn", (F.lag("_s").over(w) != F.col("_s")).cast("int"))
    turns = turns.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(E, "open_micros"))).withColumn("_late", F.row_number().over(Window.partitionBy(E, "open_micros").orderBy(F.desc("t"), F.desc("seq"))))
    turns = turns.groupBy(E, "open_micros").agg(F.sum("_turn").alias("turns"), F.avg(F.when(F.col("_late") <= F.ceil(F.col("_n") / 3), F.col("_s"))).alias("terminal"))
    x = ends.join(turns, [E, "open_micros"], "left").withColumn("turns", F.coalesce("turns", F.lit(0)))
    n = F.col("up") + F.col("down")
    ready = n >= 3
    imb = F.when(n > 0, (F.col("up") - F.col("down")) / n).otherwise(0.0)
    rev = F.when(n > 0, F.col("turns") / F.greatest(n - 1, F.lit(1))).otherwise(0.0)
    eff = F.when(F.col("way") > 0, F.abs(F.col("c") - F.col("o")) / F.col("way")).otherwise(0.0)
    pos = F.when(F.col("h") > F.col("l"), F.least(F.greatest((F.col("c") - F.col("l")) / (F.col("h") - F.col("l")), F.lit(0.0)), F.lit(1.0))).otherwise(0.5)
    terminal = F.coalesce("terminal", F.lit(0.0))
    x = x.select(
        E, "open_micros", ready.alias("tick_path_ready"), n.alias("tick_path_directional_move_count"), F.col("up").alias("tick_path_uptick_count"), F.col("down").alias("tick_path_downtick_count"),
        F.col("flat").alias("tick_path_flat_count"), F.col("turns").alias("tick_path_direction_change_count"), imb.alias("_imb"), rev.alias("_rev"), eff.alias("_eff"), F.ceil(n / 3).cast("bigint").alias("tick_path_terminal_move_count"), terminal.alias("_ter"), pos.alias("_pos"),
    )
    imb, rev, eff, ter, pos, ready = (F.col(c) for c in ("_imb", "_rev", "_eff", "_ter", "_pos", "tick_path_ready"))
    label = lambda c: F.when(~ready, "insufficient_tick_path").otherwise(c)
    three = lambda v, at: F.when(v >= at, "pressure_up").when(v <= -at, "pressure_down").otherwise("neutral")
    pressure = three(imb, 0.25)
    failed = F.when((pressure == "pressure_up") & (pos <= 0.45), "failed_up").when((pressure == "pressure_down") & (pos >= 0.55), "failed_down").otherwise("none")
    clean = (((pressure == "pressure_up") & (pos >= 0.60)) | ((pressure == "pressure_down") & (pos <= 0.40))) & (eff >= 0.35) & (rev <= 0.45)
    shape = F.when(clean, "clean_push").when(failed != "none", "failed_push").when((rev >= 0.60) | (eff <= 0.25), "churn").otherwise("mixed")
    return x.withColumns({
        "tick_path_signed_imbalance": six(imb), "tick_path_reversal_rate": six(rev), "tick_path_efficiency": six(eff), "tick_path_terminal_signed_imbalance": six(ter), "tick_path_close_position": six(pos),
        "tick_path_pressure_bucket": label(pressure), "tick_path_shape_bucket": label(shape), "tick_path_terminal_pressure_bucket": label(three(ter, 0.34)), "tick_path_failed_pressure_direction": label(failed),
        "tick_path_efficiency_bucket": label(F.when(eff >= 0.65, "high").when(eff >= 0.35, "medium").otherwise("low")), "tick_path_reversal_bucket": label(F.when(rev >= 0.60, "high").when(rev <= 0.45, "low").otherwise("medium")),
    }).drop("_imb", "_rev", "_eff", "_ter", "_pos")


def candle_columns(c: DataFrame) -> DataFrame:
    """Clean candles with the outputs that say how they came about (gaps, runs, jumps) and their anatomy."""
    o, h, l, close = (F.col(f"{x}_units") for x in ("open", "high", "low", "close"))
    body, rng, upper, lower = F.abs(close - o), h - l, h - F.greatest(o, close), F.least(o, close) - l
    ratio = lambda a, flat: six(F.when(rng > 0, a / rng).otherwise(flat))
    size = lambda a: six(a / F.abs(F.when(o != 0, o)) * 10_000)
    gap = F.greatest(F.lit(0), F.coalesce("gap_before_micros", F.lit(0)), F.col("max_gap_inside_micros"))
    return c.where("clean").withColumns({
        "tick_volume": F.col("observations"), "low_tick_volume": F.col("low_activity"), "hard_low_tick_volume": F.col("hard_low_activity"), "has_gap": F.col("gap_before") | F.col("gap_inside") | F.col("missing_before"),
        "has_internal_gap": F.col("gap_inside"), "starts_after_gap": F.col("gap_before"), "starts_after_gap_micros": F.col("gap_before_micros"), "starts_after_gap_class": gap_class(F.col("gap_before_micros")),
        "missing_buckets_since_prev_candle": F.col("missing_buckets_before"), "max_internal_gap_micros": F.col("max_gap_inside_micros"), "max_gap_micros": gap, "worst_gap_class": gap_class(F.greatest(gap, F.lit(1))),
        "frozen_price_flag": F.col("frozen"), "max_same_price_run_ticks": F.col("frozen_observations"), "max_same_price_run_micros": F.col("frozen_micros"), "has_true_tick_jump": F.col("jump"),
        "has_feed_delay_jump": F.col("delayed_jump"), "has_gap_reopen_jump": F.col("reopen_jump"), "max_abs_tick_jump_bps": six(F.col("max_abs_move_bps")),
        "max_true_tick_jump_bps": six(F.col("max_true_move_bps")), "max_gap_reopen_jump_bps": six(F.col("max_reopen_move_bps")), "quality_tier": F.lit("clean_v1"),
        "candle_direction": F.when(close > o, "up").when(close < o, "down").otherwise("flat"), "body_units": body, "range_units": rng, "upper_wick_units": upper, "lower_wick_units": lower,
        "body_bps": size(body), "range_bps": size(rng), "upper_wick_bps": size(upper), "lower_wick_bps": size(lower), "close_position": ratio(close - l, 0.5), "body_to_range": ratio(body, 0.0),
        "upper_wick_to_range": ratio(upper, 0.0), "lower_wick_to_range": ratio(lower, 0.0),
    })


def calendar(c: DataFrame) -> DataFrame:
    """Weekday, hour and six-hour session of the close in UTC."""
    at = F.timestamp_micros("close_micros")
    six_h = (F.floor(F.hour(at) / 6) * 6).cast("int")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return c.withColumns({"utc_day_of_week": F.date_format(at, "EEEE"), "utc_hour": F.hour(at), "utc_session_6h": F.concat(two(six_h), F.lit("-"), two(six_h + 6))})


def adjacency(c: DataFrame) -> DataFrame:
    """Segments of consecutive ordinals, and what compares a candle with the one just before it."""
    w = by_row()
    prev = lambda x: F.lag(x).over(w)
    adjacent = F.coalesce(F.col("ordinal") == prev("ordinal") + 1, F.lit(False))
    c = c.withColumn("has_adjacent_previous_clean_candle", adjacent).withColumn("clean_segment_index", F.sum((~adjacent).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    c = c.withColumns({f"_p{x}": prev(f"{x}_units") for x in ("open", "high", "low", "close")} | {"_pbody": prev("body_to_range")})
    o, h, l, close, po, ph, pl, pc = (F.col(x) for x in ("open_units", "high_units", "low_units", "close_units", "_popen", "_phigh", "_plow", "_pclose"))
    adj = F.col("has_adjacent_previous_clean_candle")
    overlap = F.when(adj & (h > l), six(F.greatest(F.lit(0), F.least(h, ph) - F.greatest(l, pl)) / (h - l)))
    still = (F.col("body_to_range") <= 0.10) | (F.col("_pbody") <= 0.10)
    turned_up, turned_down = (pc < po) & (close > o), (pc > po) & (close < o)
    around = lambda low, high: (low <= F.least(po, pc)) & (high >= F.greatest(po, pc))
    within = lambda low, high: (low >= F.least(po, pc)) & (high <= F.greatest(po, pc))
    pattern = F.when(still, "none")
    for turn, name, low, high in ((turned_up, "bullish", o, close), (turned_down, "bearish", close, o)):
        pattern = pattern.when(turn & around(low, high), f"{name}_engulfing").when(turn & within(low, high), f"{name}_harami")
    pattern = F.when(adj, pattern.otherwise("none"))
    relation = (
        F.when(~adj & ph.isNull(), "first_clean_candle").when(~adj, "no_adjacent_previous_clean_candle").when((h < ph) & (l > pl), "inside_previous").when((h > ph) & (l < pl), "outside_previous")
        .when((h > ph) & (l >= pl), "higher_range").when((h <= ph) & (l < pl), "lower_range").otherwise("overlap_previous")
    )
    c = c.withColumns({"range_overlap": overlap, "candle_pattern": pattern, "previous_candle_relation": relation, "is_inside_bar": adj & (h < ph) & (l > pl), "is_outside_bar": adj & (h > ph) & (l < pl)})
    seg = Window.partitionBy(E, "clean_segment_index").orderBy("ordinal")
    return c.drop("_popen", "_phigh", "_plow", "_pclose", "_pbody").withColumn("clean_segment_candle_index", F.row_number().over(seg).cast("bigint") - 1)


def rolling(c: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Returns, momentum, efficiency, means and the states that follow from them."""
    w = by_row()
    close = F.col("close_units")
    c = c.withColumn("_r", bps_change(close, F.lag(close).over(w)))
    c = c.withColumn("return_1_bps", six(F.col("_r")))
    full = lambda x, n: F.count(x).over(last(n)) == n
    out: dict[str, Column] = {}
    for n in s.windows:
        back = F.lag(close, n).over(w)
        out[f"momentum_{n}_bps"] = six(bps_change(close, back))
        way = F.sum(F.abs("_r")).over(last(n))
        out[f"directional_efficiency_{n}"] = F.when(full("_r", n), six(F.when(way > 0, F.least(F.abs(bps_change(close, back)) / way, F.lit(1.0)))))
        out[f"abs_return_mean_{n}_bps"] = F.when(full("_r", n), six(F.avg(F.abs("_r")).over(last(n))))
        out[f"range_mean_{n}_bps"] = F.when(full("range_bps", n), six(F.avg("range_bps").over(last(n)) + TIE))
        out[f"tick_volume_mean_{n}"] = F.when(full("tick_volume", n), six(F.avg("tick_volume").over(last(n))))
    c = c.withColumns(out)
    ratio = F.when(F.col("range_mean_20_bps") > 0, six(F.col("range_mean_5_bps") / F.col("range_mean_20_bps")))
    c = c.withColumn("range_to_avg20", ratio)
    r, m, e = F.col("range_to_avg20"), F.col(f"momentum_{s.direction_window}_bps"), F.col(f"directional_efficiency_{s.direction_window}")
    c = c.withColumn("compression_state", F.when(r.isNull(), "unknown").when(r < s.compression, "compressed").when(r >= s.extreme, "extreme").when(r >= s.expanded, "expanded").otherwise("normal"))
    c = c.withColumn("directional_state", F.when(m.isNull() | e.isNull(), "unknown").when((F.abs(m) < s.min_momentum_bps) | (e < s.trend_efficiency), "sideways").when(m > 0, "up").otherwise("down"))
    return c.withColumn("range_like", F.coalesce(e <= s.range_efficiency, F.lit(False)) & F.col("compression_state").isin("compressed", "normal"))


def statistics(c: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Population moments, autocorrelation, reversals and a linear trend over the last rows; needs rolling()."""
    w = by_row()
    r, close = F.col("_r"), F.col("close_units").cast("double")
    c = c.withColumn("_q", F.lag("_r").over(w)).withColumn("_x", F.row_number().over(w).cast("double"))
    c = c.withColumn("_both", F.when((r != 0) & (F.col("_q") != 0), (F.signum(r) != F.signum("_q")).cast("double")))
    out: dict[str, Column] = {}
    for n in s.windows:
        f = last(n)
        have = F.count("_r").over(f) == n
        spread = F.stddev_pop("_r").over(f)
        out[f"return_std_{n}_bps"] = F.when(have, six(spread))
        out[f"return_skew_{n}"] = F.when(have & (spread > 1e-9), F.round(F.skewness("_r").over(f), 4))
        out[f"return_kurtosis_{n}"] = F.when(have & (spread > 1e-9), F.round(F.kurtosis("_r").over(f), 4))
        pairs = last(n - 1)
        x, y = F.when(F.col("_q").isNotNull(), F.col("_r")), F.when(F.col("_r").isNotNull(), F.col("_q"))
        spreads = F.stddev_pop(x).over(pairs) * F.stddev_pop(y).over(pairs)
        out[f"return_autocorr_{n}"] = F.when(have, F.round(F.covar_pop(x, y).over(pairs) / F.when(spreads > 1e-12, spreads), 4))
        out[f"sign_reversal_rate_{n}"] = F.when(have, six(F.avg("_both").over(pairs)))
        way = F.sum(F.abs("_r")).over(f)
        out[f"up_move_ratio_{n}"] = F.when(have & (way > 0), six(F.sum(F.greatest(r, F.lit(0.0))).over(f) / way))
        rows = F.count("_x").over(f) == n
        still = F.max("close_units").over(f) == F.min("close_units").over(f)
        slope, icept = F.regr_slope(close, F.col("_x")).over(f), F.regr_intercept(close, F.col("_x")).over(f)
        out[f"trend_r2_{n}"] = F.when(rows & ~still, F.round(F.regr_r2(close, F.col("_x")).over(f) + TIE, 4))
        out[f"trend_residual_{n}_bps"] = F.when(rows & (close != 0), F.round((close - (icept + slope * F.col("_x"))) / close * 10_000, 4))
        top, low = F.max("high_units").over(f), F.min("low_units").over(f)
        out[f"range_position_{n}"] = F.when(rows & (top > low), six((F.col("close_units") - low) / (top - low)))
    return c.withColumns(out).drop("_q", "_x", "_both")


def shape(c: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Candle types and buckets, and sizes against the candles before within the segment; needs adjacency()."""
    body, upper, lower, pos = (F.col(x) for x in ("body_to_range", "upper_wick_to_range", "lower_wick_to_range", "close_position"))
    d = F.col("candle_direction")
    doji = body <= 0.10
    hammer = (lower >= 0.55) & (upper <= 0.25) & (body <= 0.35) & (pos >= 0.55)
    star = (upper >= 0.55) & (lower <= 0.25) & (body <= 0.35) & (pos <= 0.45)
    pin = hammer | star | ((body <= 0.35) & ((upper >= 0.60) | (lower >= 0.60)) & (F.abs(upper - lower) >= 0.30))
    strong = (body >= 0.65) & (((d == "up") & (pos >= 0.70)) | ((d == "down") & (pos <= 0.30)))
    spinning = (body <= 0.25) & (upper >= 0.20) & (lower >= 0.20)
    colour = F.when(d == "up", "bullish").when(d == "down", "bearish").otherwise("neutral")
    kind = F.when(hammer, "hammer_like").when(star, "shooting_star_like").when(pin, "pin_bar").when(strong, "strong").when(spinning, "spinning_top").when(pos >= 0.75, "high_close").when(pos <= 0.25, "low_close").otherwise("normal")
    kind = F.when(doji, F.when((upper >= 0.25) & (lower >= 0.25), "long_legged_doji").otherwise("doji")).otherwise(F.concat_ws("_", kind, colour))
    wick = lambda x: ladder(x, (0.03, 0.12, 0.25, 0.45, 0.65), ("none", "tiny", "small", "normal", "large", "extreme"))
    size = lambda x: ladder(x, (0, 1, 3, 8, 18), ("flat", "tiny", "small", "normal", "large", "extreme"))
    rel = lambda x: ladder(x, (0.35, 0.70, 1.35, 2.25), ("tiny", "small", "normal", "large", "extreme"), "unknown_warmup")
    profile = (
        F.when((upper >= 0.45) & (lower >= 0.45), "long_wicks_both").when((upper >= 0.50) & (upper >= 1.75 * lower), "upper_rejection").when((lower >= 0.50) & (lower >= 1.75 * upper), "lower_rejection")
        .when((upper <= 0.10) & (lower <= 0.10) & (body >= 0.75), "clean_body").when((upper >= 0.25) | (lower >= 0.25), "wicked").otherwise("balanced_wicks")
    )
    location = F.when(pos >= 0.85, "close_near_high").when(pos >= 0.65, "upper_mid_close").when(pos >= 0.35, "middle_close").when(pos >= 0.15, "lower_mid_close").otherwise("close_near_low")
    seg = Window.partitionBy(E, "clean_segment_index").orderBy("ordinal").rowsBetween(-s.relative_window, -1)
    enough = F.count(F.lit(1)).over(seg) >= s.relative_min_history
    out = {"prior_clean_history_count": F.least(F.col("clean_segment_candle_index"), F.lit(s.relative_window))}
    for name, col in (("range", "range_bps"), ("body", "body_bps"), ("tick_volume", "tick_volume")):
        mean = F.avg(col).over(seg)
        out[f"{name}_vs_recent_ratio"] = F.when(enough & (mean > 0), six(F.col(col) / mean))
    c = c.withColumns(out)
    ratio = F.col("range_vs_recent_ratio")
    return c.withColumns({
        "candle_color": colour, "candle_type": kind, "range_bps_bucket": size(F.col("range_bps")), "body_bps_bucket": size(F.col("body_bps")), "range_vs_recent_bucket": rel(ratio), "body_vs_recent_bucket": rel(F.col("body_vs_recent_ratio")),
        "tick_volume_vs_recent_bucket": rel(F.col("tick_volume_vs_recent_ratio")), "upper_wick_size_bucket": wick(upper), "lower_wick_size_bucket": wick(lower), "wick_profile": profile, "close_location_bucket": location,
        "body_dominance": ladder(body, (0.10, 0.25, 0.55, 0.80), ("doji_body", "small_body", "balanced_body", "body_dominant", "marubozu_like")), "is_doji": doji, "is_strong_body": strong, "is_pin_bar": pin,
        "is_hammer_like": hammer, "is_shooting_star_like": star, "is_expansion_candle": F.coalesce((ratio >= 1.5) & (body >= 0.40), F.lit(False)), "is_compression_candle": F.coalesce(ratio <= 0.70, F.lit(False)),
    })


def swings(c: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Confirmed swings, the last known ones, sweeps and breakouts.

    A row is a swing high if its high is above those of `swing_left` rows before and `swing_right` rows after it; it is known at
    the last of these, before that row is held against it.
    """
    w = by_row()
    left, right = s.swing_left, s.swing_right
    before, after = w.rowsBetween(-(left + right), -(right + 1)), w.rowsBetween(-(right - 1), 0)
    enough = F.row_number().over(w) > left + right
    high, low = F.lag("high_units", right).over(w), F.lag("low_units", right).over(w)
    c = c.withColumn("_row", F.row_number().over(w).cast("bigint") - 1)
    top = enough & (high > F.max("high_units").over(before)) & (high > F.max("high_units").over(after))
    bottom = enough & (low < F.min("low_units").over(before)) & (low < F.min("low_units").over(after))
    c = c.withColumns({"newly_confirmed_swing_high": F.coalesce(top, F.lit(False)), "newly_confirmed_swing_low": F.coalesce(bottom, F.lit(False)), "_hl": high, "_ll": low, "_ec": F.lag("close_micros", right).over(w), "_eo": F.lag("ordinal", right).over(w), "_pc": F.lag("close_units").over(w)})
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    for side, level in (("high", "_hl"), ("low", "_ll")):
        known = F.last(F.when(F.col(f"newly_confirmed_swing_{side}"), F.struct(F.col(level).alias("units"), F.col("_ec").alias("event"), F.col("close_micros").alias("confirm"), F.col("_row").alias("row"))), ignorenulls=True).over(run)
        c = c.withColumn("_k", known)
        c = c.withColumns({
            f"last_swing_{side}_units": F.col("_k.units"), f"last_swing_{side}_event_close_micros": F.col("_k.event"), f"last_swing_{side}_confirm_close_micros": F.col("_k.confirm"),
            f"bars_since_last_swing_{side}_known": F.col("_row") - F.col("_k.row"), f"distance_to_last_swing_{side}_bps": six(bps_change(F.col("close_units"), F.col("_k.units"))),
        }).drop("_k")
    close, pc = F.col("close_units"), F.col("_pc")
    up, dn = F.col("last_swing_high_units"), F.col("last_swing_low_units")
    no = lambda x: F.coalesce(x, F.lit(False))
    return c.withColumns({
        "sweep_reject_high": no((F.col("high_units") > up) & (close < up)), "breakout_up": no((close > up) & (pc.isNull() | (pc <= up))),
        "sweep_reject_low": no((F.col("low_units") < dn) & (close > dn)), "breakout_down": no((close < dn) & (pc.isNull() | (pc >= dn))),
    })


def sequence(c: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Types of swings against the one before on their side, and the market structure they spell; needs swings()."""
    w = by_row()
    run, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    for side, level, names in (("high", "_hl", ("first_high", "HH", "LH", "EH")), ("low", "_ll", ("first_low", "HL", "LL", "EL"))):
        new = F.col(f"newly_confirmed_swing_{side}")
        point = F.struct(F.col(level).alias("units"), F.col("_ec").alias("event"), F.col("close_micros").alias("confirm"))
        c = c.withColumn(f"_before_{side}", F.last(F.when(new, point), ignorenulls=True).over(earlier))
        prev = F.col(f"_before_{side}.units")
        kind = F.when(new, F.when(prev.isNull(), names[0]).when(F.col(level) - prev > s.epsilon_units, names[1]).when(prev - F.col(level) > s.epsilon_units, names[2]).otherwise(names[3]))
        c = c.withColumn(f"swing_{side}_type", kind).withColumn(f"last_swing_{side}_type", F.last(f"swing_{side}_type", ignorenulls=True).over(run))
    for t, side, level in (("HH", "high", "_hl"), ("HL", "low", "_ll"), ("LH", "high", "_hl"), ("LL", "low", "_ll")):
        c = c.withColumn(f"newly_confirmed_{t}", F.coalesce(F.col(f"swing_{side}_type") == t, F.lit(False)))
        known = F.last(F.when(F.col(f"newly_confirmed_{t}"), F.struct(F.col(level).alias("units"), F.col("_ec").alias("event"), F.col("close_micros").alias("confirm"), F.col("_row").alias("row"))), ignorenulls=True).over(run)
        c = c.withColumn("_k", known).withColumns({
            f"last_confirmed_{t}_units": F.col("_k.units"), f"last_confirmed_{t}_event_close_micros": F.col("_k.event"), f"last_confirmed_{t}_confirm_close_micros": F.col("_k.confirm"), f"bars_since_last_confirmed_{t}_known": F.col("_row") - F.col("_k.row"),
        }).drop("_k")
    h, l = F.col("last_swing_high_type"), F.col("last_swing_low_type")
    word = (
        F.when(h.isNull() | l.isNull(), "unknown,unknown").when(h.startswith("first") | l.startswith("first"), "warming_up,unknown").when((h == "HH") & (l == "HL"), "bullish_hh_hl,bullish").when((h == "LH") & (l == "LL"), "bearish_lh_ll,bearish")
        .when((h == "HH") & (l == "LL"), "expanding_hh_ll,volatile_expansion").when((h == "LH") & (l == "HL"), "contracting_lh_hl,compression").when((h == "EH") | (l == "EL"), "equal_level_mixed,mixed").otherwise("mixed,mixed")
    )
    return c.withColumn("market_structure_sequence", F.split_part(word, F.lit(","), F.lit(1))).withColumn("market_structure_bias", F.split_part(word, F.lit(","), F.lit(2)))


# What a window cannot say


def _carried(s: Settings):
    periods = s.periods

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: object = frames  # no generation yet
        seg = leg = side = None
        age = still = 0
        ema: list[float] = []
        n = 0
        active: tuple[str, float, int, int] | None = None
        trend = "none"
        for df in frames:
            k = len(df)
            out = {c: np.empty(k, object) for c in ("trend_leg_direction", "pullback_against_trend", "failed_breakout_up", "failed_breakout_down", "break_of_structure", "change_of_character", "_failed_units", "_failed_close")}
            ages, values = np.empty(k, np.int64), np.full((k, len(periods)), np.nan)
            steps = np.full((k, len(periods)), np.nan)
            for i, x in enumerate(df.itertuples(index=False)):
                who = None if pd.isna(x.generation) else x.generation
                if who != at or at is frames:
                    at, seg, leg, age, still, active, trend = who, None, "none", 0, 0, None, "none"
                if x.segment != seg:
                    seg, n, ema = x.segment, 0, [float(x.close)] * len(periods)
                    before = [np.nan] * len(periods)
                else:
                    before = ema
                    ema = [2.0 / (p + 1) * x.close + (1.0 - 2.0 / (p + 1)) * a for a, p in zip(ema, periods)]
                n += 1
                for j, p in enumerate(periods):
                    values[i, j] = ema[j]
                    steps[i, j] = (ema[j] - before[j]) / before[j] * 1e4 if n > 1 and before[j] else np.nan
                out["pullback_against_trend"][i] = leg in ("up", "down") and age >= s.pullback_min_age and x.direction in ("up", "down") and x.direction != leg
                if x.state in ("up", "down"):
                    age = age + 1 if x.state == leg else 1
                    leg, still = x.state, 0
                else:
                    still += 1
                    if still >= s.trend_reset_bars:
                        leg, age = "none", 0
                out["trend_leg_direction"][i], ages[i] = leg, age
                fu = fd = bos = coc = False
                if active is not None:
                    d, level, start, began = active
                    if x.row - start > s.breakout_max_bars:
                        active = None
                    elif x.row > start and (x.close < level if d == "up" else x.close > level):
                        fu, fd, active = d == "up", d == "down", None
                        out["_failed_units"][i], out["_failed_close"][i] = int(level), began
                for d, broke, level in (("up", x.up, x.high), ("down", x.down, x.low)):
                    if broke:
                        bos, coc = bos or trend in ("none", d), coc or trend not in ("none", d)
                        active, trend = (d, level, x.row, x.closed), d
                out["failed_breakout_up"][i], out["failed_breakout_down"][i], out["break_of_structure"][i], out["change_of_character"][i] = fu, fd, bos, coc
            frame = pd.DataFrame({"generation": df["generation"], "ordinal": df["ordinal"], **out, "trend_leg_age_candles": ages, "_in_segment": df["in_segment"]})
            for j, p in enumerate(periods):
                frame[f"ema{p}"], frame[f"_step{p}"] = values[:, j], steps[:, j]
            yield frame

    return run


def carried(c: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Moving averages, trend legs and what becomes of breakouts, joined to the rows; needs rolling(), adjacency() and swings().

    The rows are written once, for they are read for the recurrences and again for the join.
    """
    c = written(c, "windowed")
    cols = c.select(
        E, "ordinal", F.col("clean_segment_index").alias("segment"), F.col("clean_segment_candle_index").alias("in_segment"), F.col("close_units").cast("double").alias("close"), F.col("candle_direction").alias("direction"), F.col("directional_state").alias("state"),
        F.col("breakout_up").alias("up"), F.col("breakout_down").alias("down"), F.col("last_swing_high_units").cast("double").alias("high"), F.col("last_swing_low_units").cast("double").alias("low"), F.col("_row").alias("row"), F.col("close_micros").alias("closed"),
    )
    kinds = f"{E} string, ordinal bigint, trend_leg_direction string, pullback_against_trend boolean, failed_breakout_up boolean, failed_breakout_down boolean, break_of_structure boolean, change_of_character boolean, _failed_units bigint, _failed_close bigint, trend_leg_age_candles bigint, _in_segment bigint"
    kinds += "".join(f", ema{p} double, _step{p} double" for p in s.periods)
    state = cols.repartition(E).sortWithinPartitions(E, "ordinal").mapInPandas(_carried(s), kinds)
    five = lambda v, ready, name: F.when(~ready | v.isNull(), "not_ready").when(v >= 5, f"{name}strong_up").when(v >= 1, f"{name}mild_up").when(v <= -5, f"{name}strong_down").when(v <= -1, f"{name}mild_down").otherwise(f"{name}flat")
    x = c.join(state.withColumnRenamed(E, "_e").withColumnRenamed("ordinal", "_o"), F.col(E).eqNullSafe(F.col("_e")) & (F.col("ordinal") == F.col("_o"))).drop("_e", "_o")
    close = F.col("close_units")
    for p in s.periods:
        ready, e, step = F.col("_in_segment") + 1 >= p, F.col(f"ema{p}"), F.when(~F.isnan(f"_step{p}"), F.col(f"_step{p}"))
        away = (close - e) / F.when(e != 0, e) * 10_000
        x = x.withColumns({f"_a{p}": away, f"_e{p}": e, f"_s{p}": step, f"is_ema{p}_ready": ready})
        ready = F.col(f"is_ema{p}_ready")
        x = x.withColumns({
            f"ema{p}": six(F.col(f"_e{p}")), f"close_vs_ema{p}_bps": six(F.col(f"_a{p}")), f"is_close_above_ema{p}": close >= F.col(f"_e{p}"), f"ema{p}_slope_bps": six(F.col(f"_s{p}")),
            f"ema{p}_slope_state": five(F.col(f"_s{p}"), ready, "ema_slope_"), f"close_vs_ema{p}_state": five(F.col(f"_a{p}"), ready, "close_vs_ema_"),
        })
    if {20, 50} <= set(s.periods):
        apart = (F.col("_e20") - F.col("_e50")) / F.when(F.col("_e50") != 0, F.col("_e50")) * 10_000
        x = x.withColumns({"ema20_minus_ema50_bps": six(apart), "is_ema20_above_ema50": F.col("_e20") >= F.col("_e50"), "ema20_ema50_alignment_state": five(apart, F.col("is_ema20_ready") & F.col("is_ema50_ready"), "ema20_vs_ema50_")})
    return x.drop("_in_segment", *[f"{k}{p}" for p in s.periods for k in ("_a", "_e", "_s", "_step")])


def structure(x: DataFrame) -> DataFrame:
    """The structure state of a row and its events in their fixed order; needs carried()."""
    c = F.col
    state = (
        F.when(c("failed_breakout_up") | c("failed_breakout_down"), "failed_breakout").when(c("sweep_reject_high") | c("sweep_reject_low"), "sweep_reject").when(c("breakout_up") | c("breakout_down"), "breakout")
        .when(F.coalesce("range_like", F.lit(False)), "range").when(c("compression_state") == "compressed", "compression").when(c("directional_state") == "up", "trend_up").when(c("directional_state") == "down", "trend_down").otherwise("neutral")
    )
    kind = F.when(c("break_of_structure"), "break_of_structure").otherwise("change_of_character")
    events = F.array(
        F.when(c("newly_confirmed_swing_high"), "swing_high:up"), F.when(c("newly_confirmed_swing_low"), "swing_low:down"), F.when(c("failed_breakout_up"), "failed_breakout:up"), F.when(c("failed_breakout_down"), "failed_breakout:down"),
        F.when(c("sweep_reject_high"), "sweep_reject_high:down"), F.when(c("breakout_up"), "breakout:up"), F.when(c("breakout_up"), F.concat(kind, F.lit(":up"))),
        F.when(c("sweep_reject_low"), "sweep_reject_low:up"), F.when(c("breakout_down"), "breakout:down"), F.when(c("breakout_down"), F.concat(kind, F.lit(":down"))),
    )
    x = x.withColumn("structure_state", state).withColumn("current_event_types", F.array_join(events, "|"))
    return x.withColumn("current_event_close_micros", F.when(c("current_event_types") != "", c("close_micros")))


#: Columns of the event tables after generation.
STRUCTURE_EVENT = ("event_id", "event_type", "event_direction", "event_close_micros", "confirm_close_micros", "known_at_micros", "event_row", "confirm_row", "event_candle_ordinal", "confirm_candle_ordinal", "price_units", "level_units", "reference", "reference_close_micros")
SEQUENCE_EVENT = ("event_id", "row", "candle_ordinal", "decision_close_micros", "known_at_micros", "swing_event_type", "swing_type", "swing_price_units", "swing_event_close_micros", "swing_confirm_close_micros", "previous_price_units", "previous_event_close_micros", "previous_confirm_close_micros", "sequence_after", "bias_after")


def structure_events(x: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """One row per structure event, numbered from 1 in a generation: generation and STRUCTURE_EVENT.

    A swing lies at its own candle and is confirmed `swing_right` rows later; all other events are confirmed where they happen. level and
    reference say what the event is held against: a swing, or the breakout that failed.
    """
    c = F.col
    none = F.lit(None).cast("bigint")

    def event(kind: Column | str, direction: str, price: Column, level: Column, reference: str, since: Column, swing: bool = False) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        own = (c("_ec"), c("_row") - s.swing_right, c("_eo")) if swing else (c("close_micros"), c("_row"), c("ordinal"))
        return F.struct(
            kind.alias("event_type"), F.lit(direction).alias("event_direction"), own[0].alias("event_close_micros"), c("close_micros").alias("confirm_close_micros"), "known_at_micros", own[1].alias("event_row"), c("_row").alias("confirm_row"),
            own[2].alias("event_candle_ordinal"), c("ordinal").alias("confirm_candle_ordinal"), price.alias("price_units"), level.alias("level_units"), F.lit(reference).alias("reference"), since.alias("reference_close_micros"),
        )

    turn = F.when(c("break_of_structure"), "break_of_structure").otherwise("change_of_character")
    close = c("close_units")
    events = [F.when(c(f"newly_confirmed_swing_{side}"), event(f"swing_{side}", d, c(level), c(level), "strict_left_right", none, True)) for side, d, level in (("high", "up", "_hl"), ("low", "down", "_ll"))]
    events += [F.when(c(f"failed_breakout_{d}"), event("failed_breakout", d, close, c("_failed_units"), "active_breakout", c("_failed_close"))) for d in ("up", "down")]
    for side, back, out in (("high", "down", "up"), ("low", "up", "down")):
        held = (c(f"last_swing_{side}_units"), f"last_swing_{side}", c(f"last_swing_{side}_event_close_micros"))
        events.append(F.when(c(f"sweep_reject_{side}"), event(f"sweep_reject_{side}", back, close, *held)))
        events += [F.when(c(f"breakout_{out}"), event(kind, out, close, *held)) for kind in ("breakout", turn)]
    rows = x.select(E, "_row", F.posexplode(F.array_compact(F.array(*events))).alias("_p", "_v"))
    number = F.row_number().over(Window.partitionBy(E).orderBy("_row", "_p")).cast("bigint")
    return rows.select(E, number.alias("event_id"), *[F.col(f"_v.{k}") for k in STRUCTURE_EVENT[1:]])


def sequence_events(x: DataFrame) -> DataFrame:
    """One row per confirmed swing, numbered from 1 in a generation, with its type, the swing before on its side and what the sequence is after it: generation and SEQUENCE_EVENT; needs sequence()."""
    c = F.col
    swing = lambda side, level: F.when(c(f"newly_confirmed_swing_{side}"), F.struct(F.lit(f"swing_{side}").alias("kind"), c(f"swing_{side}_type").alias("type"), c(level).alias("units"), c(f"_before_{side}").alias("before")))
    rows = x.select(
        E, c("_row").alias("row"), c("ordinal").alias("candle_ordinal"), c("close_micros").alias("decision_close_micros"), "known_at_micros", c("_ec").alias("swing_event_close_micros"), c("market_structure_sequence").alias("sequence_after"), c("market_structure_bias").alias("bias_after"),
        F.posexplode(F.array_compact(F.array(swing("high", "_hl"), swing("low", "_ll")))).alias("_p", "_v"),
    )
    rows = rows.withColumns({
        "event_id": F.row_number().over(Window.partitionBy(E).orderBy("row", "_p")).cast("bigint"), "swing_event_type": c("_v.kind"), "swing_type": c("_v.type"), "swing_price_units": c("_v.units"), "swing_confirm_close_micros": c("decision_close_micros"),
        "previous_price_units": c("_v.before.units"), "previous_event_close_micros": c("_v.before.event"), "previous_confirm_close_micros": c("_v.before.confirm"),
    })
    return rows.select(E, *SEQUENCE_EVENT)


def regime(x: DataFrame) -> DataFrame:
    """Trend, volatility, structure, transition, quality and bias of a row, and their composite; needs structure() and sequence()."""
    c = F.col
    leg, bias, direction = c("trend_leg_direction"), c("market_structure_bias"), c("directional_state")
    one = lambda b: F.coalesce(b, F.lit(False)).cast("int")
    up = one(direction == "up") + one(leg == "up") + one(bias == "bullish")
    down = one(direction == "down") + one(leg == "down") + one(bias == "bearish")
    eff = F.coalesce(F.greatest("directional_efficiency_10", "directional_efficiency_20"), F.lit(0.0))
    trend = (
        F.when(c("compression_state") == "compressed", "compression").when(F.coalesce("range_like", F.lit(False)) | (direction == "sideways"), "range").when(up + down == 0, "neutral")
        .when((up > down) & ((eff >= 0.35) | (up >= 2)), "trend_up").when((down > up) & ((eff >= 0.35) | (down >= 2)), "trend_down").otherwise("neutral")
    )
    r = c("range_to_avg20")
    transition = (
        F.when(c("failed_breakout_up"), "failed_breakout_up").when(c("failed_breakout_down"), "failed_breakout_down").when(c("sweep_reject_high"), "sweep_high").when(c("sweep_reject_low"), "sweep_low")
        .when(c("change_of_character") & c("breakout_up"), "coch_up").when(c("change_of_character") & c("breakout_down"), "coch_down").when(c("breakout_up"), "bos_up").when(c("breakout_down"), "bos_down").otherwise("none")
    )
    quality = F.when(c("frozen") | c("jump") | c("reopen_jump"), "frozen_or_dirty").when(c("has_gap") | c("delayed_jump") | (c("max_abs_tick_jump_bps") > 5), "gap_or_jump").when(c("low_activity") | c("hard_low_activity"), "low_volume").otherwise("clean")
    x = x.withColumns({
        "regime_trend_state": trend, "regime_volatility_state": F.when(r.isNull(), "unknown").when(r < 0.60, "quiet").when(r <= 1.80, "normal").when(r <= 2.50, "expanded").otherwise("extreme"), "regime_structure_state": bias,
        "regime_transition_state": transition, "regime_quality_state": quality,
    })
    t, tr = c("regime_trend_state"), c("regime_transition_state")
    buy = (t == "trend_up") | (bias == "bullish") | tr.isin("bos_up", "coch_up", "sweep_low", "failed_breakout_down")
    sell = (t == "trend_down") | (bias == "bearish") | tr.isin("bos_down", "coch_down", "sweep_high", "failed_breakout_up")
    both = t.isin("range", "compression") | bias.isin("compression", "mixed", "volatile_expansion")
    x = x.withColumn("regime_directional_bias", F.when(buy, "buy_bias").when(sell, "sell_bias").when(both, "two_sided_or_no_bias").otherwise("neutral"))
    return x.withColumns({
        "regime_v1": F.concat_ws("|", "regime_trend_state", "regime_volatility_state", "regime_structure_state", "regime_transition_state", "regime_quality_state"), "is_regime_clean": c("regime_quality_state") == "clean",
        "is_regime_trending": t.isin("trend_up", "trend_down"), "is_regime_ranging": t == "range", "is_regime_transition": tr != "none",
    })


def windowed(c: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """All stages that windows can say, over the finalized candles of stream.candles()."""
    return sequence(swings(shape(statistics(rolling(adjacency(calendar(candle_columns(c))), s), s), s), s), s)


def features(c: DataFrame, path: DataFrame | None = None, s: Settings = SETTINGS) -> DataFrame:
    """Every feature of every clean candle; the tick_path_* outputs only with `path`."""
    x = regime(structure(carried(windowed(c, s), s)))
    if path is not None:
        x = x.join(path.withColumnRenamed(E, "_e").withColumnRenamed("open_micros", "_o"), F.col(E).eqNullSafe(F.col("_e")) & (F.col("open_micros") == F.col("_o")), "left").drop("_e", "_o")
    return x


def quote_deltas(moved: DataFrame, gap_max: int | None = 30 * MICRO) -> DataFrame:
    """One row per distinct tick: generation, t, seq, quote_delta_units (null on the first record and after a gap)."""
    far = F.lit(False) if gap_max is None else F.col("delta") > gap_max
    return moved.where("not duplicate").select(E, "t", "seq", F.when(F.col("delta").isNotNull() & ~far, F.col("units") - F.col("before")).alias("quote_delta_units"))
