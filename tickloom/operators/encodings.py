"""Encodings that are fitted once and then only applied: fixed bins, fifths of a development set, ranked labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .shards import lookup_join

INF = math.inf
#: Edges of the fixed bins. Bins are closed on the right, the first also on the left.
_RATIO = (0.0, 0.1, 0.25, 0.45, 0.65, 0.85, 1.0)
_RECENT = (0.0, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0, INF)
_EFFICIENCY = (-INF, -0.6, -0.3, -0.1, 0.1, 0.3, 0.6, INF)
_AGE = (-INF, 0.0, 1.0, 2.0, 3.0, 5.0, 8.0, 13.0, 21.0, INF)
_BARS = (*_AGE[:-1], 34.0, INF)
_MOMENTUM = (-INF, -20.0, -10.0, -5.0, -2.0, 2.0, 5.0, 10.0, 20.0, INF)
_RANGE = (0.0, 1.0, 2.0, 3.0, 5.0, 8.0, 13.0, 21.0, INF)
_BODY = (0.0, 0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 13.0, INF)
_JUMP = (0.0, 0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 13.0, 21.0, 34.0, INF)
_MILLIS = (-INF, 0.0, 250.0, 500.0, 1000.0, 2000.0, 5000.0, 10000.0, 30000.0, 60000.0, INF)
_AWAY = (-INF, -20.0, -10.0, -5.0, -2.0, -1.0, 0.0, 1.0, 2.0, 5.0, 10.0, 20.0, INF)
_SLOPE = (-INF, -5.0, -2.0, -1.0, -0.25, 0.25, 1.0, 2.0, 5.0, INF)
_LEVEL = (-INF, -20.0, -10.0, -5.0, -2.0, 0.0, 2.0, 5.0, 10.0, 20.0, INF)
BINS: dict[str, tuple[float, ...]] = {
    "close_position": (0.0, 0.2, 0.4, 0.6, 0.8, 1.0),
    **dict.fromkeys(("body_to_range", "upper_wick_to_range", "lower_wick_to_range"), _RATIO),
    **dict.fromkeys(("range_to_avg20", "range_vs_recent_ratio", "body_vs_recent_ratio", "tick_volume_vs_recent_ratio"), _RECENT),
    **dict.fromkeys((f"directional_efficiency_{w}" for w in (5, 10, 20)), _EFFICIENCY),
    "trend_leg_age_candles": _AGE,
    **dict.fromkeys(("bars_since_last_swing_high_known", "bars_since_last_swing_low_known", *(f"bars_since_last_confirmed_{t}_known" for t in ("HH", "HL", "LH", "LL")), "max_same_price_run_ticks", "missing_buckets_since_prev_candle"), _BARS),
    "return_1_bps": (-INF, -10.0, -5.0, -2.0, -1.0, 1.0, 2.0, 5.0, 10.0, INF),
    **dict.fromkeys(("momentum_5_bps", "momentum_10_bps"), _MOMENTUM),
    "momentum_20_bps": (-INF, -30.0, -15.0, -8.0, -3.0, 3.0, 8.0, 15.0, 30.0, INF),
    **dict.fromkeys(("range_bps", *(f"range_mean_{w}_bps" for w in (5, 10, 20))), _RANGE),
    **dict.fromkeys(("body_bps", "upper_wick_bps", "lower_wick_bps"), _BODY),
    **dict.fromkeys((f"abs_return_mean_{w}_bps" for w in (5, 10, 20)), (*_BODY[:-1], 21.0, INF)),
    **dict.fromkeys(("max_abs_tick_jump_bps", "max_true_tick_jump_bps", "max_gap_reopen_jump_bps"), _JUMP),
    **dict.fromkeys(("max_gap_micros", "max_internal_gap_micros", "starts_after_gap_micros", "max_same_price_run_micros"), _MILLIS),
    "tick_path_signed_imbalance": (-INF, -0.6, -0.25, -0.1, 0.1, 0.25, 0.6, INF),
    "tick_path_terminal_signed_imbalance": (-INF, -0.6, -0.34, -0.1, 0.1, 0.34, 0.6, INF),
    "tick_path_reversal_rate": (0.0, 0.25, 0.45, 0.6, 0.8, 1.0),
    "tick_path_efficiency": (0.0, 0.25, 0.35, 0.65, 1.0),
    "tick_path_close_position": (0.0, 0.2, 0.4, 0.6, 0.8, 1.0),
    **dict.fromkeys(("close_vs_ema20_bps", "close_vs_ema50_bps", "ema20_minus_ema50_bps"), _AWAY),
    **dict.fromkeys(("ema20_slope_bps", "ema50_slope_bps"), _SLOPE),
    **dict.fromkeys(("distance_to_last_swing_high_bps", "distance_to_last_swing_low_bps"), _LEVEL),
}
#: Labels that get no code.
UNCODED = ("", "missing", "none", "<NA>", "nan", "NaT")


def general(x: float) -> str:
    """Six significant digits without trailing zeros."""
    return f"{x:g}"


def bin_label(value: Column, edges: tuple[float, ...]) -> Column:
    """`LEFT_to_RIGHT` of the bin that holds value, null outside the edges."""
    v = value.cast("double")
    out = F.when(v.isNull() | F.isnan(v) | (v < edges[0]), None)
    for left, right in zip(edges, edges[1:]):
        out = out.when(v <= right if right != INF else F.lit(True), f"{general(left)}_to_{general(right)}")
    return out


def fixed_bins(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds NAME_bucketed for each column; durations in micros are binned in milliseconds."""
    return df.withColumns({f"{c}_bucketed": bin_label(F.col(c) / 1000.0 if c.endswith("_micros") else F.col(c), BINS[c]) for c in columns})


def development_fifths(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Cuts at the exact .2, .4, .6 and .8 quantiles (linear between values), equal ones once: keys, cuts; no row where there are under four distinct values.

    Values are counted per distinct value first, so a hot key costs its distinct values.
    """
    counts = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).groupBy(*keys, F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    q = F.array(*[F.lit(x) for x in (0.2, 0.4, 0.6, 0.8)])
    cuts = counts.groupBy(*keys).agg(F.percentile("_v", q, F.col("_n")).alias("cuts"), F.count(F.lit(1)).alias("_d")).where("_d >= 4")
    return cuts.select(*keys, F.array_distinct("cuts").alias("cuts"))


def fifth(value: Column, cuts: Column) -> Column:
    """Number of cuts below value (a cut belongs to the lower interval); null without value or cuts."""
    return F.when(value.isNotNull() & cuts.isNotNull(), F.size(F.filter(cuts, lambda c: c < value)))


def ranked_labels(df: DataFrame, columns: list[str], max_labels: int = 64) -> DataFrame:
    """Codes fitted for each column: column, label, code (0 is the most frequent; ties by label), n. All columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("label")) for c in columns]))
    counts = df.select(pairs.alias("p")).select("p.*").where(F.col("label").isNotNull() & ~F.col("label").isin(*UNCODED)).groupBy("column", "label").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    w = Window.partitionBy("column").orderBy(F.desc("n"), "label")
    return counts.withColumn("code", F.row_number().over(w) - 1).where(F.col("code") < max_labels).select("column", "label", F.col("code").cast("int").alias("code"), "n")


def encoded(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """Adds NAME_code for each column: the fitted code, -1 for null, uncoded or unseen labels. What was fitted is written once, not fitted again for each column, and measured before it is broadcast."""
    fitted = written(fitted.select("column", "label", "code"), "fitted")
    for c in columns:
        one = fitted.where(F.col("column") == c).select(F.col("label").alias("_label"), F.col("code").alias(f"{c}_code"))
        df = lookup_join(df.withColumn("_label", F.col(c).cast("string")), one, "_label").drop("_label").withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(-1)).cast("int"))
    return df
