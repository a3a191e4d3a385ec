"""Queries and SQL of tick streams, candles and candle features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import encodings
from .operators import features as fe
from .operators import stream as st
from .plans import catalog
from .session import written
from .sources import table


def _accepted(spark: SparkSession, d: str) -> DataFrame:
    return st.accepted(table(spark, d, "ticks"), table(spark, d, "generations"))


def _moved(spark: SparkSession, d: str) -> DataFrame:
    """The moves, over accepted records written once: every running total reads its rows twice, so a chain of them would read all before it ever more often."""
    return st.moves(written(_accepted(spark, d), "accepted"))


def _candles(spark: SparkSession, d: str, duration: int = 60, offset: int = 0) -> DataFrame:
    moved = _moved(spark, d)
    return st.candles(moved, duration, offset, moved=moved)


def ticks_accepted(spark: SparkSession, d: str) -> DataFrame:
    return _accepted(spark, d)


def tick_rejects(spark: SparkSession, d: str) -> DataFrame:
    return st.rejects(table(spark, d, "ticks"), table(spark, d, "generations"))


def stream_audit(spark: SparkSession, d: str) -> DataFrame:
    return st.audit(table(spark, d, "ticks"), table(spark, d, "generations"))


def tick_moves(spark: SparkSession, d: str) -> DataFrame:
    return _moved(spark, d).select("generation", "seq", "t", "delta", "duplicate", "context", "bps", "run")


def quote_deltas(spark: SparkSession, d: str) -> DataFrame:
    return fe.quote_deltas(_moved(spark, d))


CANDLE = ("generation", "ordinal", "open_micros", "close_micros", "known_at_micros", "first_event_micros", "last_event_micros", "active_span_micros", "open_units", "high_units", "low_units", "close_units", "observations", "duplicates", "gap_before_micros", "max_gap_inside_micros", "missing_buckets_before", "frozen_observations", "frozen_micros", "max_jump_bps", "max_delayed_jump_bps", "max_reopen_jump_bps")


def candles_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return _candles(spark, d).select(*CANDLE)


def candles_offset_grid(spark: SparkSession, d: str) -> DataFrame:
    return _candles(spark, d, 300, 120).select(*CANDLE)


def candles_multi_stream(spark: SparkSession, d: str) -> DataFrame:
    moved = _moved(spark, d)
    one = lambda s: st.candles(moved, s, moved=moved).select(F.lit(s).alias("duration_seconds"), "generation", "open_micros", "open_units", "high_units", "low_units", "close_units", "observations")
    return one(60).unionByName(one(300)).unionByName(one(900))


def candle_flags(spark: SparkSession, d: str) -> DataFrame:
    return _candles(spark, d).select("generation", "open_micros", *st.FLAGS)


def candle_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return st.flag_counts(_candles(spark, d))


def candles_withheld_tail(spark: SparkSession, d: str) -> DataFrame:
    return st.withheld(_accepted(spark, d))


def candles_from_bars(spark: SparkSession, d: str) -> DataFrame:
    bars = table(spark, d, "candles").select("generation", F.unix_micros("open_time_micros").alias("open_micros"), "open_units", "high_units", "low_units", "close_units", "volume")
    return st.resampled(bars, 300, 60).withColumn("volume", F.round("volume", 3))


def profile_gap_facts(spark: SparkSession, d: str) -> DataFrame:
    return st.gap_facts(_moved(spark, d))


def profile_cadence_histogram(spark: SparkSession, d: str) -> DataFrame:
    return st.log2_histogram(_moved(spark, d), "delta", "generation")


def profile_jump_histogram(spark: SparkSession, d: str) -> DataFrame:
    return st.log2_histogram(_moved(spark, d), "bps", "generation", "context")


def profile_price_facts(spark: SparkSession, d: str) -> DataFrame:
    return st.price_facts(_moved(spark, d))


def profile_runs(spark: SparkSession, d: str) -> DataFrame:
    return st.run_facts(_moved(spark, d))


def profile_documents(spark: SparkSession, d: str) -> DataFrame:
    moved = _moved(spark, d)
    p = st.profile(moved, st.candles(moved, moved=moved))
    return p.select("generation", "prices.*", "gaps.*", "runs.*", "flags.*")


KEY = ("generation", "ordinal")


def tick_path(spark: SparkSession, d: str) -> DataFrame:
    return fe.tick_path(_moved(spark, d))


ANATOMY = ("candle_direction", "body_units", "range_units", "upper_wick_units", "lower_wick_units", "body_bps", "range_bps", "upper_wick_bps", "lower_wick_bps", "close_position", "body_to_range", "upper_wick_to_range", "lower_wick_to_range")
QUALITY = ("tick_volume", "has_gap", "starts_after_gap_class", "max_gap_micros", "worst_gap_class", "max_abs_tick_jump_bps", "max_true_tick_jump_bps", "max_gap_reopen_jump_bps", "quality_tier")
CALENDAR = ("utc_day_of_week", "utc_hour", "utc_session_6h")
ADJACENCY = ("has_adjacent_previous_clean_candle", "clean_segment_index", "clean_segment_candle_index", "range_overlap", "candle_pattern", "previous_candle_relation", "is_inside_bar", "is_outside_bar")
ROLLING = ("return_1_bps", *[f"{a}_{w}{b}" for w in (5, 10, 20) for a, b in (("momentum", "_bps"), ("directional_efficiency", ""), ("abs_return_mean", "_bps"), ("range_mean", "_bps"), ("tick_volume_mean", ""))], "range_to_avg20", "compression_state", "directional_state", "range_like")
STATISTICS = tuple(f"{a}_{w}{b}" for w in (5, 10, 20) for a, b in (("return_std", "_bps"), ("return_skew", ""), ("return_kurtosis", ""), ("return_autocorr", ""), ("sign_reversal_rate", ""), ("up_move_ratio", ""), ("trend_r2", ""), ("trend_residual", "_bps"), ("range_position", "")))
SHAPE = ("prior_clean_history_count", "range_vs_recent_ratio", "body_vs_recent_ratio", "tick_volume_vs_recent_ratio", "candle_color", "candle_type", "range_bps_bucket", "body_bps_bucket", "range_vs_recent_bucket", "body_vs_recent_bucket", "tick_volume_vs_recent_bucket", "upper_wick_size_bucket", "lower_wick_size_bucket", "wick_profile", "close_location_bucket", "body_dominance", "is_doji", "is_strong_body", "is_pin_bar", "is_hammer_like", "is_shooting_star_like", "is_expansion_candle", "is_compression_candle")
SWINGS = tuple(x for side in ("high", "low") for x in (f"newly_confirmed_swing_{side}", f"last_swing_{side}_units", f"last_swing_{side}_event_close_micros", f"last_swing_{side}_confirm_close_micros", f"bars_since_last_swing_{side}_known", f"distance_to_last_swing_{side}_bps", f"sweep_reject_{side}")) + ("breakout_up", "breakout_down")
SEQUENCE = ("swing_high_type", "swing_low_type", "last_swing_high_type", "last_swing_low_type", *[f"newly_confirmed_{t}" for t in ("HH", "HL", "LH", "LL")], "market_structure_sequence", "market_structure_bias", *[f"last_confirmed_{t}_{x}" for t in ("HH", "HL", "LH", "LL") for x in ("units", "event_close_micros", "confirm_close_micros")], *[f"bars_since_last_confirmed_{t}_known" for t in ("HH", "HL", "LH", "LL")])
EMA = tuple(x for p in (20, 50) for x in (f"ema{p}", f"is_ema{p}_ready", f"close_vs_ema{p}_bps", f"is_close_above_ema{p}", f"ema{p}_slope_bps", f"ema{p}_slope_state", f"close_vs_ema{p}_state")) + ("ema20_minus_ema50_bps", "is_ema20_above_ema50", "ema20_ema50_alignment_state")
STATE = ("trend_leg_direction", "trend_leg_age_candles", "pullback_against_trend", "failed_breakout_up", "failed_breakout_down", "break_of_structure", "change_of_character", "structure_state", "current_event_types", "current_event_close_micros")
REGIME = ("regime_trend_state", "regime_volatility_state", "regime_structure_state", "regime_transition_state", "regime_quality_state", "regime_directional_bias", "regime_v1", "is_regime_clean", "is_regime_trending", "is_regime_ranging", "is_regime_transition")


def anatomy(spark: SparkSession, d: str) -> DataFrame:
    return fe.calendar(fe.candle_columns(_candles(spark, d))).select(*KEY, *QUALITY, *ANATOMY, *CALENDAR)


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return fe.adjacency(fe.candle_columns(_candles(spark, d))).select(*KEY, *ADJACENCY)


def rolling_features(spark: SparkSession, d: str) -> DataFrame:
    return fe.rolling(fe.candle_columns(_candles(spark, d))).select(*KEY, *ROLLING)


def rolling_statistics(spark: SparkSession, d: str) -> DataFrame:
    return fe.statistics(fe.rolling(fe.candle_columns(_candles(spark, d)))).select(*KEY, *STATISTICS)


def candle_shape(spark: SparkSession, d: str) -> DataFrame:
    return fe.shape(fe.adjacency(fe.candle_columns(_candles(spark, d)))).select(*KEY, *SHAPE)


def swing_structure(spark: SparkSession, d: str) -> DataFrame:
    return fe.swings(fe.candle_columns(_candles(spark, d))).select(*KEY, *SWINGS)


def swing_sequence(spark: SparkSession, d: str) -> DataFrame:
    return fe.sequence(fe.swings(fe.candle_columns(_candles(spark, d)))).select(*KEY, *SEQUENCE)


def _all(spark: SparkSession, d: str) -> DataFrame:
    return fe.features(_candles(spark, d))


def moving_averages(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d).select(*KEY, *EMA)


def structure_state(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d).select(*KEY, *STATE)


def structure_events(spark: SparkSession, d: str) -> DataFrame:
    return fe.structure_events(_all(spark, d))


def sequence_events(spark: SparkSession, d: str) -> DataFrame:
    return fe.sequence_events(fe.sequence(fe.swings(fe.candle_columns(_candles(spark, d)))))


def regime(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d).select(*KEY, *REGIME)


def _features(spark: SparkSession, d: str) -> DataFrame:
    moved = written(_moved(spark, d), "moved")
    return fe.features(st.candles(moved, moved=moved), fe.tick_path(moved))


def feature_rows_all(spark: SparkSession, d: str) -> DataFrame:
    """Every output of the catalog for every clean candle."""
    return catalog.resolve().apply(_features(spark, d))


def feature_bins(spark: SparkSession, d: str) -> DataFrame:
    """All fixed bins of every clean candle."""
    return encodings.fixed_bins(_features(spark, d), list(encodings.BINS)).select(*KEY, *[f"{c}_bucketed" for c in encodings.BINS])


QUERIES = {
    f.__name__: f
    for f in (
        ticks_accepted, tick_rejects, stream_audit, tick_moves, quote_deltas, candles_tumbling, candles_offset_grid, candles_multi_stream, candle_flags, candle_flag_counts, candles_withheld_tail, candles_from_bars, profile_gap_facts,
        profile_cadence_histogram, profile_jump_histogram, profile_price_facts, profile_runs, profile_documents, tick_path, anatomy, adjacency, rolling_features, rolling_statistics, candle_shape, swing_structure, swing_sequence,
        moving_averages, structure_state, structure_events, sequence_events, regime, feature_rows_all, feature_bins,
    )
}

# SQL, written apart from the operators: plain windows over whole generations.

ACCEPTED = """
sc AS (SELECT generation, max(price_scale) AS s FROM generations GROUP BY 1),
r0 AS (SELECT ticks.generation, tick_id AS seq, epoch_us(event_time_micros) AS t, price, s, price * pow(10.0, s) AS x FROM ticks LEFT JOIN sc USING (generation)),
r1 AS (SELECT *, CASE WHEN t IS NULL OR price IS NULL THEN 'missing_value' WHEN s IS NULL THEN 'unknown_scale' WHEN NOT (abs(x) < 9e15 AND abs(x - round(x)) <= 1e-6) THEN 'off_scale' END AS bad FROM r0),
r2 AS (SELECT *, max(CASE WHEN bad IS NULL THEN t END) OVER (PARTITION BY generation ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM r1),
r3 AS (SELECT *, coalesce(bad, CASE WHEN t < newest THEN 'backwards_time' END) AS worse FROM r2),
r4 AS (SELECT *, coalesce(worse, CASE WHEN first_value(round(x)) OVER (PARTITION BY generation, t, worse IS NULL ORDER BY seq) <> round(x) THEN 'conflicting_duplicate' END) AS reason FROM r3),
acc AS (SELECT generation, seq, t, CAST(round(x) AS BIGINT) AS units FROM r4 WHERE reason IS NULL)"""
MOVED = (
    ACCEPTED
    + """,
m0 AS (SELECT *, lag(t) OVER w AS pt, lag(units) OVER w AS before FROM acc WINDOW w AS (PARTITION BY generation ORDER BY t, seq)),
mv AS (SELECT generation, seq, t, units, t - pt AS delta, before, coalesce(t = pt AND units = before, false) AS duplicate,
  CASE WHEN pt IS NULL THEN NULL WHEN t - pt <= 30000000 THEN 'contiguous' WHEN t - pt >= 600000000 THEN 'reopen' ELSE 'delayed' END AS context,
  CASE WHEN before <> 0 THEN abs(units - before) * 10000 // abs(before) END AS bps, CASE WHEN before <> 0 THEN abs((units - before) / CAST(abs(before) AS DOUBLE) * 10000) END AS xb,
  CAST(sum(CASE WHEN before = units THEN 0 ELSE 1 END) OVER (PARTITION BY generation ORDER BY t, seq) AS BIGINT) AS run FROM m0)"""
)


def candle_sql(duration: int = 60, offset: int = 0, name: str = "c") -> str:
    d, o = duration * 1_000_000, offset * 1_000_000
    n = name
    return f""",
{n}b AS (SELECT *, t - ((((t - {o}) % {d}) + {d}) % {d}) AS open_micros FROM mv),
{n}r AS (SELECT generation, open_micros, run, count(*) AS k, max(t) - min(t) AS span FROM {n}b GROUP BY 1, 2, 3),
{n}s AS (SELECT generation, open_micros, max(k) AS frozen_observations, max(span) AS frozen_micros FROM {n}r GROUP BY 1, 2),
{n}f AS (SELECT generation, open_micros, min(t) AS first_event_micros, max(t) AS last_event_micros, arg_min(units, (t, seq)) AS open_units, max(units) AS high_units, min(units) AS low_units, arg_max(units, (t, seq)) AS close_units,
  count(*) AS observations, CAST(sum(CAST(duplicate AS INT)) AS BIGINT) AS duplicates, (arg_min({{'d': delta}}, (t, seq))).d AS gap_before_micros, coalesce(max(CASE WHEN t - delta >= open_micros THEN delta END), 0) AS max_gap_inside_micros,
  coalesce(max(bps) FILTER (WHERE context = 'contiguous'), 0) AS max_jump_bps, coalesce(max(bps) FILTER (WHERE context = 'delayed'), 0) AS max_delayed_jump_bps, coalesce(max(bps) FILTER (WHERE context = 'reopen'), 0) AS max_reopen_jump_bps,
  coalesce(max(xb), 0.0) AS xa, coalesce(max(xb) FILTER (WHERE context = 'contiguous'), 0.0) AS xt, coalesce(max(xb) FILTER (WHERE context = 'reopen'), 0.0) AS xr FROM {n}b GROUP BY 1, 2),
{n}w AS (SELECT *, lead(first_event_micros) OVER w AS known_at_micros, coalesce((open_micros - lag(open_micros) OVER w) // {d} - 1, 0) AS missing_buckets_before, row_number() OVER w - 1 AS ordinal FROM {n}f JOIN {n}s USING (generation, open_micros) WINDOW w AS (PARTITION BY generation ORDER BY open_micros)),
{n}g AS (SELECT *, open_micros + {d} AS close_micros, last_event_micros - first_event_micros AS active_span_micros, observations < 3 AS low_activity, observations < 2 AS hard_low_activity, coalesce(gap_before_micros > 30000000, false) AS gap_before,
  max_gap_inside_micros > 30000000 AS gap_inside, missing_buckets_before > 0 AS missing_before, frozen_observations >= 8 OR frozen_micros >= 60000000 AS frozen, max_jump_bps >= 40 AS jump, max_delayed_jump_bps >= 40 AS delayed_jump,
  max_reopen_jump_bps >= 40 AS reopen_jump, last_event_micros - first_event_micros < {d} * 20 // 100 AS short_span FROM {n}w WHERE known_at_micros IS NOT NULL),
{n} AS (SELECT *, complete AND NOT (low_activity OR frozen OR jump OR delayed_jump OR reopen_jump OR short_span) AS clean FROM (SELECT *, NOT (hard_low_activity OR gap_before OR gap_inside OR missing_before) AS complete FROM {n}g))"""


LADDER = lambda x, ends, names, null="NULL": f"CASE WHEN {x} IS NULL THEN {null} " + " ".join(f"WHEN {x} <= {e} THEN '{n}'" for e, n in zip(ends, names)) + f" ELSE '{names[-1]}' END"
GAPS = ((0, 2000000, 15000000, 60000000, 300000000, 1800000000), ("duplicate_or_backwards", "normal_small_tick_delay", "medium_feed_delay", "large_feed_delay", "short_data_gap", "session_or_collection_gap", "major_data_outage_or_session_break"))
BPS = ((0, 1, 3, 8, 18), ("flat", "tiny", "small", "normal", "large", "extreme"))
WICK = ((0.03, 0.12, 0.25, 0.45, 0.65), ("none", "tiny", "small", "normal", "large", "extreme"))
REL = ((0.35, 0.70, 1.35, 2.25), ("tiny", "small", "normal", "large", "extreme"))

CLEAN = (
    MOVED
    + candle_sql()
    + f""",
k0 AS (SELECT *, open_units AS o, high_units AS h, low_units AS l, close_units AS z, greatest(0, coalesce(gap_before_micros, 0), max_gap_inside_micros) AS max_gap_micros FROM c WHERE clean),
k AS (SELECT *, observations AS tick_volume, gap_before OR gap_inside OR missing_before AS has_gap, {LADDER('gap_before_micros', *GAPS)} AS starts_after_gap_class, {LADDER('greatest(max_gap_micros, 1)', *GAPS)} AS worst_gap_class,
  round(xa, 6) AS max_abs_tick_jump_bps, round(xt, 6) AS max_true_tick_jump_bps, round(xr, 6) AS max_gap_reopen_jump_bps, 'clean_v1' AS quality_tier, CASE WHEN z > o THEN 'up' WHEN z < o THEN 'down' ELSE 'flat' END AS candle_direction,
  abs(z - o) AS body_units, h - l AS range_units, h - greatest(o, z) AS upper_wick_units, least(o, z) - l AS lower_wick_units,
  round(CAST(abs(z - o) AS DOUBLE) / nullif(abs(o), 0) * 10000, 6) AS body_bps, round(CAST(h - l AS DOUBLE) / nullif(abs(o), 0) * 10000, 6) AS range_bps, round(CAST(h - greatest(o, z) AS DOUBLE) / nullif(abs(o), 0) * 10000, 6) AS upper_wick_bps, round(CAST(least(o, z) - l AS DOUBLE) / nullif(abs(o), 0) * 10000, 6) AS lower_wick_bps,
  CASE WHEN h > l THEN round(CAST(z - l AS DOUBLE) / (h - l), 6) ELSE 0.5 END AS close_position, CASE WHEN h > l THEN round(CAST(abs(z - o) AS DOUBLE) / (h - l), 6) ELSE 0.0 END AS body_to_range,
  CASE WHEN h > l THEN round(CAST(h - greatest(o, z) AS DOUBLE) / (h - l), 6) ELSE 0.0 END AS upper_wick_to_range, CASE WHEN h > l THEN round(CAST(least(o, z) - l AS DOUBLE) / (h - l), 6) ELSE 0.0 END AS lower_wick_to_range,
  strftime(make_timestamp(close_micros), '%A') AS utc_day_of_week, CAST(hour(make_timestamp(close_micros)) AS INT) AS utc_hour, printf('%02d-%02d', hour(make_timestamp(close_micros)) // 6 * 6, hour(make_timestamp(close_micros)) // 6 * 6 + 6) AS utc_session_6h FROM k0)"""
)
ADJACENT = (
    CLEAN
    + """,
a0 AS (SELECT *, lag(ordinal) OVER w AS po, lag(o) OVER w AS p_o, lag(h) OVER w AS p_h, lag(l) OVER w AS p_l, lag(z) OVER w AS p_z, lag(body_to_range) OVER w AS p_b FROM k WINDOW w AS (PARTITION BY generation ORDER BY ordinal)),
a1 AS (SELECT *, coalesce(ordinal = po + 1, false) AS adj FROM a0),
a AS (SELECT *, CAST(sum(CASE WHEN adj THEN 0 ELSE 1 END) OVER (PARTITION BY generation ORDER BY ordinal) AS BIGINT) AS clean_segment_index,
  CASE WHEN adj AND h > l THEN round(CAST(greatest(0, least(h, p_h) - greatest(l, p_l)) AS DOUBLE) / (h - l), 6) END AS range_overlap,
  CASE WHEN NOT adj THEN NULL WHEN body_to_range <= 0.1 OR p_b <= 0.1 THEN 'none' WHEN p_z < p_o AND z > o AND o <= p_z AND z >= p_o THEN 'bullish_engulfing' WHEN p_z > p_o AND z < o AND o >= p_z AND z <= p_o THEN 'bearish_engulfing'
    WHEN p_z < p_o AND z > o AND o >= p_z AND z <= p_o THEN 'bullish_harami' WHEN p_z > p_o AND z < o AND o <= p_z AND z >= p_o THEN 'bearish_harami' ELSE 'none' END AS candle_pattern,
  CASE WHEN p_h IS NULL THEN 'first_clean_candle' WHEN NOT adj THEN 'no_adjacent_previous_clean_candle' WHEN h < p_h AND l > p_l THEN 'inside_previous' WHEN h > p_h AND l < p_l THEN 'outside_previous' WHEN h > p_h AND l >= p_l THEN 'higher_range' WHEN h <= p_h AND l < p_l THEN 'lower_range' ELSE 'overlap_previous' END AS previous_candle_relation,
  adj AND h < p_h AND l > p_l AS is_inside_bar, adj AND h > p_h AND l < p_l AS is_outside_bar, adj AS has_adjacent_previous_clean_candle FROM a1),
seg AS (SELECT *, row_number() OVER (PARTITION BY generation, clean_segment_index ORDER BY ordinal) - 1 AS clean_segment_candle_index FROM a)"""
)


def _w(n: int, before: int = 0) -> str:
    return f"(PARTITION BY generation ORDER BY ordinal ROWS BETWEEN {n - 1 + before} PRECEDING AND {before} PRECEDING)" if before else f"(PARTITION BY generation ORDER BY ordinal ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _rolling_sql() -> str:
    cols = []
    for n in (5, 10, 20):
        w = _w(n)
        m = f"(z - lag(z, {n}) OVER g) / CAST(nullif(abs(lag(z, {n}) OVER g), 0) AS DOUBLE) * 10000"
        cols.append(f"""round({m}, 6) AS momentum_{n}_bps, CASE WHEN count(r) OVER {w} = {n} AND sum(abs(r)) OVER {w} > 0 THEN round(least(abs({m}) / sum(abs(r)) OVER {w}, 1.0), 6) END AS directional_efficiency_{n},
  CASE WHEN count(r) OVER {w} = {n} THEN round(avg(abs(r)) OVER {w}, 6) END AS abs_return_mean_{n}_bps, CASE WHEN count(range_bps) OVER {w} = {n} THEN round(avg(range_bps) OVER {w} + 1e-9, 6) END AS range_mean_{n}_bps,
  CASE WHEN count(*) OVER {w} = {n} THEN round(avg(tick_volume) OVER {w}, 6) END AS tick_volume_mean_{n}""")
    return (
        CLEAN
        + f""",
q0 AS (SELECT *, (z - lag(z) OVER g) / CAST(nullif(abs(lag(z) OVER g), 0) AS DOUBLE) * 10000 AS r FROM k WINDOW g AS (PARTITION BY generation ORDER BY ordinal)),
q1 AS (SELECT *, round(r, 6) AS return_1_bps, {', '.join(cols)} FROM q0 WINDOW g AS (PARTITION BY generation ORDER BY ordinal)),
q2 AS (SELECT *, CASE WHEN range_mean_20_bps > 0 THEN round(range_mean_5_bps / range_mean_20_bps, 6) END AS range_to_avg20 FROM q1),
q AS (SELECT *, coalesce(directional_efficiency_10 <= 0.3, false) AND compression_state IN ('compressed', 'normal') AS range_like FROM (SELECT *,
  CASE WHEN range_to_avg20 IS NULL THEN 'unknown' WHEN range_to_avg20 < 0.7 THEN 'compressed' WHEN range_to_avg20 >= 2.25 THEN 'extreme' WHEN range_to_avg20 >= 1.35 THEN 'expanded' ELSE 'normal' END AS compression_state,
  CASE WHEN momentum_10_bps IS NULL OR directional_efficiency_10 IS NULL THEN 'unknown' WHEN abs(momentum_10_bps) < 2 OR directional_efficiency_10 < 0.35 THEN 'sideways' WHEN momentum_10_bps > 0 THEN 'up' ELSE 'down' END AS directional_state FROM q2))"""
    )


ROLLED = _rolling_sql()


def _statistics_sql() -> str:
    cols = []
    for n in (5, 10, 20):
        w, p = _w(n), _w(n - 1)
        have = f"count(r) OVER {w} = {n}"
        sd = f"stddev_pop(r) OVER {w}"
        cols.append(f"""CASE WHEN {have} THEN round({sd}, 6) END AS return_std_{n}_bps,
  CASE WHEN {have} AND {sd} > 1e-9 THEN round(list_sum(list_transform(list(r) OVER {w}, lambda v: pow(v - list_avg(list(r) OVER {w}), 3))) / {n} / pow({sd}, 3), 4) END AS return_skew_{n},
  CASE WHEN {have} AND {sd} > 1e-9 THEN round(list_sum(list_transform(list(r) OVER {w}, lambda v: pow(v - list_avg(list(r) OVER {w}), 4))) / {n} / pow({sd}, 4) - 3, 4) END AS return_kurtosis_{n},
  CASE WHEN {have} AND stddev_pop(r) OVER {p} * stddev_pop(pr) OVER {p} > 1e-12 THEN round(covar_pop(r, pr) OVER {p} / (stddev_pop(r) OVER {p} * stddev_pop(pr) OVER {p}), 4) END AS return_autocorr_{n},
  CASE WHEN {have} THEN round(avg(CASE WHEN r <> 0 AND pr <> 0 THEN CASE WHEN sign(r) <> sign(pr) THEN 1.0 ELSE 0.0 END END) OVER {p}, 6) END AS sign_reversal_rate_{n},
  CASE WHEN {have} AND sum(abs(r)) OVER {w} > 0 THEN round(sum(greatest(r, 0.0)) OVER {w} / sum(abs(r)) OVER {w}, 6) END AS up_move_ratio_{n},
  CASE WHEN count(*) OVER {w} = {n} AND max(z) OVER {w} > min(z) OVER {w} THEN round(regr_r2(z, x) OVER {w} + 1e-9, 4) END AS trend_r2_{n},
  CASE WHEN count(*) OVER {w} = {n} AND z <> 0 THEN round((z - (avg(z) OVER {w} + regr_slope(z, x) OVER {w} * (x - avg(x) OVER {w}))) / z * 10000, 4) END AS trend_residual_{n}_bps,
  CASE WHEN count(*) OVER {w} = {n} AND max(h) OVER {w} > min(l) OVER {w} THEN round((z - min(l) OVER {w}) / CAST(max(h) OVER {w} - min(l) OVER {w} AS DOUBLE), 6) END AS range_position_{n}""")
    return ROLLED + f""",
s0 AS (SELECT *, lag(r) OVER g AS pr, CAST(row_number() OVER g AS DOUBLE) AS x FROM q WINDOW g AS (PARTITION BY generation ORDER BY ordinal)),
s AS (SELECT *, {', '.join(cols)} FROM s0)"""


SHAPED = (
    ADJACENT
    + """,
h0 AS (SELECT *, count(*) OVER v AS hist, avg(range_bps) OVER v AS mr, avg(body_bps) OVER v AS mb, avg(tick_volume) OVER v AS mt FROM seg WINDOW v AS (PARTITION BY generation, clean_segment_index ORDER BY ordinal ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
h1 AS (SELECT *, hist AS prior_clean_history_count, CASE WHEN hist >= 5 AND mr > 0 THEN round(range_bps / mr, 6) END AS range_vs_recent_ratio, CASE WHEN hist >= 5 AND mb > 0 THEN round(body_bps / mb, 6) END AS body_vs_recent_ratio,
  CASE WHEN hist >= 5 AND mt > 0 THEN round(tick_volume / mt, 6) END AS tick_volume_vs_recent_ratio, upper_wick_to_range AS u, lower_wick_to_range AS d, body_to_range AS b, close_position AS p,
  CASE candle_direction WHEN 'up' THEN 'bullish' WHEN 'down' THEN 'bearish' ELSE 'neutral' END AS candle_color FROM h0),
h2 AS (SELECT *, b <= 0.1 AS is_doji, d >= 0.55 AND u <= 0.25 AND b <= 0.35 AND p >= 0.55 AS is_hammer_like, u >= 0.55 AND d <= 0.25 AND b <= 0.35 AND p <= 0.45 AS is_shooting_star_like,
  b >= 0.65 AND ((candle_color = 'bullish' AND p >= 0.7) OR (candle_color = 'bearish' AND p <= 0.3)) AS is_strong_body FROM h1),
h3 AS (SELECT *, is_hammer_like OR is_shooting_star_like OR (b <= 0.35 AND (u >= 0.6 OR d >= 0.6) AND abs(u - d) >= 0.3) AS is_pin_bar FROM h2),
sh AS (SELECT *, CASE WHEN is_doji THEN CASE WHEN u >= 0.25 AND d >= 0.25 THEN 'long_legged_doji' ELSE 'doji' END WHEN is_hammer_like THEN 'hammer_like_' || candle_color WHEN is_shooting_star_like THEN 'shooting_star_like_' || candle_color
    WHEN is_pin_bar THEN 'pin_bar_' || candle_color WHEN is_strong_body THEN 'strong_' || candle_color WHEN b <= 0.25 AND u >= 0.2 AND d >= 0.2 THEN 'spinning_top_' || candle_color WHEN p >= 0.75 THEN 'high_close_' || candle_color WHEN p <= 0.25 THEN 'low_close_' || candle_color ELSE 'normal_' || candle_color END AS candle_type,
  """
    + f"""{LADDER('range_bps', *BPS)} AS range_bps_bucket, {LADDER('body_bps', *BPS)} AS body_bps_bucket, {LADDER('range_vs_recent_ratio', *REL, "'unknown_warmup'")} AS range_vs_recent_bucket, {LADDER('body_vs_recent_ratio', *REL, "'unknown_warmup'")} AS body_vs_recent_bucket,
  {LADDER('tick_volume_vs_recent_ratio', *REL, "'unknown_warmup'")} AS tick_volume_vs_recent_bucket, {LADDER('u', *WICK)} AS upper_wick_size_bucket, {LADDER('d', *WICK)} AS lower_wick_size_bucket,
  CASE WHEN u >= 0.45 AND d >= 0.45 THEN 'long_wicks_both' WHEN u >= 0.5 AND u >= 1.75 * d THEN 'upper_rejection' WHEN d >= 0.5 AND d >= 1.75 * u THEN 'lower_rejection' WHEN u <= 0.1 AND d <= 0.1 AND b >= 0.75 THEN 'clean_body' WHEN u >= 0.25 OR d >= 0.25 THEN 'wicked' ELSE 'balanced_wicks' END AS wick_profile,
  CASE WHEN p >= 0.85 THEN 'close_near_high' WHEN p >= 0.65 THEN 'upper_mid_close' WHEN p >= 0.35 THEN 'middle_close' WHEN p >= 0.15 THEN 'lower_mid_close' ELSE 'close_near_low' END AS close_location_bucket,
  {LADDER('b', (0.10, 0.25, 0.55, 0.80), ('doji_body', 'small_body', 'balanced_body', 'body_dominant', 'marubozu_like'))} AS body_dominance, coalesce(range_vs_recent_ratio >= 1.5 AND b >= 0.4, false) AS is_expansion_candle, coalesce(range_vs_recent_ratio <= 0.7, false) AS is_compression_candle FROM h3)"""
)


def _swing_sql() -> str:
    g = "PARTITION BY generation ORDER BY ordinal"
    out = CLEAN + f""",
w0 AS (SELECT *, row_number() OVER g - 1 AS rn, lag(h, 2) OVER g AS hl, lag(l, 2) OVER g AS ll, lag(close_micros, 2) OVER g AS ec, lag(z) OVER g AS pz,
  max(h) OVER ({g} ROWS BETWEEN 4 PRECEDING AND 3 PRECEDING) AS hb, max(h) OVER ({g} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS ha, min(l) OVER ({g} ROWS BETWEEN 4 PRECEDING AND 3 PRECEDING) AS lb, min(l) OVER ({g} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS la FROM k WINDOW g AS ({g})),
w1 AS (SELECT *, rn >= 4 AND hl > hb AND hl > ha AS newly_confirmed_swing_high, rn >= 4 AND ll < lb AND ll < la AS newly_confirmed_swing_low FROM w0),"""
    parts = []
    for side, level in (("high", "hl"), ("low", "ll")):
        for name, v in (("units", level), ("event_close_micros", "ec"), ("confirm_close_micros", "close_micros"), ("row", "rn")):
            parts.append(f"last_value(CASE WHEN newly_confirmed_swing_{side} THEN {v} END IGNORE NULLS) OVER ({g} ROWS UNBOUNDED PRECEDING) AS last_swing_{side}_{name}")
    out += f"""
w2 AS (SELECT *, {', '.join(parts)} FROM w1),
w AS (SELECT *, rn - last_swing_high_row AS bars_since_last_swing_high_known, rn - last_swing_low_row AS bars_since_last_swing_low_known, round((z - last_swing_high_units) / CAST(nullif(abs(last_swing_high_units), 0) AS DOUBLE) * 10000, 6) AS distance_to_last_swing_high_bps, round((z - last_swing_low_units) / CAST(nullif(abs(last_swing_low_units), 0) AS DOUBLE) * 10000, 6) AS distance_to_last_swing_low_bps,
  coalesce(h > last_swing_high_units AND z < last_swing_high_units, false) AS sweep_reject_high, coalesce(l < last_swing_low_units AND z > last_swing_low_units, false) AS sweep_reject_low,
  coalesce(z > last_swing_high_units AND (pz IS NULL OR pz <= last_swing_high_units), false) AS breakout_up, coalesce(z < last_swing_low_units AND (pz IS NULL OR pz >= last_swing_low_units), false) AS breakout_down FROM w2)"""
    return out


SWUNG = _swing_sql()


def _sequence_sql() -> str:
    g = "PARTITION BY generation ORDER BY ordinal"
    types = []
    for side, level, up, first, down, same in (("high", "hl", "HH", "first_high", "LH", "EH"), ("low", "ll", "HL", "first_low", "LL", "EL")):
        prev = f"last_value(CASE WHEN newly_confirmed_swing_{side} THEN {level} END IGNORE NULLS) OVER ({g} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        types.append(f"CASE WHEN newly_confirmed_swing_{side} THEN CASE WHEN {prev} IS NULL THEN '{first}' WHEN {level} > {prev} THEN '{up}' WHEN {level} < {prev} THEN '{down}' ELSE '{same}' END END AS swing_{side}_type")
    known = []
    for t, side, level in (("HH", "high", "hl"), ("HL", "low", "ll"), ("LH", "high", "hl"), ("LL", "low", "ll")):
        for name, v in (("units", level), ("event_close_micros", "ec"), ("confirm_close_micros", "close_micros"), ("row", "rn")):
            known.append(f"last_value(CASE WHEN swing_{side}_type = '{t}' THEN {v} END IGNORE NULLS) OVER ({g} ROWS UNBOUNDED PRECEDING) AS last_confirmed_{t}_{name}")
        known.append(f"coalesce(swing_{side}_type = '{t}', false) AS newly_confirmed_{t}")
    word = """CASE WHEN hi IS NULL OR lo IS NULL THEN 'unknown,unknown' WHEN hi = 'first_high' OR lo = 'first_low' THEN 'warming_up,unknown' WHEN hi = 'HH' AND lo = 'HL' THEN 'bullish_hh_hl,bullish' WHEN hi = 'LH' AND lo = 'LL' THEN 'bearish_lh_ll,bearish'
  WHEN hi = 'HH' AND lo = 'LL' THEN 'expanding_hh_ll,volatile_expansion' WHEN hi = 'LH' AND lo = 'HL' THEN 'contracting_lh_hl,compression' WHEN hi = 'EH' OR lo = 'EL' THEN 'equal_level_mixed,mixed' ELSE 'mixed,mixed' END"""
    return SWUNG + f""",
e0 AS (SELECT *, {', '.join(types)} FROM w),
e1 AS (SELECT *, last_value(swing_high_type IGNORE NULLS) OVER ({g} ROWS UNBOUNDED PRECEDING) AS hi, last_value(swing_low_type IGNORE NULLS) OVER ({g} ROWS UNBOUNDED PRECEDING) AS lo, {', '.join(known)} FROM e0),
e AS (SELECT *, hi AS last_swing_high_type, lo AS last_swing_low_type, split_part({word}, ',', 1) AS market_structure_sequence, split_part({word}, ',', 2) AS market_structure_bias, {', '.join(f'rn - last_confirmed_{t}_row AS bars_since_last_confirmed_{t}_known' for t in ('HH', 'HL', 'LH', 'LL'))} FROM e1)"""


_pick = lambda cols, at: f" SELECT {', '.join((*KEY, *cols))} FROM {at}"
_c = ", ".join(CANDLE)
PATH = (
    MOVED
    + """,
p0 AS (SELECT *, t - t % 60000000 AS open_micros, CASE WHEN t - delta >= t - t % 60000000 THEN units - before END AS mvd FROM mv),
p1 AS (SELECT *, sum(CASE WHEN mvd <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY generation, open_micros) AS n, CASE WHEN mvd <> 0 THEN sign(mvd) END AS s FROM p0),
p2 AS (SELECT *, CASE WHEN s IS NOT NULL THEN CASE WHEN lag(s) OVER w <> s THEN 1 ELSE 0 END END AS turn, row_number() OVER (PARTITION BY generation, open_micros, s IS NULL ORDER BY t DESC, seq DESC) AS late FROM p1 WINDOW w AS (PARTITION BY generation, open_micros, s IS NULL ORDER BY t, seq)),
p3 AS (SELECT generation, open_micros, arg_min(units, (t, seq)) AS o, arg_max(units, (t, seq)) AS z, max(units) AS h, min(units) AS l, coalesce(sum(abs(mvd)), 0) AS way, count(*) FILTER (WHERE mvd > 0) AS up, count(*) FILTER (WHERE mvd < 0) AS down, count(*) FILTER (WHERE mvd = 0) AS flat,
  coalesce(sum(turn), 0) AS turns, coalesce(avg(CAST(s AS DOUBLE)) FILTER (WHERE s IS NOT NULL AND late <= ceil(n / 3)), 0.0) AS ter FROM p2 GROUP BY 1, 2),
p4 AS (SELECT *, up + down AS n, CASE WHEN up + down > 0 THEN CAST(up - down AS DOUBLE) / (up + down) ELSE 0.0 END AS imb, CASE WHEN up + down > 0 THEN CAST(turns AS DOUBLE) / greatest(up + down - 1, 1) ELSE 0.0 END AS rev,
  CASE WHEN way > 0 THEN CAST(abs(z - o) AS DOUBLE) / way ELSE 0.0 END AS eff, CASE WHEN h > l THEN CAST(z - l AS DOUBLE) / (h - l) ELSE 0.5 END AS pos FROM p3),
p5 AS (SELECT *, CASE WHEN imb >= 0.25 THEN 'pressure_up' WHEN imb <= -0.25 THEN 'pressure_down' ELSE 'neutral' END AS pr, CASE WHEN ter >= 0.34 THEN 'pressure_up' WHEN ter <= -0.34 THEN 'pressure_down' ELSE 'neutral' END AS tp FROM p4),
p6 AS (SELECT *, CASE WHEN pr = 'pressure_up' AND pos <= 0.45 THEN 'failed_up' WHEN pr = 'pressure_down' AND pos >= 0.55 THEN 'failed_down' ELSE 'none' END AS fp FROM p5)
SELECT generation, open_micros, n >= 3 AS tick_path_ready, n AS tick_path_directional_move_count, up AS tick_path_uptick_count, down AS tick_path_downtick_count, flat AS tick_path_flat_count, CAST(turns AS BIGINT) AS tick_path_direction_change_count, CAST(ceil(n / 3) AS BIGINT) AS tick_path_terminal_move_count,
  round(imb, 6) AS tick_path_signed_imbalance, round(rev, 6) AS tick_path_reversal_rate, round(eff, 6) AS tick_path_efficiency, round(ter, 6) AS tick_path_terminal_signed_imbalance, round(pos, 6) AS tick_path_close_position,
  CASE WHEN n < 3 THEN 'insufficient_tick_path' ELSE pr END AS tick_path_pressure_bucket, CASE WHEN n < 3 THEN 'insufficient_tick_path' WHEN ((pr = 'pressure_up' AND pos >= 0.6) OR (pr = 'pressure_down' AND pos <= 0.4)) AND eff >= 0.35 AND rev <= 0.45 THEN 'clean_push' WHEN fp <> 'none' THEN 'failed_push' WHEN rev >= 0.6 OR eff <= 0.25 THEN 'churn' ELSE 'mixed' END AS tick_path_shape_bucket,
  CASE WHEN n < 3 THEN 'insufficient_tick_path' ELSE tp END AS tick_path_terminal_pressure_bucket, CASE WHEN n < 3 THEN 'insufficient_tick_path' ELSE fp END AS tick_path_failed_pressure_direction,
  CASE WHEN n < 3 THEN 'insufficient_tick_path' WHEN eff >= 0.65 THEN 'high' WHEN eff >= 0.35 THEN 'medium' ELSE 'low' END AS tick_path_efficiency_bucket, CASE WHEN n < 3 THEN 'insufficient_tick_path' WHEN rev >= 0.6 THEN 'high' WHEN rev <= 0.45 THEN 'low' ELSE 'medium' END AS tick_path_reversal_bucket FROM p6"""
)

def _state_sql() -> str:
    """The recurrences row by row: moving averages begin anew in each segment, legs and breakouts are carried through a generation."""

    def step(v: dict[str, str]) -> str:
        """The state after row `s`, from the values before it."""
        moving = "s.ds IN ('up', 'down')"
        emas = [f"CASE WHEN {v['sg']} IS NULL OR {v['sg']} <> s.sg THEN s.z ELSE {2.0 / (p + 1)!r} * s.z + {1.0 - 2.0 / (p + 1)!r} * {v[f'e{p}']} END AS e{p}" for p in (20, 50)]
        steps = [f"CASE WHEN {v['sg']} = s.sg AND {v[f'e{p}']} <> 0 THEN ({2.0 / (p + 1)!r} * s.z + {1.0 - 2.0 / (p + 1)!r} * {v[f'e{p}']} - {v[f'e{p}']}) / {v[f'e{p}']} * 10000 END AS st{p}" for p in (20, 50)]
        live = f"{v['ad']} IS NOT NULL AND s.rn - {v['ar']} <= 5"
        failed = f"({live} AND s.rn > {v['ar']} AND (({v['ad']} = 'up' AND s.z < {v['al']}) OR ({v['ad']} = 'down' AND s.z > {v['al']})))"
        kept = f"({live} AND NOT {failed})"
        now = f"CASE WHEN s.bu THEN 'up' ELSE {v['tr']} END"
        active = lambda down, up, old, none: f"CASE WHEN s.bd THEN {down} WHEN s.bu THEN {up} WHEN {kept} THEN {old} ELSE {none} END"
        return ", ".join([
            "s.generation", "s.ordinal", "s.rn", "s.sg", *emas, *steps,
            f"coalesce({v['leg']} IN ('up', 'down') AND {v['age']} >= 2 AND s.dir IN ('up', 'down') AND s.dir <> {v['leg']}, false) AS pb",
            f"CASE WHEN {moving} THEN s.ds WHEN {v['still']} + 1 >= 3 THEN 'none' ELSE {v['leg']} END AS leg",
            f"CASE WHEN {moving} THEN CASE WHEN s.ds = {v['leg']} THEN {v['age']} + 1 ELSE 1 END WHEN {v['still']} + 1 >= 3 THEN 0 ELSE {v['age']} END AS age",
            f"CASE WHEN {moving} THEN 0 ELSE {v['still']} + 1 END AS still",
            f"coalesce({failed} AND {v['ad']} = 'up', false) AS fu", f"coalesce({failed} AND {v['ad']} = 'down', false) AS fd", f"CASE WHEN {failed} THEN CAST({v['al']} AS BIGINT) END AS fl", f"CASE WHEN {failed} THEN {v['ac']} END AS fc",
            f"(s.bu AND {v['tr']} IN ('none', 'up')) OR (s.bd AND {now} IN ('none', 'down')) AS bos", f"(s.bu AND {v['tr']} NOT IN ('none', 'up')) OR (s.bd AND {now} NOT IN ('none', 'down')) AS coc",
            active("'down'", "'up'", v["ad"], "CAST(NULL AS VARCHAR)") + " AS ad", active("s.lu", "s.hu", v["al"], "CAST(NULL AS DOUBLE)") + " AS al", active("s.rn", "s.rn", v["ar"], "CAST(NULL AS BIGINT)") + " AS ar", active("s.cm", "s.cm", v["ac"], "CAST(NULL AS BIGINT)") + " AS ac",
            f"CASE WHEN s.bd THEN 'down' WHEN s.bu THEN 'up' ELSE {v['tr']} END AS tr",
        ])

    first = {"sg": "CAST(NULL AS BIGINT)", "e20": "0.0", "e50": "0.0", "leg": "'none'", "age": "CAST(0 AS BIGINT)", "still": "CAST(0 AS BIGINT)", "ad": "CAST(NULL AS VARCHAR)", "al": "CAST(NULL AS DOUBLE)", "ar": "CAST(NULL AS BIGINT)", "ac": "CAST(NULL AS BIGINT)", "tr": "'none'"}
    return f""",
src AS MATERIALIZED (SELECT q.generation, q.ordinal, w.rn, seg.clean_segment_index AS sg, CAST(q.z AS DOUBLE) AS z, q.close_micros AS cm, q.candle_direction AS dir, q.directional_state AS ds, w.breakout_up AS bu, w.breakout_down AS bd, CAST(w.last_swing_high_units AS DOUBLE) AS hu, CAST(w.last_swing_low_units AS DOUBLE) AS lu
  FROM q JOIN w ON w.generation = q.generation AND w.ordinal = q.ordinal JOIN seg ON seg.generation = q.generation AND seg.ordinal = q.ordinal),
rec AS (SELECT {step(first)} FROM src s WHERE s.rn = 0 UNION ALL SELECT {step({k: f"r.{k}" for k in first})} FROM rec r JOIN src s ON s.generation = r.generation AND s.rn = r.rn + 1)"""


def _features_sql() -> str:
    """All stages in one: `ft` has every output of every clean candle."""
    path, last = PATH.split("\nSELECT generation, open_micros, n >= 3")
    parts = [CLEAN.replace("\nk AS (", "\nk AS MATERIALIZED (") + path[len(MOVED) :] + ",\npth AS (SELECT generation, open_micros, n >= 3" + last + ")"]
    parts += [ADJACENT[len(CLEAN) :], ROLLED[len(CLEAN) :], _statistics_sql()[len(ROLLED) :], SHAPED[len(ADJACENT) :], _sequence_sql()[len(CLEAN) :], _state_sql()]
    path_columns = [o.name for o in catalog.catalog() if o.stage == "tick_path"]
    picked = [*[f"q.{c}" for c in ROLLING], *[f"seg.{c}" for c in ADJACENCY], *[f"s.{c}" for c in STATISTICS], *[f"sh.{c}" for c in SHAPE], *[f"e.{c}" for c in (*SWINGS, *SEQUENCE)], *[f"pth.{c}" for c in path_columns]]
    state = ["rec.rn", "rec.e20", "rec.e50", "rec.st20", "rec.st50", "rec.fl", "rec.fc", *[f"rec.{a} AS {b}" for a, b in (("leg", "trend_leg_direction"), ("age", "trend_leg_age_candles"), ("pb", "pullback_against_trend"), ("fu", "failed_breakout_up"), ("fd", "failed_breakout_down"), ("bos", "break_of_structure"), ("coc", "change_of_character"))]]
    on = lambda a: f"{a}.generation = k.generation AND {a}.ordinal = k.ordinal"
    parts.append(f""",
f0 AS (SELECT k.*, {", ".join(picked)}, {", ".join(state)}, e.hl, e.ll, e.ec, lag(k.ordinal, 2) OVER (PARTITION BY k.generation ORDER BY k.ordinal) AS eo
  FROM k JOIN q ON {on("q")} JOIN seg ON {on("seg")} JOIN s ON {on("s")} JOIN sh ON {on("sh")} JOIN e ON {on("e")} JOIN rec ON {on("rec")} LEFT JOIN pth ON pth.generation = k.generation AND pth.open_micros = k.open_micros)""")
    five = lambda v, ready, name: f"CASE WHEN NOT ({ready}) OR {v} IS NULL THEN 'not_ready' WHEN {v} >= 5 THEN '{name}strong_up' WHEN {v} >= 1 THEN '{name}mild_up' WHEN {v} <= -5 THEN '{name}strong_down' WHEN {v} <= -1 THEN '{name}mild_down' ELSE '{name}flat' END"
    emas = []
    for p in (20, 50):
        ready, away = f"clean_segment_candle_index + 1 >= {p}", f"((z - e{p}) / nullif(e{p}, 0) * 10000)"
        emas.append(f"round(e{p}, 6) AS ema{p}, {ready} AS is_ema{p}_ready, round({away}, 6) AS close_vs_ema{p}_bps, z >= e{p} AS is_close_above_ema{p}, round(st{p}, 6) AS ema{p}_slope_bps, {five(f'st{p}', ready, 'ema_slope_')} AS ema{p}_slope_state, {five(away, ready, 'close_vs_ema_')} AS close_vs_ema{p}_state")
    apart = "((e20 - e50) / nullif(e50, 0) * 10000)"
    emas.append(f"round({apart}, 6) AS ema20_minus_ema50_bps, e20 >= e50 AS is_ema20_above_ema50, {five(apart, 'clean_segment_candle_index + 1 >= 50', 'ema20_vs_ema50_')} AS ema20_ema50_alignment_state")
    turn = "CASE WHEN break_of_structure THEN 'break_of_structure' ELSE 'change_of_character' END"
    tokens = ["CASE WHEN newly_confirmed_swing_high THEN 'swing_high:up' END", "CASE WHEN newly_confirmed_swing_low THEN 'swing_low:down' END", "CASE WHEN failed_breakout_up THEN 'failed_breakout:up' END", "CASE WHEN failed_breakout_down THEN 'failed_breakout:down' END"]
    for side, back, out in (("high", "down", "up"), ("low", "up", "down")):
        tokens += [f"CASE WHEN sweep_reject_{side} THEN 'sweep_reject_{side}:{back}' END", f"CASE WHEN breakout_{out} THEN 'breakout:{out}' END", f"CASE WHEN breakout_{out} THEN {turn} || ':{out}' END"]
    parts.append(f""",
f1 AS (SELECT *, {", ".join(emas)}, low_activity AS low_tick_volume, hard_low_activity AS hard_low_tick_volume, gap_inside AS has_internal_gap, gap_before AS starts_after_gap, gap_before_micros AS starts_after_gap_micros, missing_buckets_before AS missing_buckets_since_prev_candle,
  max_gap_inside_micros AS max_internal_gap_micros, frozen AS frozen_price_flag, frozen_observations AS max_same_price_run_ticks, frozen_micros AS max_same_price_run_micros, jump AS has_true_tick_jump, delayed_jump AS has_feed_delay_jump, reopen_jump AS has_gap_reopen_jump,
  CASE WHEN failed_breakout_up OR failed_breakout_down THEN 'failed_breakout' WHEN sweep_reject_high OR sweep_reject_low THEN 'sweep_reject' WHEN breakout_up OR breakout_down THEN 'breakout' WHEN range_like THEN 'range' WHEN compression_state = 'compressed' THEN 'compression'
    WHEN directional_state = 'up' THEN 'trend_up' WHEN directional_state = 'down' THEN 'trend_down' ELSE 'neutral' END AS structure_state,
  concat_ws('|', {", ".join(tokens)}) AS current_event_types, market_structure_bias AS regime_structure_state,
  CAST(directional_state = 'up' AS INT) + CAST(trend_leg_direction = 'up' AS INT) + CAST(market_structure_bias = 'bullish' AS INT) AS n_up, CAST(directional_state = 'down' AS INT) + CAST(trend_leg_direction = 'down' AS INT) + CAST(market_structure_bias = 'bearish' AS INT) AS n_down,
  coalesce(greatest(directional_efficiency_10, directional_efficiency_20), 0.0) AS eff,
  CASE WHEN range_to_avg20 IS NULL THEN 'unknown' WHEN range_to_avg20 < 0.6 THEN 'quiet' WHEN range_to_avg20 <= 1.8 THEN 'normal' WHEN range_to_avg20 <= 2.5 THEN 'expanded' ELSE 'extreme' END AS regime_volatility_state,
  CASE WHEN failed_breakout_up THEN 'failed_breakout_up' WHEN failed_breakout_down THEN 'failed_breakout_down' WHEN sweep_reject_high THEN 'sweep_high' WHEN sweep_reject_low THEN 'sweep_low' WHEN change_of_character AND breakout_up THEN 'coch_up' WHEN change_of_character AND breakout_down THEN 'coch_down'
    WHEN breakout_up THEN 'bos_up' WHEN breakout_down THEN 'bos_down' ELSE 'none' END AS regime_transition_state,
  CASE WHEN frozen OR jump OR reopen_jump THEN 'frozen_or_dirty' WHEN has_gap OR delayed_jump OR max_abs_tick_jump_bps > 5 THEN 'gap_or_jump' WHEN low_activity OR hard_low_activity THEN 'low_volume' ELSE 'clean' END AS regime_quality_state FROM f0),
f2 AS (SELECT *, CASE WHEN current_event_types <> '' THEN close_micros END AS current_event_close_micros, CASE WHEN compression_state = 'compressed' THEN 'compression' WHEN range_like OR directional_state = 'sideways' THEN 'range' WHEN n_up + n_down = 0 THEN 'neutral'
    WHEN n_up > n_down AND (eff >= 0.35 OR n_up >= 2) THEN 'trend_up' WHEN n_down > n_up AND (eff >= 0.35 OR n_down >= 2) THEN 'trend_down' ELSE 'neutral' END AS regime_trend_state FROM f1),
ft AS (SELECT *, CASE WHEN regime_trend_state = 'trend_up' OR regime_structure_state = 'bullish' OR regime_transition_state IN ('bos_up', 'coch_up', 'sweep_low', 'failed_breakout_down') THEN 'buy_bias'
    WHEN regime_trend_state = 'trend_down' OR regime_structure_state = 'bearish' OR regime_transition_state IN ('bos_down', 'coch_down', 'sweep_high', 'failed_breakout_up') THEN 'sell_bias'
    WHEN regime_trend_state IN ('range', 'compression') OR regime_structure_state IN ('compression', 'mixed', 'volatile_expansion') THEN 'two_sided_or_no_bias' ELSE 'neutral' END AS regime_directional_bias,
  concat_ws('|', regime_trend_state, regime_volatility_state, regime_structure_state, regime_transition_state, regime_quality_state) AS regime_v1, regime_quality_state = 'clean' AS is_regime_clean,
  regime_trend_state IN ('trend_up', 'trend_down') AS is_regime_trending, regime_trend_state = 'range' AS is_regime_ranging, regime_transition_state <> 'none' AS is_regime_transition FROM f2)""")
    return "WITH RECURSIVE " + "".join(parts).lstrip()


FEATURES = _features_sql()


def _structure_event_sql() -> str:
    own, swing = "close_micros, close_micros, known_at_micros, rn, rn, ordinal, ordinal", "ec, close_micros, known_at_micros, rn - 2, rn, eo, ordinal"
    turn = "CASE WHEN break_of_structure THEN 'break_of_structure' ELSE 'change_of_character' END"
    rows = [("newly_confirmed_swing_high", "'swing_high'", "up", swing, "hl, hl, 'strict_left_right', NULL"), ("newly_confirmed_swing_low", "'swing_low'", "down", swing, "ll, ll, 'strict_left_right', NULL")]
    rows += [(f"failed_breakout_{d}", "'failed_breakout'", d, own, "z, fl, 'active_breakout', fc") for d in ("up", "down")]
    for side, back, out in (("high", "down", "up"), ("low", "up", "down")):
        held = f"z, last_swing_{side}_units, 'last_swing_{side}', last_swing_{side}_event_close_micros"
        rows += [(f"sweep_reject_{side}", f"'sweep_reject_{side}'", back, own, held), (f"breakout_{out}", "'breakout'", out, own, held), (f"breakout_{out}", turn, out, own, held)]
    union = " UNION ALL ".join(f"SELECT generation, rn, {k}, {kind}, '{d}', {at}, {held} FROM ft WHERE {where}" for k, (where, kind, d, at, held) in enumerate(rows))
    return FEATURES + f", ev(generation, at_row, place, {', '.join(fe.STRUCTURE_EVENT[1:])}) AS ({union}) SELECT generation, row_number() OVER (PARTITION BY generation ORDER BY at_row, place) AS event_id, {', '.join(fe.STRUCTURE_EVENT[1:])} FROM ev"


def _sequence_event_sql() -> str:
    g = "PARTITION BY generation ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    last = lambda side, v: f"last_value(CASE WHEN newly_confirmed_swing_{side} THEN {v} END IGNORE NULLS) OVER ({g})"
    lags = ", ".join(f"{last(side, v)} AS {side}_{name}" for side, level in (("high", "hl"), ("low", "ll")) for name, v in (("p", level), ("e", "ec"), ("c", "close_micros")))
    one = lambda k, side, level: f"SELECT generation, rn, {k} AS place, rn AS \"row\", ordinal AS candle_ordinal, close_micros AS decision_close_micros, known_at_micros, 'swing_{side}' AS swing_event_type, swing_{side}_type AS swing_type, {level} AS swing_price_units, ec AS swing_event_close_micros, close_micros AS swing_confirm_close_micros, {side}_p AS previous_price_units, {side}_e AS previous_event_close_micros, {side}_c AS previous_confirm_close_micros, market_structure_sequence AS sequence_after, market_structure_bias AS bias_after FROM lg WHERE newly_confirmed_swing_{side}"
    return f"WITH {_sequence_sql()}, lg AS (SELECT *, {lags} FROM e), ev AS ({one(0, 'high', 'hl')} UNION ALL {one(1, 'low', 'll')}) SELECT generation, row_number() OVER (PARTITION BY generation ORDER BY rn, place) AS event_id, \"row\", {', '.join(fe.SEQUENCE_EVENT[2:])} FROM ev"


def bin_sql(c: str, value: str) -> str:
    """The fixed bin of an expression, as NAME_bucketed."""
    e = encodings.BINS[c]
    text = " ".join(f"WHEN {value} <= {b} THEN '{encodings.general(a)}_to_{encodings.general(b)}'" if b != encodings.INF else f"ELSE '{encodings.general(a)}_to_{encodings.general(b)}'" for a, b in zip(e, e[1:]))
    low = "" if e[0] == -encodings.INF else f" OR {value} < {e[0]}"
    return f"CASE WHEN {value} IS NULL{low} THEN NULL {text} END AS {c}_bucketed"


ORACLES = {
    "ticks_accepted": f"WITH {ACCEPTED} SELECT * FROM acc",
    "tick_rejects": f"WITH {ACCEPTED} SELECT generation, reason, count(*) AS n, min(seq) AS first_seq FROM r4 WHERE reason IS NOT NULL GROUP BY 1, 2",
    "stream_audit": f"WITH {ACCEPTED} SELECT generation, count(*) AS n_records, count(*) FILTER (WHERE reason IS NULL) AS n_accepted, " + ", ".join(f"count(*) FILTER (WHERE reason = '{r}') AS n_{r}" for r in st.REJECTS) + ", min(CASE WHEN reason IS NULL THEN t END) AS first_micros, max(CASE WHEN reason IS NULL THEN t END) AS last_micros, count(DISTINCT CASE WHEN reason IS NULL THEN t // 86400000000 END) AS n_days FROM r4 GROUP BY 1",
    "tick_moves": f"WITH {MOVED} SELECT generation, seq, t, delta, duplicate, context, bps, run FROM mv",
    "quote_deltas": f"WITH {MOVED} SELECT generation, t, seq, CASE WHEN delta <= 30000000 THEN units - before END AS quote_delta_units FROM mv WHERE NOT duplicate",
    "candles_tumbling": f"WITH {MOVED}{candle_sql()} SELECT {_c} FROM c",
    "candles_offset_grid": f"WITH {MOVED}{candle_sql(300, 120)} SELECT {_c} FROM c",
    "candles_multi_stream": f"WITH {MOVED}{candle_sql(60, 0, 'ca')}{candle_sql(300, 0, 'cb')}{candle_sql(900, 0, 'cc')} " + " UNION ALL ".join(f"SELECT CAST({s} AS INT) AS duration_seconds, generation, open_micros, open_units, high_units, low_units, close_units, observations FROM {n}" for s, n in ((60, "ca"), (300, "cb"), (900, "cc"))),
    "candle_flags": f"WITH {MOVED}{candle_sql()} SELECT generation, open_micros, {', '.join(st.FLAGS)} FROM c",
    "candle_flag_counts": f"WITH {MOVED}{candle_sql()} SELECT generation, count(*) AS candles, {', '.join(f'count(*) FILTER (WHERE {f}) AS {f}' for f in st.FLAGS)} FROM c GROUP BY 1",
    "candles_withheld_tail": f"WITH {ACCEPTED}, b AS (SELECT generation, t - t % 60000000 AS open_micros, count(*) AS n FROM acc GROUP BY 1, 2) SELECT generation, max(open_micros) AS open_micros, arg_max(n, open_micros) AS n FROM b GROUP BY 1",
    "candles_from_bars": """
WITH b AS (SELECT generation, epoch_us(open_time_micros) AS t, epoch_us(open_time_micros) - epoch_us(open_time_micros) % 300000000 AS bucket, open_units, high_units, low_units, close_units, volume FROM candles),
f AS (SELECT generation, bucket, arg_min(open_units, (t, open_units, close_units, high_units, low_units)) AS open_units, max(high_units) AS high_units, min(low_units) AS low_units, arg_max(close_units, (t, open_units, close_units, high_units, low_units)) AS close_units, count(*) AS observations, round(sum(volume), 3) AS volume, max(t) + 60000000 AS done FROM b GROUP BY 1, 2),
n AS (SELECT *, lead(bucket) OVER (PARTITION BY generation ORDER BY bucket) AS later FROM f)
SELECT generation, bucket AS open_micros, open_units, high_units, low_units, close_units, observations, volume FROM n WHERE done >= bucket + 300000000 OR later IS NOT NULL""",
    "profile_gap_facts": f"WITH {MOVED} SELECT generation, count(delta) AS n_gaps, min(delta) AS min_gap, max(delta) AS max_gap, quantile_cont(delta, 0.5) AS median_gap FROM mv WHERE delta IS NOT NULL GROUP BY 1",
    "profile_cadence_histogram": f"WITH {MOVED} SELECT generation, CAST(CASE WHEN delta = 0 THEN 0 ELSE length(bin(delta)) END AS INT) AS bucket, count(*) AS n FROM mv WHERE delta >= 0 GROUP BY 1, 2",
    "profile_jump_histogram": f"WITH {MOVED} SELECT generation, context, CAST(CASE WHEN bps = 0 THEN 0 ELSE length(bin(bps)) END AS INT) AS bucket, count(*) AS n FROM mv WHERE bps >= 0 GROUP BY 1, 2, 3",
    "profile_price_facts": f"WITH {MOVED}, s AS (SELECT DISTINCT generation, abs(units - before) AS step FROM mv WHERE before <> units), g AS (SELECT generation, list_reduce(list(step), lambda a, b: gcd(a, b)) AS step_units FROM s GROUP BY 1), n AS (SELECT generation, min(units) AS min_units, max(units) AS max_units, count(*) FILTER (WHERE before <> units) AS n_moves FROM mv GROUP BY 1) SELECT n.generation, min_units, max_units, n_moves, step_units FROM n LEFT JOIN g ON n.generation = g.generation",
    "profile_runs": f"WITH {MOVED}, r AS (SELECT generation, run, count(*) AS n, max(t) - min(t) AS span FROM mv GROUP BY 1, 2) SELECT generation, count(*) AS n_runs, max(n) AS longest, max(span) AS longest_micros FROM r GROUP BY 1",
    "tick_path": f"WITH {PATH}",
    "anatomy": f"WITH {CLEAN}" + _pick((*QUALITY, *ANATOMY, *CALENDAR), "k"),
    "adjacency": f"WITH {ADJACENT}" + _pick(ADJACENCY, "seg"),
    "rolling_features": f"WITH {ROLLED}" + _pick(ROLLING, "q"),
    "rolling_statistics": f"WITH {_statistics_sql()}" + _pick(STATISTICS, "s"),
    "candle_shape": f"WITH {SHAPED}" + _pick(SHAPE, "sh"),
    "swing_structure": f"WITH {SWUNG}" + _pick(SWINGS, "w"),
    "swing_sequence": f"WITH {_sequence_sql()}" + _pick(SEQUENCE, "e"),
    "moving_averages": FEATURES + _pick(EMA, "ft"),
    "structure_state": FEATURES + _pick(STATE, "ft"),
    "regime": FEATURES + _pick(REGIME, "ft"),
    "structure_events": _structure_event_sql(),
    "sequence_events": _sequence_event_sql(),
    "feature_rows_all": FEATURES + f" SELECT generation, {', '.join(o.name for o in catalog.catalog())} FROM ft",
    "feature_bins": FEATURES + f" SELECT generation, ordinal, {', '.join(bin_sql(c, f'({c} / 1000.0)' if c.endswith('_micros') else c) for c in encodings.BINS)} FROM ft",
    "profile_documents": f"""WITH {MOVED}{candle_sql()},
steps AS (SELECT DISTINCT generation, abs(units - before) AS step FROM mv WHERE before <> units), gc AS (SELECT generation, list_reduce(list(step), lambda a, b: gcd(a, b)) AS step_units FROM steps GROUP BY 1),
pr AS (SELECT generation, min(units) AS lo, max(units) AS hi, count(*) FILTER (WHERE before <> units) AS n FROM mv GROUP BY 1), gp AS (SELECT generation, count(delta) AS n, min(delta) AS lo, max(delta) AS hi, quantile_cont(delta, 0.5) AS med FROM mv WHERE delta IS NOT NULL GROUP BY 1),
rr AS (SELECT generation, run, count(*) AS n, max(t) - min(t) AS span FROM mv GROUP BY 1, 2), ru AS (SELECT generation, count(*) AS n, max(n) AS longest, max(span) AS long_micros FROM rr GROUP BY 1), fl AS (SELECT generation, count(*) AS candles, {", ".join(f"count(*) FILTER (WHERE {f}) AS {f}" for f in st.FLAGS)} FROM c GROUP BY 1)
SELECT pr.generation, pr.lo AS min_units, pr.hi AS max_units, pr.n AS n_moves, step_units, gp.n AS n_gaps, gp.lo AS min_gap, gp.hi AS max_gap, gp.med AS median_gap, ru.n AS n_runs, longest, long_micros AS longest_micros, candles, {", ".join(st.FLAGS)}
FROM pr LEFT JOIN gc USING (generation) LEFT JOIN gp USING (generation) LEFT JOIN ru USING (generation) LEFT JOIN fl USING (generation)""",
}
