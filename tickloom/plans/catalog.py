"""The catalog of feature outputs: stage, kind of use and what each needs; plans that select from it and stay as they are."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import SETTINGS, Settings
from ..operators.stream import CHECKS, Checks


@dataclass(frozen=True)
class Output:
    name: str
    stage: str
    meta: bool
    needs: tuple[str, ...]


#: Labels of outputs that aren't ready yet; a condition on one never holds.
UNREADY = ("unknown", "warming_up", "unknown_warmup", "not_ready", "insufficient_tick_path")


def _names(text: str) -> list[str]:
    return text.split()


def catalog(s: Settings = SETTINGS) -> list[Output]:
    """Every output of features(), in stage order. meta outputs are keys, clocks and levels, which are never encoded."""
    w, p, types, sides = s.windows, s.periods, ("HH", "HL", "LH", "LL"), ("high", "low")
    path = "tick_path_"
    out: list[Output] = []

    def add(stage: str, names: list[str], *needs: str, meta: bool = False) -> None:
        out.extend(Output(n, stage, meta, needs) for n in names)

    add("candle", _names("open_micros close_micros known_at_micros first_event_micros last_event_micros ordinal open_units high_units low_units close_units"), meta=True)
    add("candle", _names("tick_volume starts_after_gap_micros starts_after_gap_class max_internal_gap_micros max_gap_micros worst_gap_class max_same_price_run_ticks max_same_price_run_micros max_abs_tick_jump_bps"), "ticks")
    add("candle", _names("active_span_micros missing_buckets_since_prev_candle quality_tier"))
    add("candle", _names("complete"), "ticks", "gap", "hard_min")
    add("candle", _names("low_tick_volume"), "ticks", "min")
    add("candle", _names("hard_low_tick_volume"), "ticks", "hard_min")
    add("candle", _names("has_gap has_internal_gap starts_after_gap max_true_tick_jump_bps max_gap_reopen_jump_bps"), "ticks", "gap")
    add("candle", _names("frozen_price_flag"), "ticks", "frozen")
    add("candle", _names("has_true_tick_jump"), "ticks", "jump")
    add("candle", _names("has_feed_delay_jump has_gap_reopen_jump"), "ticks", "jump", "gap")
    add("tick_path", [path + n for n in _names("ready directional_move_count uptick_count downtick_count flat_count direction_change_count signed_imbalance reversal_rate efficiency terminal_move_count terminal_signed_imbalance close_position pressure_bucket shape_bucket terminal_pressure_bucket failed_pressure_direction efficiency_bucket reversal_bucket")], "ticks")
    add("anatomy", _names("body_units range_units upper_wick_units lower_wick_units"), meta=True)
    add("anatomy", _names("candle_direction body_bps range_bps upper_wick_bps lower_wick_bps close_position body_to_range upper_wick_to_range lower_wick_to_range range_overlap candle_pattern"))
    add("rolling", ["return_1_bps", "directional_state", "trend_leg_direction", "trend_leg_age_candles", "pullback_against_trend"])
    for n in w:
        need = f"window_{n}"
        add("rolling", [f"return_std_{n}_bps", f"up_move_ratio_{n}", f"range_position_{n}", f"momentum_{n}_bps", f"directional_efficiency_{n}", f"abs_return_mean_{n}_bps", f"range_mean_{n}_bps", f"tick_volume_mean_{n}"], need)
        add("rolling", [f"return_skew_{n}", f"trend_r2_{n}", f"trend_residual_{n}_bps"] if n >= 3 else [], need)
        add("rolling", [f"return_kurtosis_{n}", f"return_autocorr_{n}", f"sign_reversal_rate_{n}"] if n >= 4 else [], need)
    add("rolling", _names("range_to_avg20 compression_state range_like"), "window_5", "window_20")
    for side in sides:
        add("structure", [f"last_swing_{side}_{x}" for x in ("units", "event_close_micros", "confirm_close_micros")], meta=True)
        add("structure", [f"bars_since_last_swing_{side}_known", f"distance_to_last_swing_{side}_bps", f"newly_confirmed_swing_{side}", f"sweep_reject_{side}"])
    add("structure", _names("breakout_up breakout_down failed_breakout_up failed_breakout_down break_of_structure change_of_character current_event_types"))
    add("structure", ["structure_state"], "window_5", "window_20")
    add("structure", ["current_event_close_micros"], meta=True)
    add("sequence", [f"{x}swing_{side}_type" for x in ("", "last_") for side in sides] + [f"newly_confirmed_{t}" for t in types] + [f"bars_since_last_confirmed_{t}_known" for t in types] + ["market_structure_sequence", "market_structure_bias"])
    add("sequence", [f"last_confirmed_{t}_{x}" for t in types for x in ("units", "event_close_micros", "confirm_close_micros")], meta=True)
    add("shape", _names("clean_segment_index clean_segment_candle_index prior_clean_history_count"), meta=True)
    add("shape", _names("has_adjacent_previous_clean_candle previous_candle_relation candle_color candle_type range_bps_bucket body_bps_bucket range_vs_recent_ratio body_vs_recent_ratio range_vs_recent_bucket body_vs_recent_bucket upper_wick_size_bucket lower_wick_size_bucket wick_profile close_location_bucket body_dominance is_doji is_strong_body is_pin_bar is_hammer_like is_shooting_star_like is_inside_bar is_outside_bar is_expansion_candle is_compression_candle"))
    add("shape", _names("tick_volume_vs_recent_ratio tick_volume_vs_recent_bucket"), "ticks")
    for n in p:
        add("moving_average", [f"ema{n}", f"is_ema{n}_ready", f"close_vs_ema{n}_bps", f"is_close_above_ema{n}", f"ema{n}_slope_bps", f"ema{n}_slope_state", f"close_vs_ema{n}_state"], f"period_{n}")
    add("moving_average", _names("ema20_minus_ema50_bps is_ema20_above_ema50 ema20_ema50_alignment_state"), "period_20", "period_50")
    add("regime", _names("regime_trend_state regime_directional_bias is_regime_trending is_regime_ranging"), "window_5", "window_10", "window_20")
    add("regime", _names("regime_volatility_state"), "window_5", "window_20")
    add("regime", _names("regime_structure_state regime_transition_state is_regime_transition"))
    add("regime", _names("regime_quality_state is_regime_clean"), "ticks", "gap", "frozen", "jump", "min", "hard_min")
    add("regime", _names("regime_v1"), "ticks", "gap", "frozen", "jump", "min", "hard_min", "window_5", "window_10", "window_20")
    add("calendar", _names("utc_day_of_week utc_hour utc_session_6h"), meta=True)
    return out


def available(s: Settings = SETTINGS, checks: Checks = CHECKS, ticks: bool = True) -> set[str]:
    """What the settings, the checks and the kind of source provide."""
    have = {f"window_{n}" for n in s.windows} | {f"period_{n}" for n in s.periods} | ({"ticks"} if ticks else set())
    on = {"min": checks.min_observations, "hard_min": checks.hard_min_observations, "gap": checks.gap_max, "frozen": checks.frozen_observations, "jump": checks.jump_bps}
    return have | {k for k, v in on.items() if v is not None}


@dataclass(frozen=True)
class Plan:
    """Selected outputs in catalog order, and why others are left out."""

    outputs: tuple[str, ...]
    excluded: tuple[tuple[str, str], ...]

    def document(self) -> str:
        return json.dumps({"outputs": self.outputs, "excluded": self.excluded}, sort_keys=True)

    def identity(self) -> str:
        return hashlib.sha256(self.document().encode()).hexdigest()

    def apply(self, features: DataFrame) -> DataFrame:
        """The plan's columns after generation; Spark prunes every stage that none of them needs."""
        return features.select("generation", *[c for c in self.outputs if c != "generation"])


def resolve(names: list[str] | None = None, s: Settings = SETTINGS, checks: Checks = CHECKS, ticks: bool = True) -> Plan:
    """All supported outputs, or the named ones. A named output that is unknown or lacks what it needs is an error; of all, it is left out with the reason."""
    have, known = available(s, checks, ticks), catalog(s)
    lacks = {o.name: "needs " + ", ".join(n for n in o.needs if n not in have) for o in known if not set(o.needs) <= have}
    if names is None:
        return Plan(tuple(o.name for o in known if o.name not in lacks), tuple(sorted(lacks.items())))
    bad = {n: lacks.get(n, "unknown output") for n in names if n in lacks or n not in {o.name for o in known}}
    if bad:
        raise ValueError("; ".join(f"{n}: {why}" for n, why in sorted(bad.items())))
    chosen = set(names)
    return Plan(tuple(o.name for o in known if o.name in chosen), ())


def load(document: str) -> Plan:
    d = json.loads(document)
    return Plan(tuple(d["outputs"]), tuple(map(tuple, d["excluded"])))


def holds(column: str, comparator: str, threshold: str | float | bool):
    """A condition on an output: false where the output is null, not ready or of another kind than the threshold."""
    c = F.col(column)
    ops = {"eq": c == F.lit(threshold), "ne": c != F.lit(threshold)}
    if not isinstance(threshold, (str, bool)):
        ops |= {"lt": c < threshold, "le": c <= threshold, "gt": c > threshold, "ge": c >= threshold}
    ready = ~c.isin(*UNREADY) if isinstance(threshold, str) else F.lit(True)
    return F.coalesce(ops[comparator] & ready, F.lit(False))
