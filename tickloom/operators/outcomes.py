"""Forward-only labels: the first tick after a decision, and the first at each expiry after that."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof
from .shards import running
from .stream import MICRO, SHARD_MICROS, E

#: Reasons of an outcome, by code.
REASONS = ("valid", "no_entry", "stale_entry", "no_settlement", "stale_settlement", "internal_gap", "frozen_run", "true_jump")


@dataclass(frozen=True)
class Rule:
    expiries: tuple[int, ...] = (30, 60, 120)
    entry_delay: int = 20 * MICRO
    settlement_delay: int = 20 * MICRO
    gap_max: int | None = 60 * MICRO
    jump_bps: int | None = 60
    jump_gap_max: int = 30 * MICRO
    frozen_ticks: int | None = 12
    frozen_micros: int = 180 * MICRO


RULE = Rule()


def marked(moved: DataFrame, rule: Rule = RULE) -> DataFrame:
    """One row per distinct instant of a stream: generation, t, seq, units, and how many gaps, jumps and frozen ticks there were up to it (frozen_before: up to the tick before)."""
    none = F.lit(False)
    no = lambda c: F.coalesce(c, none)
    run = Window.partitionBy(E, "run")
    gap = no(F.col("delta") > rule.gap_max) if rule.gap_max is not None else none
    jump = no((F.col("delta") <= rule.jump_gap_max) & (F.col("before") != 0) & (F.abs(F.col("units") - F.col("before")) * 10_000 >= rule.jump_bps * F.abs("before"))) if rule.jump_bps is not None else none
    frozen = ((F.count(F.lit(1)).over(run) >= rule.frozen_ticks) | ((F.max("t").over(run) - F.min("t").over(run)) >= rule.frozen_micros)) if rule.frozen_ticks is not None else none
    rows = moved.withColumns({"_gap": gap.cast("int"), "_jump": jump.cast("int"), "_frozen": frozen.cast("int"), "_shard": F.floor(F.col("t") / F.lit(SHARD_MICROS))})
    rows = running(rows, [E], "_shard", ["t", "seq"], {"gaps": F.col("_gap"), "jumps": F.col("_jump"), "frozen_before": F.col("_frozen")}).where("not duplicate")
    return rows.select(E, "t", "seq", "units", (F.col("gaps") + F.col("_gap")).alias("gaps"), (F.col("jumps") + F.col("_jump")).alias("jumps"), (F.col("frozen_before") + F.col("_frozen")).alias("frozen"), "frozen_before")


def outcomes(references: DataFrame, ticks: DataFrame, rule: Rule = RULE, *, reference: str = "reference_micros") -> DataFrame:
    """Labels of each reference (generation, `reference`, other columns kept) at each expiry.

    entry: the first tick at or after the reference; settlement: the first at or after entry + expiry. Adds expiry_seconds,
    entry_seq, entry_micros, settlement_seq, settlement_micros, reason (code), outcome (buy_win, sell_win, tie; null unless valid). The first
    of these that holds is the reason: no entry, stale entry, no settlement, late settlement, a gap or a jump after the entry, a frozen tick from
    the entry on (frozen before jump). `ticks` as from marked(). References without an instant have no entry.
    """
    own = references.columns
    x = asof(references, ticks, E, reference, "t", ["seq", "units", "gaps", "jumps", "frozen", "frozen_before"], "_entry", forward=True, tie="seq")
    x = x.withColumn("expiry_seconds", F.explode(F.array(*[F.lit(e) for e in rule.expiries]))).withColumn("_due", F.col("_entry.t") + F.col("expiry_seconds").cast("bigint") * MICRO)
    x = asof(x, ticks, E, "_due", "t", ["seq", "units", "gaps", "jumps", "frozen"], "_settle", forward=True, tie="seq")
    e, s = F.col("_entry"), F.col("_settle")
    reason = (
        F.when(e.isNull(), 1).when(e["t"] - F.col(reference) > rule.entry_delay, 2).when(s.isNull(), 3).when(s["t"] - F.col("_due") > rule.settlement_delay, 4)
        .when(s["gaps"] > e["gaps"], 5).when(s["frozen"] > e["frozen_before"], 6).when(s["jumps"] > e["jumps"], 7).otherwise(0)
    )
    side = F.when(reason == 0, F.when(s["units"] > e["units"], "buy_win").when(s["units"] < e["units"], "sell_win").otherwise("tie"))
    return x.select(*own, "expiry_seconds", e["seq"].alias("entry_seq"), e["t"].alias("entry_micros"), s["seq"].alias("settlement_seq"), s["t"].alias("settlement_micros"), reason.cast("int").alias("reason"), side.alias("outcome"))


def summary(labels: DataFrame) -> DataFrame:
    """Counts per expiry: total, each reason, each outcome."""
    counts = [F.count_if(F.col("reason") == k).alias(r) for k, r in enumerate(REASONS)] + [F.count_if(F.col("outcome") == o).alias(o) for o in ("buy_win", "sell_win", "tie")]
    return labels.groupBy("expiry_seconds").agg(F.count(F.lit(1)).alias("n"), *counts)


def path_metrics(trades: DataFrame, ticks: DataFrame, step: int = 60 * MICRO) -> DataFrame:
    """Best and worst move between entry and settlement of each trade (trade_id, generation, entry_micros, settlement_micros, entry_units): trade_id, n_ticks, best_units, worst_units, best_micros, worst_micros (first times).

    Ticks in (entry, settlement]. Ticks are reduced to one row a minute (`step`) with its extremes; a trade meets the minutes that it spans whole, and single ticks only in
    the minutes of its entry and settlement.
    """
    cut = lambda c: F.floor(c / F.lit(step))
    k = ticks.select(F.col(E).alias("_g"), "t", "units", cut(F.col("t")).alias("_m"))
    high, low = F.struct("units", (-F.col("t")).alias("t")), F.struct("units", "t")
    minutes = k.groupBy("_g", "_m").agg(F.count(F.lit(1)).alias("n"), F.max(high).alias("b"), F.min(low).alias("w"))
    own = trades.select("trade_id", F.col(E).alias("_g"), "entry_micros", "settlement_micros", "entry_units", cut(F.col("entry_micros")).alias("_first"), cut(F.col("settlement_micros")).alias("_last"))
    edge = own.withColumn("_m", F.explode(F.array_distinct(F.array("_first", "_last")))).join(k, ["_g", "_m"]).where((F.col("t") > F.col("entry_micros")) & (F.col("t") <= F.col("settlement_micros")))
    inner = own.where("_last - _first > 1").withColumn("_m", F.explode(F.sequence(F.col("_first") + 1, F.col("_last") - 1))).join(minutes, ["_g", "_m"])
    x = edge.select("trade_id", "entry_units", F.lit(1).cast("bigint").alias("n"), high.alias("b"), low.alias("w")).unionByName(inner.select("trade_id", "entry_units", "n", "b", "w"))
    x = x.groupBy("trade_id").agg(F.sum("n").alias("n_ticks"), F.max("b").alias("b"), F.min("w").alias("w"), F.max("entry_units").alias("_u"))
    return x.select("trade_id", "n_ticks", (F.col("b.units") - F.col("_u")).alias("best_units"), (F.col("w.units") - F.col("_u")).alias("worst_units"), (-F.col("b.t")).alias("best_micros"), F.col("w.t").alias("worst_micros"))
