"""What can be held at once: signals admitted against limits of open positions, and how what was taken fared."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import paths
from .search import one_at_a_time


def admitted(signals: DataFrame, total: int, alike: int) -> DataFrame:
    """Signals (portfolio, row, entry, due, kind) with `kept`: at most `total` are open in a portfolio at once, and `alike` of one kind.

    In order of (entry, row); a position is open while due > entry of the signal at hand. Sorted rows stream by; a task holds the open positions of one portfolio,
    which are `total` at most. Signals without portfolio, entry or due are left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, open_, kinds = None, [], {}
        for df in frames:
            kept = []
            for x in df.itertuples(index=False):
                if x.portfolio != at:
                    at, open_, kinds = x.portfolio, [], {}
                while open_ and open_[0][0] <= x.entry:
                    kinds[heapq.heappop(open_)[1]] -= 1
                take = len(open_) < total and kinds.get(x.kind, 0) < alike and x.due > x.entry
                if take:
                    heapq.heappush(open_, (x.due, x.kind))
                    kinds[x.kind] = kinds.get(x.kind, 0) + 1
                kept.append(take)
            yield pd.DataFrame({"portfolio": df["portfolio"], "row": df["row"], "kind": df["kind"], "kept": kept})

    s = signals.select(F.col("portfolio").cast("string"), F.col("row").cast("bigint"), F.col("entry").cast("bigint"), F.col("due").cast("bigint"), F.coalesce(F.col("kind").cast("string"), F.lit("")).alias("kind")).dropna()
    return s.repartition("portfolio").sortWithinPartitions("portfolio", "entry", "row", "kind").mapInPandas(run, "portfolio string, row bigint, kind string, kept boolean")


def scores(trades: DataFrame) -> DataFrame:
    """Trades (candidate, row, entry, release, value) taken one at a time, scored per candidate: n, wins, losses, ties, drawdown, ulcer, underwater, streaks and worst sums."""
    trades = written(trades, "trades")
    kept = one_at_a_time(trades).where("kept").select("candidate", "row")
    x = trades.withColumn("candidate", F.col("candidate").cast("string")).join(kept, ["candidate", "row"], "left_semi")
    x = written(x, "taken")
    order = ["entry", "row"]
    counts = x.groupBy("candidate").agg(F.count_if(F.col("value") > 0).alias("wins"), F.count_if(F.col("value") < 0).alias("losses"), F.count_if(F.col("value") == 0).alias("ties"))
    out = counts.join(paths.drawdowns(x, "candidate", order, "value"), "candidate").join(paths.streaks(x, "candidate", order, "value"), "candidate")
    return out.join(paths.worst_sums(x, "candidate", order, "value"), "candidate")


#: Columns of a full score after candidate and side, and those of a short one.
FULL = ("total", "wins", "losses", "ties", "invalid", "buy_signals", "sell_signals", "net_units", "max_drawdown", "max_losses", "drawdown_squares", "longest_underwater", "max_drawdown_trades", "worst_20", "worst_50", "worst_100", "trades", "trade_squares", "downside_squares", "longest_underwater_micros", "max_drawdown_micros")
SHORT = FULL[:8]


def _sides(taken: DataFrame, sides: tuple[str, ...], payout: int) -> DataFrame:
    """Each signal once a side, with what it earns there: `payout`, -100 or nothing. Both sides together let a rise decide; one side alone looks for its own win first."""
    rise, fall = F.col("buy_win"), F.col("sell_win")
    counted = F.col("kept") & F.col("valid") & ~F.col("tie")
    up = F.when(rise, 1).when(fall, -1).otherwise(0)
    down = F.when(rise, -1).when(fall, 1).otherwise(0) if len(sides) > 1 else F.when(fall, 1).when(rise, -1).otherwise(0)
    side = F.explode(F.array(*[F.struct(F.lit(x).alias("side"), F.when(counted, up if x == "buy" else down).otherwise(0).alias("won")) for x in sides]))
    x = taken.withColumn("_s", side).select("*", "_s.side", "_s.won").drop("_s")
    return x.withColumn("units", F.when(F.col("won") > 0, payout).when(F.col("won") < 0, -100).otherwise(0).cast("bigint"))


def taken_signals(signals: DataFrame) -> DataFrame:
    """Signals (candidate, row, scope, entry, release, settlement, valid, tie, buy_win, sell_win) with `kept`: those of scope 0 are left out, those of scope 2 only occupy the candidate."""
    s = signals.where("scope <> 0").withColumn("candidate", F.col("candidate").cast("string"))
    s = written(s, "signals")
    return s.join(one_at_a_time(s), ["candidate", "row"])


def score_signals(signals: DataFrame, sides: tuple[str, ...] = ("buy", "sell"), payout: int = 92, full: bool = True) -> DataFrame:
    """Scores of candidates that hold one position at a time: candidate, side and FULL, or with `full` off SHORT.

    total: signals of scope 1; invalid: those that found the candidate busy, had no release, or were taken without being valid. Trades are the taken valid ones, ties
    among them. A drawdown lasts from the last trade at the peak (the first decision, if none was) to the trade that reaches the peak again or the last one; under
    water are the trades below the peak. Windows run over one candidate's trades, which don't overlap in time.
    """
    x = written(_sides(taken_signals(signals).where("scope = 1"), sides, payout), "sided")
    traded = F.col("kept") & F.col("valid")
    short = x.groupBy("candidate", "side").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("won") > 0).alias("wins"), F.count_if(F.col("won") < 0).alias("losses"), F.count_if(traded & F.col("tie")).alias("ties"), F.count_if(~traded).alias("invalid")
    )
    n = F.col("total")
    short = short.select("*", F.when(F.col("side") == "buy", n).otherwise(0).alias("buy_signals"), F.when(F.col("side") == "sell", n).otherwise(0).alias("sell_signals"), (F.col("wins") * payout - F.col("losses") * 100).alias("net_units"))
    if not full:
        return short
    by = Window.partitionBy("candidate", "side").orderBy("entry", "row")
    run, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    t = x.where(traded).withColumns({"no": F.row_number().over(by), "equity": F.sum("units").over(run)})
    t = t.withColumn("_top", F.col("equity") >= F.greatest(F.coalesce(F.max("equity").over(before), F.lit(0)), F.lit(0))).withColumn("drawdown", F.greatest(F.max("equity").over(run), F.lit(0)) - F.col("equity"))
    t = t.withColumns({"_episode": F.sum(F.col("_top").cast("int")).over(run), "_next": F.lead("settlement").over(by), "_last": F.lag("settlement").over(by), "_lost": F.col("units") < 0})
    t = t.withColumn("_won_before", F.sum((~F.col("_lost")).cast("int")).over(run))
    sums = {f"_w{k}": F.when(F.col("no") >= k, F.sum("units").over(by.rowsBetween(-(k - 1), 0))) for k in (20, 50, 100)}
    t = t.withColumns(sums)
    down = t.where("not _top").groupBy("candidate", "side", "_episode").agg(
        F.min("no").alias("a"), F.max("no").alias("b"), F.min_by("settlement", "no").alias("since"), F.max_by("settlement", "no").alias("final"), F.max_by(F.struct("_next"), "no")["_next"].alias("back"), F.min_by(F.coalesce("_last", "entry"), "no").alias("peak")
    )
    end = F.coalesce("back", "final")
    down = down.select("candidate", "side", (F.col("b") - F.col("a") + 1).alias("under"), (end - F.col("since")).alias("under_micros"), F.struct((end - F.col("peak")).alias("micros"), F.when(F.col("back").isNotNull(), F.col("b") - F.col("a") + 2).otherwise(F.col("b") - F.col("a") + 1).alias("trades")).alias("fall"))
    down = down.groupBy("candidate", "side").agg(F.greatest(F.max("under"), F.lit(0)).alias("longest_underwater"), F.greatest(F.max("under_micros"), F.lit(0)).alias("longest_underwater_micros"), F.max(F.when(F.col("fall.micros") >= 0, F.col("fall"))).alias("_fall"))
    losses = t.where("_lost").groupBy("candidate", "side", "_won_before").agg(F.count(F.lit(1)).alias("n")).groupBy("candidate", "side").agg(F.max("n").alias("max_losses"))
    path = t.groupBy("candidate", "side").agg(
        F.max("drawdown").alias("max_drawdown"), F.sum(F.col("drawdown").cast("double") * F.col("drawdown")).alias("drawdown_squares"), *[F.min(f"_w{k}").alias(f"worst_{k}") for k in (20, 50, 100)],
        F.count(F.lit(1)).alias("trades"), F.sum(F.col("units") * F.col("units")).alias("trade_squares"), F.sum(F.when(F.col("units") < 0, F.col("units") * F.col("units")).otherwise(0)).alias("downside_squares"),
    )
    key = ["candidate", "side"]
    out = short.join(path, key, "left").join(losses, key, "left").join(down, key, "left")
    out = out.withColumns({"max_drawdown_trades": F.col("_fall.trades"), "max_drawdown_micros": F.col("_fall.micros")}).na.fill(0.0, ["drawdown_squares"])
    return out.select(*key, *[F.coalesce(c, F.lit(0)).alias(c) if c != "drawdown_squares" else F.col(c) for c in FULL])
