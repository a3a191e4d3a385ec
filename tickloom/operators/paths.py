"""Equity paths: drawdowns, streaks, rolling sums and the stationary bootstrap."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def equity(trades: DataFrame, path: str, order: list[str], value: str) -> DataFrame:
    """Trades with equity, peak (at least 0) and drawdown along each path."""
    w = Window.partitionBy(path).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = trades.withColumn("equity", F.sum(value).over(w))
    x = x.withColumn("peak", F.greatest(F.max("equity").over(w), F.lit(0)))
    return x.withColumn("drawdown", F.col("peak") - F.col("equity"))


def drawdowns(trades: DataFrame, path: str, order: list[str], value: str) -> DataFrame:
    """Per path: path, n, total, max_drawdown, ulcer (root mean square of drawdowns), longest_underwater (trades in a row below the peak)."""
    w = Window.partitionBy(path).orderBy(*order)
    x = equity(trades, path, order, value).withColumn("_no", F.row_number().over(w))
    x = x.withColumn("_top", F.max(F.when(F.col("drawdown") <= 0, F.col("_no"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(path).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max("drawdown").alias("max_drawdown"), F.round(F.sqrt(F.avg(F.pow(F.col("drawdown").cast("double"), 2.0))), 6).alias("ulcer"), F.max(F.col("_no") - F.coalesce("_top", F.lit(0))).alias("longest_underwater")
    )


def streaks(trades: DataFrame, path: str, order: list[str], value: str) -> DataFrame:
    """Longest runs of losses (below 0) and of wins (above 0) per path: path, loss_streak, win_streak. Ties (0) end a run."""
    w = Window.partitionBy(path).orderBy(*order)
    x = trades.withColumn("_s", F.signum(value)).withColumn("_run", F.row_number().over(w) - F.row_number().over(Window.partitionBy(path, "_s").orderBy(*order)))
    runs = x.groupBy(path, "_s", "_run").agg(F.count(F.lit(1)).alias("_n"))
    return runs.groupBy(path).agg(F.coalesce(F.max(F.when(F.col("_s") < 0, F.col("_n"))), F.lit(0)).alias("loss_streak"), F.coalesce(F.max(F.when(F.col("_s") > 0, F.col("_n"))), F.lit(0)).alias("win_streak"))


def worst_sums(trades: DataFrame, path: str, order: list[str], value: str, widths: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    """Least sum over so many trades in a row per path; null where a path is shorter."""
    by = Window.partitionBy(path).orderBy(*order)
    sums = {f"_{n}": F.when(F.count(F.lit(1)).over(by.rowsBetween(-(n - 1), 0)) == n, F.sum(value).over(by.rowsBetween(-(n - 1), 0))) for n in widths}
    return trades.withColumns(sums).groupBy(path).agg(*[F.min(f"_{n}").alias(f"worst_{n}") for n in widths])


def uniforms(seed: int, stratum: str, replicate: int) -> np.random.Generator:
    """Random numbers that depend on these three alone: a counter-based generator whose key is the seed and the stratum, and whose counter starts at the replicate."""
    key = int.from_bytes(hashlib.blake2b(stratum.encode(), digest_size=8).digest(), "little")
    return np.random.Generator(np.random.Philox(key=[seed % (1 << 64), key], counter=[0, 0, 0, replicate]))


def block_path(seed: int, stratum: str, replicate: int, n: int, block_length: int) -> np.ndarray:
    """n indices of a stationary bootstrap: blocks of geometric length, `block_length` on average, from evenly distributed starts, round the end.

    As many blocks as will do are drawn at once, lengths by inversion of their law; should they fall short, more are drawn.
    """
    if n == 0:
        return np.empty(0, np.int64)
    draw = uniforms(seed, stratum, replicate)
    starts, lengths, have = [], [], 0
    while have < n:
        u = draw.random((max(16, int(1.2 * (n - have) / block_length) + 8), 2))
        length = np.ones(len(u), np.int64) if block_length <= 1 else 1 + np.floor(np.log1p(-u[:, 0]) / np.log1p(-1.0 / block_length)).astype(np.int64)
        starts.append((u[:, 1] * n).astype(np.int64))
        lengths.append(length)
        have += int(length.sum())
    start, length = np.concatenate(starts), np.concatenate(lengths)
    before = np.cumsum(length) - length
    return ((np.repeat(start - before, length) + np.arange(int(length.sum())))[:n]) % n


def path_numbers(values: np.ndarray, horizon: int) -> tuple[float, int, int]:
    """Greatest drawdown from a peak of at least 0, longest stretch below it, and how many sums over `horizon` in a row are negative."""
    e = np.cumsum(values)
    peak = np.maximum(np.maximum.accumulate(e), 0.0)
    under = e < peak
    at = np.arange(1, len(e) + 1)
    longest = int((at - np.maximum.accumulate(np.where(under, 0, at))).max()) if len(e) else 0
    sums = e[horizon - 1 :] - np.concatenate([[0.0], e[:-horizon]]) if len(e) >= horizon else np.empty(0)
    return float((peak - e).max()) if len(e) else 0.0, longest, int((sums < 0).sum())


#: Trades in a stored piece of a path, and replicates that one task draws of one path.
PIECE, UNIT = 4096, 25


def bootstrap_trades(trades: DataFrame, path: str, order: list[str], value: str, replicates: int = 200, block_length: int = 5, horizon: int = 20, seed: int = 42) -> DataFrame:
    """One row per path and replicate: path, n, replicate, max_drawdown, longest_underwater, negative_rolling (null where a path is shorter than `horizon`).

    Each path is resampled over its own trades in `order`, its name being the stratum. The values are written once in pieces; UNIT replicates of a
    path are a unit of work, which holds the values of that path alone. `replicates` is the number of samples, the only sampling there is.
    """
    no = F.row_number().over(Window.partitionBy(path).orderBy(*order)) - 1
    placed = trades.select(F.col(path).alias("path"), no.alias("_no"), F.col(value).cast("double").alias("_v"))
    pieces = placed.groupBy("path", F.floor(F.col("_no") / F.lit(PIECE)).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("_no", "_v"))).alias("_x"))
    pieces = written(pieces.select("path", "piece", F.col("_x._v").alias("values")), "paths")
    units = pieces.withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // UNIT))))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("piece")
        values, name, unit = np.concatenate(df["values"].to_list()), df["path"].iloc[0], int(df["unit"].iloc[0])
        rows = [(name, len(values), r, *path_numbers(values[block_path(seed, name, r, len(values), block_length)], horizon)) for r in range(unit * UNIT, min(replicates, (unit + 1) * UNIT))]
        out = pd.DataFrame(rows, columns=["path", "n", "replicate", "max_drawdown", "longest_underwater", "negative_rolling"])
        return out if len(values) >= horizon else out.assign(negative_rolling=None)

    return units.groupBy("path", "unit").applyInPandas(run, "path string, n bigint, replicate bigint, max_drawdown double, longest_underwater bigint, negative_rolling bigint")


def stability(paths: DataFrame) -> DataFrame:
    """Exact median and 95 % quantile of drawdowns, 95 % of underwater stretches."""
    return paths.agg(F.count(F.lit(1)).alias("replicates"), F.percentile("max_drawdown", F.lit(0.5)).alias("median_drawdown"), F.percentile("max_drawdown", F.lit(0.95)).alias("p95_drawdown"), F.percentile("longest_underwater", F.lit(0.95)).alias("p95_underwater"))
