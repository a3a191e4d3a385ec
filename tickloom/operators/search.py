"""Condition search over coded rows: combinations, their scores, exact tests and their adjustment."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .shards import lookup_join, ordered_shards, running


def posting_lists(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How often each code of each column occurs, rarest first within a column: column, code, n, rank. Codes below 0 aren't conditions."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("code")) for c in columns]))
    n = rows.select(pairs.alias("p")).select("p.*").where("code >= 0").groupBy("column", "code").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy("n", "code")))


def combinations(rows: DataFrame, columns: list[str], sizes: tuple[int, ...] = (1, 2, 3), outcome: str = "won") -> DataFrame:
    """Every combination of conditions of different columns that rows meet, with its score: conditions (text), size, n, wins, losses, ties.

    Each row lists its own combinations (at most the sum of C(columns, size)); they are counted in the map tasks before anything is
    shuffled, and no row ever meets another. `outcome`: 1 won, -1 lost, 0 tie, null: not counted.
    """
    import itertools

    picks = [p for k in sizes for p in itertools.combinations(range(len(columns)), k)]
    parts = [F.when(F.greatest(*[F.col(columns[i]) for i in p], F.lit(-1)).isNotNull() & (F.least(*[F.coalesce(F.col(columns[i]), F.lit(-1)) for i in p], F.lit(1 << 30)) >= 0), F.struct(F.concat_ws("&", *[F.concat(F.lit(f"{columns[i]}="), F.col(columns[i]).cast("string")) for i in p]).alias("c"), F.lit(len(p)).alias("k"))) for p in picks]
    x = rows.where(F.col(outcome).isNotNull()).select(F.explode(F.array_compact(F.array(*parts))).alias("x"), F.col(outcome).alias("_o"))
    return x.groupBy(F.col("x.c").alias("conditions"), F.col("x.k").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_o") > 0).alias("wins"), F.count_if(F.col("_o") < 0).alias("losses"), F.count_if(F.col("_o") == 0).alias("ties"))


def _stirling(n: np.ndarray) -> np.ndarray:
    """log n! less Stirling's formula: exact below 16, by its series from there on."""
    n = np.asarray(n, float)
    small = np.minimum(n, 15).astype(int)
    table = np.array([0.0, *(math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi) for k in range(1, 16))])
    x = np.maximum(n, 1.0)
    y = x * x
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / y) / y) / y) / y) / x
    return np.where(n < 16, table[small], series)


def _deviance(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """x log(x / m) + m - x, also where x is near m."""
    v = (x - m) / (x + m)
    near, total, power = np.abs(v) < 0.1, (x - m) * v, 2 * x * v
    for j in range(1, 30):
        power = power * v * v
        total = total + power / (2 * j + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(near, total, x * np.log(x / m) + m - x)


def _mass(k: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """P(X = k) of n trials at p, by saddle-point expansion, which holds its digits for any n."""
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = np.exp(_stirling(n) - _stirling(k) - _stirling(n - k) - _deviance(k, n * p) - _deviance(n - k, n * (1 - p))) * np.sqrt(n / (2 * math.pi * k * (n - k)))
    return np.where(k <= 0, np.exp(n * math.log1p(-p)), np.where(k >= n, np.exp(n * math.log(p)), inner))


def upper_tails(wins: np.ndarray, losses: np.ndarray, p: float) -> np.ndarray:
    """P(X >= wins) of wins + losses trials at p for each pair.

    From the term at the border outwards, on the side of the border that falls off, each term by its ratio to the one before, until they no longer
    count: some standard deviations' worth of terms, all pairs at once.
    """
    w, n = np.asarray(wins, float), np.asarray(wins, float) + np.asarray(losses, float)
    out = np.ones(len(w))
    live = (n > 0) & (w > 0)
    if p <= 0 or p >= 1:
        return np.where(live, 0.0, 1.0) if p <= 0 else out
    up = w > n * p
    k = np.where(up, w, w - 1)
    term = np.where(live, _mass(k, np.maximum(n, 1.0), p), 0.0)
    total, at, odds = term.copy(), np.flatnonzero(live), p / (1 - p)
    while len(at):
        i, m = k[at], n[at]
        ratio = np.where(up[at], (m - i) / (i + 1) * odds, i / (m - i + 1) / odds)
        term[at] *= ratio
        total[at] += term[at]
        k[at] += np.where(up[at], 1.0, -1.0)
        at = at[term[at] > 1e-18 * total[at]]
    return np.where(live, np.minimum(1.0, np.where(up, total, 1.0 - total)), 1.0)


def upper_tail(wins: int, losses: int, p: float) -> float:
    """`upper_tails` of one pair."""
    return float(upper_tails(np.array([wins]), np.array([losses]), p)[0])


def tested(counts: DataFrame, break_even: float) -> DataFrame:
    """Adds p_value, the upper tail of wins against `break_even`. A test each combination, in Arrow batches."""

    @F.pandas_udf("double")
    def tail(w: pd.Series, l: pd.Series) -> pd.Series:
        return pd.Series(upper_tails(w.to_numpy(), l.to_numpy(), break_even))

    return counts.withColumn("p_value", F.round(tail("wins", "losses"), 12))


def adjusted(tests: DataFrame, id: str = "conditions") -> DataFrame:
    """Adds the rank by p_value (ties by id) and the Benjamini-Hochberg adjusted value: min over equal or larger ranks of p * m / rank, at most 1.

    The tests are written once in ranges of (p_value, id) of about equal size, however many are tied; ranks and minima run within these. Null p_values get null.
    """
    held = written(ordered_shards(tests, [], ["p_value", id]), "tests")
    ranked = running(held.where("p_value is not null").withColumn("_all", F.lit(0)), ["_all"], "_shard", ["p_value", id], {"_before": F.lit(1)}).withColumn("rank", F.col("_before") + 1)
    m = held.agg(F.count("p_value").alias("_m"))
    x = ranked.join(F.broadcast(m)).withColumn("_v", F.col("p_value") * F.col("_m") / F.col("rank"))
    # Backwards: the least value among the larger ranks is the greatest of the negatives before.
    x = x.withColumn("_back", -F.col("_shard")).withColumn("_down", -F.col("rank"))
    x = running(x, ["_all"], "_back", ["_down"], {"_least": -F.col("_v")}, "max")
    x = x.withColumn("adjusted", F.least(F.lit(1.0), F.coalesce(F.least("_v", -F.col("_least")), "_v")))
    return x.drop("_shard", "_all", "_before", "_m", "_v", "_back", "_down", "_least").unionByName(held.where("p_value is null").drop("_shard"), allowMissingColumns=True)


def screened(tests: DataFrame, most: float, top: int, id: str = "conditions") -> DataFrame:
    """The first `top` of a family by (p_value, id) whose adjusted value is at most `most`."""
    return tests.where((F.col("adjusted") <= most) & (F.col("rank") <= top))


def candidates(menu: DataFrame, least: int, most: int) -> DataFrame:
    """Every set of `least` to `most` conditions of different columns of a menu (column, code): conditions (array of `column=code`, ascending), size.

    The family is what this makes, so it is as large as the menu says; each set grows by what comes later in the menu's order, a size at a time.
    """
    one = menu.distinct().select(F.struct(F.concat_ws("=", "column", F.col("code").cast("string")).alias("c"), F.col("column").alias("col")).alias("m"))
    whole = F.broadcast(one.agg(F.sort_array(F.collect_list("m")).alias("_menu")))  # the menu in one row: it is what the user states
    sets = one.select(F.array("m.c").alias("conditions"), F.array("m.col").alias("cols"))
    out = [sets]
    for _ in range(1, most):
        later = F.filter("_menu", lambda m: (m["c"] > F.element_at("conditions", -1)) & ~F.array_contains("cols", m["col"]))
        sets = sets.join(whole).select("conditions", "cols", F.explode(later).alias("m")).select(F.array_append("conditions", F.col("m.c")).alias("conditions"), F.array_append("cols", F.col("m.col")).alias("cols"))
        out.append(sets)
    rows = out[least - 1]
    for x in out[least:]:
        rows = rows.unionByName(x)
    return rows.select("conditions", F.size("conditions").alias("size"))


def matched(rows: DataFrame, columns: list[str], candidates: DataFrame) -> DataFrame:
    """Each row (its own columns) with each candidate (candidate, conditions: array of `column=code`) all of whose conditions it meets.

    A candidate is looked up by its least frequent condition alone, and the rest is held against the row: rows meet only candidates that may fit.
    A candidate without conditions fits nothing.
    """
    held = F.array_compact(F.array(*[F.when(F.col(c) >= 0, F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in columns]))
    rows = rows.withColumn("_held", held)
    counts = rows.select(F.explode("_held").alias("_driver")).groupBy("_driver").agg(F.count(F.lit(1)).alias("_n"))
    parts = candidates.select("candidate", "conditions", F.explode("conditions").alias("_driver")).join(counts, "_driver")
    whole = F.count(F.lit(1)).over(Window.partitionBy("candidate")) == F.size(F.array_distinct("conditions"))
    first = F.row_number().over(Window.partitionBy("candidate").orderBy("_n", "_driver")) == 1
    drivers = parts.dropDuplicates(["candidate", "_driver"]).withColumns({"_whole": whole, "_first": first}).where("_whole and _first").select("candidate", "conditions", "_driver")
    met = lookup_join(rows.withColumn("_driver", F.explode("_held")), drivers, "_driver", "inner")
    return met.where(F.size(F.array_except("conditions", "_held")) == 0).drop("_held", "_driver", "conditions")


def gated(scores: DataFrame, least: int, profit: int = 0, id: str = "conditions") -> DataFrame:
    """Adds `gate` (null, or why a candidate is out: too_few with fewer than `least` decided trades, unprofitable with net units of `profit` or less) and `place`, the rank of those that are in: by net units, then decided trades, then id.

    scores: id, wins, losses, net_units.
    """
    decided = F.col("wins") + F.col("losses")
    x = scores.withColumn("gate", F.when(decided < least, "too_few").when(F.col("net_units") <= profit, "unprofitable"))
    inside = x.where("gate is null").withColumns({"_net": -F.col("net_units"), "_decided": -(F.col("wins") + F.col("losses")), "_all": F.lit(0)})
    held = written(ordered_shards(inside, [], ["_net", "_decided", id]), "gated")
    ranked = running(held, ["_all"], "_shard", ["_net", "_decided", id], {"_before": F.lit(1)}).withColumn("place", F.col("_before") + 1)
    return ranked.drop("_net", "_decided", "_all", "_shard", "_before").unionByName(x.where("gate is not null"), allowMissingColumns=True)


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at, busy = None, np.iinfo(np.int64).min
    for df in frames:
        kept = np.zeros(len(df), bool)
        for i, x in enumerate(df.itertuples(index=False)):
            if (x.candidate, x.stretch) != at:
                at, busy = (x.candidate, x.stretch), np.iinfo(np.int64).min
            if busy <= x.entry and x.release > 0:
                kept[i], busy = True, x.release
        yield pd.DataFrame({"candidate": df["candidate"], "row": df["row"], "kept": kept})


def one_at_a_time(signals: DataFrame, length: int = 86_400_000_000) -> DataFrame:
    """Signals (candidate, row, entry, release) with `kept`: a candidate takes a signal only while it holds none, from entry to release.

    In order of (entry, row). Wherever everything before has been released by a signal's entry, it is taken whatever came before, so a candidate's
    signals fall into stretches that are worked on apart; a stretch streams by in order, nothing is collected. The stretches are found by running maxima over
    blocks of `length` of entries. A release of 0 or less is never taken.
    """
    s = signals.select(F.col("candidate").cast("string"), F.col("row").cast("bigint"), F.col("entry").cast("bigint"), F.coalesce(F.col("release").cast("bigint"), F.lit(0)).alias("release")).where("candidate is not null and entry is not null")
    s = running(s.withColumn("_shard", F.floor(F.col("entry") / F.lit(length))), ["candidate"], "_shard", ["entry", "row"], {"_held": F.col("release")}, "max")
    # A stretch is named by its first entry: the greatest entry so far at which nothing was held.
    free = F.when(F.coalesce(F.col("_held"), F.lit(0)) <= F.col("entry"), F.col("entry"))
    s = s.withColumn("_free", free)
    s = running(s, ["candidate"], "_shard", ["entry", "row"], {"_before": F.col("_free")}, "max").withColumn("stretch", F.coalesce("_free", "_before"))
    return s.select("candidate", "stretch", "row", "entry", "release").repartition("candidate", "stretch").sortWithinPartitions("candidate", "stretch", "entry", "row").mapInPandas(_scan, "candidate string, row bigint, kept boolean")
