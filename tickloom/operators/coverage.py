"""Day partitions and how far their spans are known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .periods import continuous_periods

DAY = 86_400_000_000


def day_start(text: Column) -> Column:
    """Micros of the start of a UTC day given as YYYY-MM-DD, null for other texts."""
    return F.unix_date(text.try_cast("date")).cast("bigint") * DAY


def known_spans(unresolved: DataFrame, keys: list[str]) -> DataFrame:
    """Complement of the unresolved spans within the days of an entity: keys, start, end of the stretches between them."""
    p = continuous_periods(unresolved, keys, "start", "end")
    return p.where("gap_end is not null").select(*keys, F.col("period_end").alias("start"), F.col("gap_end").alias("end"))


def day_states(days: DataFrame, unresolved: DataFrame, keys: list[str]) -> DataFrame:
    """Per entity and day: keys, day, n_rows, unresolved_micros (overlaps counted once, cut to the day) and state.

    days: keys, day (micros), n_rows. state: complete (rows, nothing unresolved), empty_known (no rows, nothing unresolved), unknown
    (the whole day unresolved), else partial.
    """
    p = continuous_periods(unresolved, keys, "start", "end").select(*keys, "period_start", "period_end")
    p = p.withColumn("day", F.explode(F.sequence(F.floor(F.col("period_start") / F.lit(DAY)), F.floor((F.col("period_end") - 1) / F.lit(DAY))))).withColumn("day", F.col("day") * DAY)
    open_ = p.groupBy(*keys, "day").agg(F.sum(F.least("period_end", F.col("day") + DAY) - F.greatest("period_start", "day")).alias("unresolved_micros"))
    d = days.groupBy(*keys, "day").agg(F.sum(F.coalesce("n_rows", F.lit(0))).alias("n_rows"))
    d = d.join(open_, [*keys, "day"], "left").withColumn("unresolved_micros", F.coalesce("unresolved_micros", F.lit(0)))
    u = F.col("unresolved_micros")
    state = F.when(u >= DAY, "unknown").when(u > 0, "partial").when(F.col("n_rows") > 0, "complete").otherwise("empty_known")
    return d.withColumn("state", state)


def covered(ranges: DataFrame, spans: DataFrame, keys: list[str], block: int = 30 * DAY) -> DataFrame:
    """Adds `contained` to ranges (keys, start, end): does one continuous period of `spans` (keys, start, end) hold the range whole?

    Ranges meet periods by the block their start lies in; a period stands in every block it crosses.
    """
    no = lambda c: F.floor(c / F.lit(block))
    p = continuous_periods(spans, keys, "start", "end").select(*[F.col(k).alias(f"_{k}") for k in keys], "period_start", "period_end")
    p = p.withColumn("_block", F.explode(F.sequence(no(F.col("period_start")), no(F.col("period_end") - 1))))
    on = (no(ranges["start"]) == p["_block"]) & (p["period_start"] <= ranges["start"]) & (p["period_end"] >= ranges["end"])
    for k in keys:
        on = on & ranges[k].eqNullSafe(p[f"_{k}"])
    return ranges.join(p, on, "left").withColumn("contained", F.col("period_start").isNotNull()).drop("_block", "period_start", "period_end", *[f"_{k}" for k in keys])


def by_role(rows: DataFrame, day: str, windows: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows with the role whose window [from, to) of whole days holds them; rows of no window are left out."""
    role = F.lit(None).cast("string")
    for name, (a, b) in reversed(list(windows.items())):
        role = F.when((F.col(day) >= F.lit(a).cast("date")) & (F.col(day) < F.lit(b).cast("date")), F.lit(name)).otherwise(role)
    return rows.withColumn("role", role).where("role is not null")


def newest(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key (ties: the greater `tie`), kept by a running maximum before any shuffle."""
    own = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*own), F.struct(at, tie)).alias("_x")).select(key, "_x.*")


def full_grid(days: DataFrame) -> DataFrame:
    """Adds `full` to inventory days (day, first, last: micros; n_rows, duration_seconds): do its bars stand at every place of the day's grid, as their number and ends tell?"""
    step = F.col("duration_seconds").cast("bigint") * 1_000_000
    return days.withColumn("full", F.coalesce((F.col("n_rows") * step == DAY) & (F.col("first") == F.col("day")) & (F.col("last") == F.col("day") + DAY - step), F.lit(False)))


def inventory_problems(days: DataFrame) -> DataFrame:
    """Adds `problem` to inventory days (day, first, last: micros; n_rows, state): null, or the first that holds of bad_day, negative_rows, rows_without_bounds, bounds_without_rows, reversed, outside_day, state_without_rows (complete without rows), rows_in_empty."""
    c = F.col
    bounds = c("first").isNotNull() & c("last").isNotNull()
    none = c("first").isNull() & c("last").isNull()
    n = F.coalesce("n_rows", F.lit(0))
    problem = (
        F.when(c("day").isNull(), "bad_day").when(n < 0, "negative_rows").when((n > 0) & ~bounds, "rows_without_bounds").when((n == 0) & ~none, "bounds_without_rows").when(bounds & (c("last") < c("first")), "reversed")
        .when(bounds & ((c("first") < c("day")) | (c("last") >= c("day") + DAY)), "outside_day").when((c("state") == "complete") & (n == 0), "state_without_rows").when((c("state") == "empty_known") & (n > 0), "rows_in_empty")
    )
    return days.withColumn("problem", problem)


def disorder(spans: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Spans (keys, start, end, `order`: their place in a list) that break the rule that each ends after its start and begins at or after the end of the one before: spans with `problem` empty, reversed or overlap."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag("end").over(w)
    problem = F.when(F.col("start") == F.col("end"), "empty").when(F.col("start") > F.col("end"), "reversed").when(F.col("start") < before, "overlap")
    return spans.withColumn("problem", problem).where("problem is not null")


def against_coverage(days: DataFrame, coverage: DataFrame, key: str) -> DataFrame:
    """Days of an inventory (key, day) against what is covered (key, start, end: micros): key, day, finding, for days covered but not listed (`missing`) and days listed but not covered (`outside`)."""
    c = coverage.select(key, F.explode(F.sequence(F.floor(F.col("start") / DAY), F.floor((F.col("end") - 1) / DAY))).alias("_d")).select(key, (F.col("_d") * DAY).alias("day")).distinct()
    d = days.where("day is not null").select(key, "day").distinct()
    return c.join(d, [key, "day"], "left_anti").withColumn("finding", F.lit("missing")).unionByName(d.join(c, [key, "day"], "left_anti").withColumn("finding", F.lit("outside")))


def reachable(edges: DataFrame, roots: DataFrame, most: int = 1_000) -> DataFrame:
    """Every node that can be reached from the roots (node) along edges (source, target), the roots included: node, steps (fewest).

    Breadth first, a join a step; what is known is written after each step, so no plan grows and a lost executor loses nothing. Ends when a step finds nothing new.
    """
    known = written(roots.select("node").dropna().distinct().withColumn("steps", F.lit(0)), "known")
    edges = edges.select("source", "target").dropna().distinct()
    for step in range(1, most + 1):
        fresh = known.where(F.col("steps") == step - 1).join(edges, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        fresh = written(fresh.join(known, "node", "left_anti").withColumn("steps", F.lit(step)), "fresh")
        if fresh.isEmpty():
            return known
        known = written(known.unionByName(fresh), "known")
    raise RuntimeError(f"a path of more than {most} edges")
