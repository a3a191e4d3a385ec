"""Queries and SQL of labels, encodings, searches, paths, calendars, coverage, pages and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.prices import decimal_text, decimal_units, event_micros, event_text
from .functions.text import instant_micros
from .operators import asof, coverage, encodings, outcomes, paths, search, sessions
from .operators import stream as st
from .session import written
from .sources import files, pages, table
from .stream_queries import ACCEPTED, MOVED, _moved
from .streaming import jobs

DAY = 86_400_000_000
#: Labels that a column may have codes for.
LABELS = 32_768


def _references(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feature_rows").where("close_time_micros is not null").select("feature_id", "generation", F.unix_micros("close_time_micros").alias("reference_micros"))


#: A minute's bars are a minute apart, so what counts as stale, as a gap or as a jump is wider than for ticks.
BAR_RULE = outcomes.Rule((60, 120, 300), entry_delay=90_000_000, settlement_delay=90_000_000, gap_max=180_000_000, jump_bps=60, jump_gap_max=90_000_000, frozen_ticks=12, frozen_micros=900_000_000)


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """The marked ticks as a table: they are laid in order once, not anew for each expiry."""
    return written(outcomes.marked(_moved(spark, d)), "marked")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.outcomes(_references(spark, d), _marked(spark, d))


def outcome_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("feature_id", "expiry_seconds", "entry_seq", "settlement_seq", "reason", "outcome")


def outcomes_from_bars(spark: SparkSession, d: str) -> DataFrame:
    """Labels whose observations are the closes of bars, known at their ends."""
    bars = table(spark, d, "candles").where("close_time_micros is not null and close_units is not null").select("generation", F.col("candle_id").alias("seq"), F.unix_micros("close_time_micros").alias("t"), F.col("close_units").alias("units"))
    marks = written(outcomes.marked(st.moves(written(bars, "bars")), BAR_RULE), "marked")
    return outcomes.outcomes(_references(spark, d), marks, BAR_RULE).select("feature_id", "expiry_seconds", "entry_seq", "settlement_seq", "reason", "outcome")


def outcome_summary(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.summary(_labels(spark, d))


def _trades(spark: SparkSession, d: str) -> DataFrame:
    """Valid labels as trades: value 92 for a rise, -100 for a fall, 0 for none."""
    value = F.when(F.col("outcome") == "buy_win", 92).when(F.col("outcome") == "sell_win", -100).otherwise(0)
    return _labels(spark, d).where("reason = 0").select("feature_id", "generation", "expiry_seconds", "entry_seq", "entry_micros", "settlement_seq", "settlement_micros", "outcome", value.cast("bigint").alias("value"), F.concat_ws("/", "generation", "expiry_seconds").alias("path"))


def trade_paths(spark: SparkSession, d: str) -> DataFrame:
    moved = _moved(spark, d)
    ticks = written(outcomes.marked(moved), "marked")
    t = outcomes.outcomes(_references(spark, d), ticks).where("reason = 0")
    t = t.join(ticks.select(F.col("seq").alias("entry_seq"), F.col("units").alias("entry_units")), "entry_seq").withColumn("trade_id", F.concat_ws("/", "feature_id", "expiry_seconds"))
    return outcomes.path_metrics(t, moved)


def availability_asof(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "feature_rows").select("feature_id", "generation", F.unix_micros("known_at_micros").alias("known"), F.unix_micros("close_time_micros").alias("close"))
    other = table(spark, d, "candles").select("generation", "candle_id", F.unix_micros("known_at_micros").alias("c_known"), F.unix_micros("close_time_micros").alias("c_close"))
    x = asof.asof(base, other, "generation", "known", "c_known", ["candle_id", "c_close"], "latest", tie="candle_id")
    return x.select("feature_id", F.col("latest.candle_id").alias("candle_id"), (F.col("latest.c_close") <= F.col("close")).alias("usable"))


def fixed_bins(spark: SparkSession, d: str) -> DataFrame:
    return encodings.fixed_bins(table(spark, d, "feature_rows", "feature_id", "return_1_bps", "body_bps"), ["return_1_bps", "body_bps"]).select("feature_id", "return_1_bps_bucketed", "body_bps_bucketed")


def development_fifths(spark: SparkSession, d: str) -> DataFrame:
    cuts = encodings.development_fifths(table(spark, d, "feature_rows"), ["instrument"], "activity_score")
    return cuts.select("instrument", F.posexplode("cuts").alias("place", "cut")).withColumn("cut", F.round("cut", 6))


def category_labels(spark: SparkSession, d: str) -> DataFrame:
    return encodings.ranked_labels(table(spark, d, "feature_rows"), ["direction", "stream_key", "instrument"], LABELS)


def encode_apply(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "feature_rows")
    fitted = encodings.ranked_labels(rows.where("written_at < timestamp '2017-01-20 00:00:00'"), ["direction", "instrument"], LABELS)
    return encodings.encoded(rows, fitted, ["direction", "instrument"]).select("feature_id", "direction_code", "instrument_code")


def coded_rows(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows with their codes."""
    cut = lambda c, edges: F.when(c.isNotNull(), sum(((c > e).cast("int") for e in edges), F.lit(0)))
    return table(spark, d, "feature_rows").select(
        "feature_id", F.when(F.col("direction") == "up", 1).when(F.col("direction") == "down", 2).when(F.col("direction").isNotNull(), 0).alias("dir"), cut(F.col("return_1_bps"), (-5.0, -1.0, 1.0, 5.0)).alias("ret"), cut(F.col("body_bps"), (1.0, 3.0, 8.0)).alias("body"), cut(F.col("activity_score"), (0.5, 1.0, 2.0)).alias("act"),
    )


def _coded(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes with codes of their feature row, and won: 1 if the price rose from entry to settlement, -1 if it fell."""
    f = coded_rows(spark, d)
    o = table(spark, d, "outcomes").where("reason = 0").select("outcome_id", "feature_id", "entry_tick_id", "settlement_tick_id")
    t = table(spark, d, "ticks").where("price is not null").select("tick_id", "price")
    x = o.join(t.select(F.col("tick_id").alias("entry_tick_id"), F.col("price").alias("p0")), "entry_tick_id").join(t.select(F.col("tick_id").alias("settlement_tick_id"), F.col("price").alias("p1")), "settlement_tick_id").join(f, "feature_id")
    return x.withColumn("won", F.signum(F.col("p1") - F.col("p0")).cast("int"))


CODED = ["dir", "ret", "body", "act"]


def posting_lists(spark: SparkSession, d: str) -> DataFrame:
    return search.posting_lists(_coded(spark, d), CODED)


def combination_scores(spark: SparkSession, d: str) -> DataFrame:
    return search.combinations(_coded(spark, d), CODED)


def _tests(spark: SparkSession, d: str) -> DataFrame:
    return search.adjusted(search.tested(search.combinations(_coded(spark, d), CODED), 100 / 192))


def binomial_tails(spark: SparkSession, d: str) -> DataFrame:
    return search.tested(search.combinations(_coded(spark, d), CODED), 100 / 192).select("conditions", "wins", "losses", F.round("p_value", 8).alias("p_value"))


def adjusted_tests(spark: SparkSession, d: str) -> DataFrame:
    return _tests(spark, d).select("conditions", "rank", F.round("adjusted", 7).alias("adjusted"))


def screened_top(spark: SparkSession, d: str) -> DataFrame:
    return search.screened(_tests(spark, d), 1.0, 25).select("conditions", "size", "n", "wins", "losses", "rank")


def one_at_a_time(spark: SparkSession, d: str) -> DataFrame:
    t = _trades(spark, d)
    return search.one_at_a_time(t.select(F.col("path").alias("candidate"), F.col("feature_id").alias("row"), F.col("entry_micros").alias("entry"), F.col("settlement_micros").alias("release")))


PATH_ORDER = ["entry_micros", "feature_id"]


def path_drawdowns(spark: SparkSession, d: str) -> DataFrame:
    return paths.drawdowns(_trades(spark, d), "path", PATH_ORDER, "value")


def path_streaks(spark: SparkSession, d: str) -> DataFrame:
    return paths.streaks(_trades(spark, d), "path", PATH_ORDER, "value")


def path_worst_sums(spark: SparkSession, d: str) -> DataFrame:
    return paths.worst_sums(_trades(spark, d), "path", PATH_ORDER, "value", (5, 10, 20))


def bootstrap_paths(spark: SparkSession, d: str) -> DataFrame:
    """Bootstraps the trades of each path (generation and expiry), 200 replicates of each."""
    return paths.bootstrap_trades(_trades(spark, d), "path", PATH_ORDER, "value", 200, 5, 10)


def grouped_results(spark: SparkSession, d: str) -> DataFrame:
    t = _trades(spark, d).withColumn("expiry_seconds", F.col("expiry_seconds").cast("int"))
    sets = t.groupingSets([[], ["generation"], ["expiry_seconds"], ["outcome"]], "generation", "expiry_seconds", "outcome")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.count_if(F.col("value") > 0).alias("wins"))


WEEKLY = sessions.Weekly(closed=("2017-01-16",), early={"2017-01-20": 13 * 3600})


def session_membership(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candles").select("candle_id", F.unix_micros("open_time_micros").alias("t"))
    at = sessions.local_time(F.col("t"), WEEKLY.zone)
    return c.select("candle_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("local_time"), sessions.in_session(F.col("t"), WEEKLY).alias("inside"))


def _bars(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candles")
    return c.select("generation", F.unix_micros("open_time_micros").alias("open_micros"), "open_units", "high_units", "low_units", "close_units", F.col("observations").cast("bigint").alias("observations"), sessions.fill_kind(c).alias("fill"))


def continuous_grid(spark: SparkSession, d: str) -> DataFrame:
    return sessions.continuous(_bars(spark, d))


def fill_kinds(spark: SparkSession, d: str) -> DataFrame:
    return sessions.continuous(_bars(spark, d)).groupBy("generation", "fill").agg(F.count(F.lit(1)).alias("n"), F.sum("observations").alias("observations"))


def _days(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "day_inventory")
    days = t.select("generation", "family", coverage.day_start(F.col("day_date")).alias("day"), F.col("row_count").alias("n_rows")).where("day is not null")
    spans = t.select("generation", "family", F.explode("unresolved").alias("u")).select("generation", "family", instant_micros(F.col("u.span_start")).alias("start"), instant_micros(F.col("u.span_end")).alias("end"))
    return days, spans


def coverage_day_states(spark: SparkSession, d: str) -> DataFrame:
    return coverage.day_states(*_days(spark, d), ["generation", "family"])


def coverage_complement(spark: SparkSession, d: str) -> DataFrame:
    return coverage.known_spans(_days(spark, d)[1], ["generation", "family"])


def coverage_containment(spark: SparkSession, d: str) -> DataFrame:
    days, spans = _days(spark, d)
    ranges = days.select("generation", "family", F.col("day").alias("start"), (F.col("day") + 3_600_000_000).alias("end")).distinct()
    return coverage.covered(ranges, spans, ["generation", "family"])


def role_split_days(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candles").select("generation", F.to_date("open_time_micros").alias("day"))
    windows = {"development": ("2017-01-01", "2017-01-15"), "evaluation": ("2017-01-15", "2017-02-01"), "holdout": ("2017-02-01", "2017-03-01")}
    return coverage.by_role(c, "day", windows).groupBy("role", "day").agg(F.count(F.lit(1)).alias("n"))


def newest_inventory(spark: SparkSession, d: str) -> DataFrame:
    return coverage.newest(table(spark, d, "day_inventory").select("generation", "day_date", "inventory_id", "state", "row_count"), "generation", "day_date", "inventory_id")


def bar_problems(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candles").select("candle_id", F.unix_micros("open_time_micros").alias("start_micros"), *[F.col(f"{k}_units").cast("double").alias(k) for k in ("open", "high", "low", "close")], "volume")
    return files.bar_problems(c, 60).where("problem is not null").select("candle_id", "problem")


def decimal_prices(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ticks", "tick_id", "price").where("price is not null")
    units = decimal_units(F.round("price", 5).cast("decimal(28,5)").cast("string"), 5)
    return rows.select("tick_id", units.alias("units"), decimal_text(units, 5).alias("text"))


def timestamp_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ticks", "tick_id", "event_time_micros").where("event_time_micros is not null")
    text = event_text(F.unix_micros("event_time_micros"))
    return rows.select("tick_id", text.alias("text"), event_micros(text).alias("micros"))


def page_digests(spark: SparkSession, d: str) -> DataFrame:
    return pages.digests(table(spark, d, "raw_pages"))


def page_ticks(spark: SparkSession, d: str) -> DataFrame:
    return pages.decoded(table(spark, d, "raw_pages"))


def _kept_rows(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "raw_pages")
    rows = pages.decoded(first)
    keep = rows.groupBy("acquisition", "ordinal", "digest").agg(F.min("delivery_id").alias("delivery_id"))
    on = [rows[c].eqNullSafe(keep[c]) for c in ("acquisition", "ordinal", "digest")]
    return rows.join(keep, [*on, rows["delivery_id"] == keep["delivery_id"]], "left_semi").drop("delivery_id")


def page_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return pages.without_overlap(_kept_rows(spark, d)).groupBy("acquisition", "ordinal", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("dropped"))


def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """Hourly sums of events by type, tumbling windows shifted by half an hour."""
    e = table(spark, d, "events", "ts", "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    w = F.window("ts", "1 hour", "1 hour", "30 minutes")
    return e.groupBy(F.unix_micros(w["start"]).alias("start_micros"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


def stream_candles(spark: SparkSession, d: str) -> DataFrame:
    return jobs.run_to_end(jobs.candle_stream(jobs.tick_stream(spark, f"{d}/ticks.parquet")), "stream-candles")


def stream_retractions(spark: SparkSession, d: str) -> DataFrame:
    """What the retractions of the ticks, streamed in files, leave of each period: its last version and the signed sums."""
    changes = jobs.run_to_end(jobs.retractions(jobs.tick_stream(spark, f"{d}/ticks.parquet"), table(spark, d, "raw_pages")), "stream-retractions")
    sums = [F.sum(F.col("change") * F.col(c)).alias(c) for c in ("n", "n_values")]
    return changes.groupBy("generation", "period_start_micros").agg(*sums, F.round(F.sum(F.col("change") * F.col("total")), 3).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        outcome_matrix, outcomes_from_bars, outcome_summary, trade_paths, availability_asof, fixed_bins, development_fifths, category_labels, encode_apply, posting_lists, combination_scores, binomial_tails, adjusted_tests, screened_top, one_at_a_time,
        path_drawdowns, path_streaks, path_worst_sums, bootstrap_paths, grouped_results, session_membership, continuous_grid, fill_kinds, coverage_day_states, coverage_complement, coverage_containment, role_split_days, newest_inventory,
        bar_problems, decimal_prices, timestamp_roundtrip, page_digests, page_ticks, page_overlaps, event_properties, stream_candles, stream_retractions,
    )
}

MARKED = (
    MOVED
    + """,
f0 AS (SELECT *, coalesce(delta > 60000000, false) AS gap, coalesce(delta <= 30000000 AND before <> 0 AND abs(units - before) * 10000 >= 60 * abs(before), false) AS jmp,
  count(*) OVER (PARTITION BY generation, run) >= 12 OR max(t) OVER (PARTITION BY generation, run) - min(t) OVER (PARTITION BY generation, run) >= 180000000 AS frz FROM mv),
f1 AS (SELECT *, sum(CAST(gap AS INT)) OVER w AS gaps, sum(CAST(jmp AS INT)) OVER w AS jumps, sum(CAST(frz AS INT)) OVER w AS frozen FROM f0 WINDOW w AS (PARTITION BY generation ORDER BY t, seq)),
tk AS (SELECT *, frozen - CAST(frz AS INT) AS frozen_before FROM f1 WHERE NOT duplicate),
rf AS (SELECT feature_id, generation, epoch_us(close_time_micros) AS ref FROM feature_rows WHERE close_time_micros IS NOT NULL),
en AS (SELECT rf.*, k.t AS et, k.seq AS entry_seq, k.units AS eu, k.gaps AS eg, k.jumps AS ej, k.frozen_before AS ef, e.x AS expiry_seconds, k.t + e.x * 1000000 AS due FROM rf ASOF LEFT JOIN tk k ON rf.generation = k.generation AND rf.ref <= k.t CROSS JOIN (SELECT unnest([30, 60, 120]) AS x) e),
lb AS (SELECT en.*, s.t AS st, s.seq AS settlement_seq, s.units AS su, CASE WHEN et IS NULL THEN 1 WHEN et - ref > 20000000 THEN 2 WHEN s.t IS NULL THEN 3 WHEN s.t - due > 20000000 THEN 4 WHEN s.gaps > eg THEN 5 WHEN s.frozen > ef THEN 6 WHEN s.jumps > ej THEN 7 ELSE 0 END AS reason
  FROM en ASOF LEFT JOIN tk s ON en.generation = s.generation AND en.due <= s.t),
lo AS (SELECT *, CASE WHEN reason = 0 THEN CASE WHEN su > eu THEN 'buy_win' WHEN su < eu THEN 'sell_win' ELSE 'tie' END END AS outcome FROM lb),
tr AS (SELECT *, CASE outcome WHEN 'buy_win' THEN 92 WHEN 'sell_win' THEN -100 ELSE 0 END AS value, generation || '/' || expiry_seconds AS path FROM lo WHERE reason = 0)"""
)
_BAR_MARKED = (
    "acc AS (SELECT generation, candle_id AS seq, epoch_us(close_time_micros) AS t, close_units AS units FROM candles WHERE close_time_micros IS NOT NULL AND close_units IS NOT NULL)"
    + MARKED[len(ACCEPTED) :].replace("delta > 60000000", "delta > 180000000").replace("delta <= 30000000 AND before <> 0", "delta <= 90000000 AND before <> 0").replace(">= 180000000 AS frz", ">= 900000000 AS frz").replace("[30, 60, 120]", "[60, 120, 300]").replace("> 20000000", "> 90000000")
)
_COUNTS = ", ".join([f"count(*) FILTER (WHERE reason = {k}) AS {r}" for k, r in enumerate(outcomes.REASONS)] + [f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in ("buy_win", "sell_win", "tie")])


def _bin_sql(c: str) -> str:
    e = encodings.BINS[c]
    text = " ".join(f"WHEN {c} <= {b} THEN '{encodings.general(a)}_to_{encodings.general(b)}'" if b != encodings.INF else f"ELSE '{encodings.general(a)}_to_{encodings.general(b)}'" for a, b in zip(e, e[1:]))
    low = "" if e[0] == -encodings.INF else f" OR {c} < {e[0]}"
    return f"CASE WHEN {c} IS NULL{low} THEN NULL {text} END AS {c}_bucketed"


_LABELS = lambda cols, where="": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS label FROM feature_rows {where}" for c in cols)
_FITTED = lambda cols, where="": f"pairs AS ({_LABELS(cols, where)}), counts AS (SELECT \"column\", label, count(*) AS n FROM pairs WHERE label NOT IN ('', 'missing', 'none', '<NA>', 'nan', 'NaT') GROUP BY 1, 2), fitted AS (SELECT \"column\", label, CAST(row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, label) - 1 AS INT) AS code, n FROM counts QUALIFY code < 32768)"
CODES = """
f AS (SELECT feature_id, CASE WHEN direction = 'up' THEN 1 WHEN direction = 'down' THEN 2 WHEN direction IS NOT NULL THEN 0 END AS dir, CAST(return_1_bps > -5 AS INT) + CAST(return_1_bps > -1 AS INT) + CAST(return_1_bps > 1 AS INT) + CAST(return_1_bps > 5 AS INT) AS ret,
  CAST(body_bps > 1 AS INT) + CAST(body_bps > 3 AS INT) + CAST(body_bps > 8 AS INT) AS body, CAST(activity_score > 0.5 AS INT) + CAST(activity_score > 1 AS INT) + CAST(activity_score > 2 AS INT) AS act FROM feature_rows),
coded AS (SELECT f.*, CAST(sign(b.price - a.price) AS INT) AS won FROM outcomes o JOIN ticks a ON a.tick_id = o.entry_tick_id AND a.price IS NOT NULL JOIN ticks b ON b.tick_id = o.settlement_tick_id AND b.price IS NOT NULL JOIN f ON f.feature_id = o.feature_id WHERE o.reason = 0)"""


def _combination_sql() -> str:
    import itertools

    parts = []
    for k in (1, 2, 3):
        for p in itertools.combinations(CODED, k):
            name = " || '&' || ".join(f"'{c}=' || {c}" for c in p)
            parts.append(f"SELECT {name} AS conditions, CAST({k} AS INT) AS size, won FROM coded WHERE {' AND '.join(f'{c} IS NOT NULL' for c in p)}")
    return f"{CODES}, cond AS ({' UNION ALL '.join(parts)}), score AS (SELECT conditions, size, count(*) AS n, count(*) FILTER (WHERE won > 0) AS wins, count(*) FILTER (WHERE won < 0) AS losses, count(*) FILTER (WHERE won = 0) AS ties FROM cond GROUP BY 1, 2)"


COMBINED = _combination_sql()
TAIL = (
    COMBINED
    + f""",
tail AS (SELECT *, CASE WHEN wins + losses = 0 OR wins = 0 THEN 1.0 ELSE round(least(1.0, list_sum(list_transform(range(wins, wins + losses + 1), lambda k: exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1) + k * ln({100 / 192}) + (wins + losses - k) * ln({1 - 100 / 192}))))), 12) END AS p_value FROM score),
ranked AS (SELECT *, row_number() OVER (ORDER BY p_value, conditions) AS rank, count(*) OVER () AS m FROM tail),
adj AS (SELECT *, least(1.0, min(p_value * m / rank) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adjusted FROM ranked)"""
)
_EQUITY = """,
eq AS (SELECT *, sum(value) OVER w AS equity, row_number() OVER w AS no FROM tr WINDOW w AS (PARTITION BY path ORDER BY et, feature_id)),
pk AS (SELECT *, greatest(max(equity) OVER (PARTITION BY path ORDER BY no), 0) - equity AS dd FROM eq),
uw AS (SELECT *, no - coalesce(max(CASE WHEN dd <= 0 THEN no END) OVER (PARTITION BY path ORDER BY no), 0) AS under FROM pk)"""
_SPANS = "sp AS (SELECT generation, family, epoch_us(CAST(u.span_start AS TIMESTAMPTZ)) AS s, epoch_us(CAST(u.span_end AS TIMESTAMPTZ)) AS e FROM (SELECT generation, family, unnest(unresolved) AS u FROM day_inventory)), rc AS (SELECT *, max(e) OVER (PARTITION BY generation, family ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM sp WHERE s < e), il AS (SELECT *, sum(CASE WHEN m IS NULL OR m < s THEN 1 ELSE 0 END) OVER (PARTITION BY generation, family ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM rc), pd AS (SELECT generation, family, min(s) AS s, max(e) AS e FROM il GROUP BY generation, family, g)"
_GRID = """
g0 AS (SELECT generation, epoch_us(open_time_micros) AS open_micros, open_units, high_units, low_units, close_units, CAST(observations AS BIGINT) AS observations, CASE WHEN open_units = high_units AND open_units = low_units AND open_units = close_units AND volume = 0 THEN 'source' ELSE 'none' END AS fill FROM candles),
g1 AS (SELECT *, lead(open_micros) OVER (PARTITION BY generation ORDER BY open_micros) AS nxt FROM g0),
g AS (SELECT generation, open_micros, open_units, high_units, low_units, close_units, observations, fill FROM g0 UNION ALL SELECT generation, unnest(range(open_micros + 60000000, nxt, 60000000)), close_units, close_units, close_units, close_units, 0, 'engine' FROM g1 WHERE nxt > open_micros + 60000000)"""

_ONE_AT_A_TIME = """o1 AS MATERIALIZED (SELECT path AS candidate, feature_id AS "row", et AS entry, st AS release, value, row_number() OVER (PARTITION BY path ORDER BY et, feature_id) AS rn FROM tr),
o2 AS MATERIALIZED (SELECT a.candidate, a.rn, min(b.rn) AS nrn FROM o1 a JOIN o1 b ON a.candidate = b.candidate AND b.rn > a.rn AND b.entry >= a.release GROUP BY 1, 2),
o3 AS (SELECT candidate, CAST(1 AS BIGINT) AS rn FROM o1 WHERE rn = 1 UNION ALL SELECT n.candidate, n.nrn FROM o3 t JOIN o2 n ON n.candidate = t.candidate AND n.rn = t.rn)"""

ORACLES = {
    "outcome_matrix": f"WITH {MARKED} SELECT feature_id, CAST(expiry_seconds AS INT) AS expiry_seconds, entry_seq, settlement_seq, CAST(reason AS INT) AS reason, outcome FROM lo",
    "outcomes_from_bars": f"WITH {_BAR_MARKED} SELECT feature_id, CAST(expiry_seconds AS INT) AS expiry_seconds, entry_seq, settlement_seq, CAST(reason AS INT) AS reason, outcome FROM lo",
    "outcome_summary": f"WITH {MARKED} SELECT CAST(expiry_seconds AS INT) AS expiry_seconds, count(*) AS n, {_COUNTS} FROM lo GROUP BY 1",
    "trade_paths": f"WITH {MARKED}, j AS (SELECT feature_id || '/' || expiry_seconds AS trade_id, mv.t, mv.units - eu AS m FROM tr JOIN mv ON mv.generation = tr.generation AND mv.t > tr.et AND mv.t <= tr.st) SELECT trade_id, count(*) AS n_ticks, max(m) AS best_units, min(m) AS worst_units, arg_max(t, (m, -t)) AS best_micros, arg_min(t, (m, t)) AS worst_micros FROM j GROUP BY 1",
    "availability_asof": """
WITH c AS (SELECT generation, epoch_us(known_at_micros) AS k, max(candle_id) AS candle_id, arg_max(epoch_us(close_time_micros), candle_id) AS z FROM candles WHERE known_at_micros IS NOT NULL GROUP BY 1, 2), b AS (SELECT feature_id, generation, epoch_us(known_at_micros) AS k, epoch_us(close_time_micros) AS z FROM feature_rows)
SELECT feature_id, candle_id, c.z <= b.z AS usable FROM b ASOF LEFT JOIN c ON b.generation = c.generation AND b.k >= c.k""",
    "fixed_bins": f"SELECT feature_id, {_bin_sql('return_1_bps')}, {_bin_sql('body_bps')} FROM feature_rows",
    "development_fifths": "WITH q AS (SELECT instrument, quantile_cont(activity_score, [0.2, 0.4, 0.6, 0.8]) AS c FROM feature_rows WHERE activity_score IS NOT NULL GROUP BY 1 HAVING count(DISTINCT activity_score) >= 4), u AS (SELECT instrument, list_sort(list_distinct(c)) AS c FROM q) SELECT instrument, CAST(i - 1 AS INT) AS place, round(c[i], 6) AS cut FROM (SELECT instrument, c, unnest(range(1, len(c) + 1)) AS i FROM u)",
    "category_labels": f"WITH {_FITTED(('direction', 'stream_key', 'instrument'))} SELECT \"column\", label, code, n FROM fitted",
    "encode_apply": "WITH " + _FITTED(("direction", "instrument"), "WHERE written_at < TIMESTAMPTZ '2017-01-20 00:00:00+00'") + " SELECT feature_id, coalesce(a.code, -1) AS direction_code, coalesce(b.code, -1) AS instrument_code FROM feature_rows LEFT JOIN fitted a ON a.\"column\" = 'direction' AND a.label = direction LEFT JOIN fitted b ON b.\"column\" = 'instrument' AND b.label = instrument",
    "posting_lists": f"WITH {CODES}, p AS ({' UNION ALL '.join(f'''SELECT '{c}' AS \"column\", {c} AS code FROM coded WHERE {c} IS NOT NULL''' for c in CODED)}), n AS (SELECT \"column\", CAST(code AS INT) AS code, count(*) AS n FROM p GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY \"column\" ORDER BY n, code) AS INT) AS rank FROM n",
    "combination_scores": f"WITH {COMBINED} SELECT * FROM score",
    "binomial_tails": f"WITH {TAIL} SELECT conditions, wins, losses, round(p_value, 8) AS p_value FROM tail",
    "adjusted_tests": f"WITH {TAIL} SELECT conditions, rank, round(adjusted, 7) AS adjusted FROM adj",
    "screened_top": f"WITH {TAIL} SELECT conditions, size, n, wins, losses, rank FROM adj WHERE adjusted <= 1.0 AND rank <= 25",
    "path_drawdowns": f"WITH {MARKED}{_EQUITY} SELECT path, count(*) AS n, CAST(sum(value) AS BIGINT) AS total, CAST(max(dd) AS BIGINT) AS max_drawdown, round(sqrt(avg(pow(dd, 2))), 6) AS ulcer, max(under) AS longest_underwater FROM uw GROUP BY 1",
    "path_streaks": f"WITH {MARKED}, n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY et, feature_id) - row_number() OVER (PARTITION BY path, sign(value) ORDER BY et, feature_id) AS r FROM tr), s AS (SELECT path, sign(value) AS s, r, count(*) AS n FROM n GROUP BY 1, 2, 3) SELECT path, coalesce(max(n) FILTER (WHERE s < 0), 0) AS loss_streak, coalesce(max(n) FILTER (WHERE s > 0), 0) AS win_streak FROM s GROUP BY 1",
    "path_worst_sums": f"WITH {MARKED}, s AS (SELECT path, " + ", ".join(f"CASE WHEN count(*) OVER (PARTITION BY path ORDER BY et, feature_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN sum(value) OVER (PARTITION BY path ORDER BY et, feature_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS s{n}" for n in (5, 10, 20)) + " FROM tr) SELECT path, CAST(min(s5) AS BIGINT) AS worst_5, CAST(min(s10) AS BIGINT) AS worst_10, CAST(min(s20) AS BIGINT) AS worst_20 FROM s GROUP BY 1",
    "grouped_results": f"WITH {MARKED} SELECT generation, CAST(expiry_seconds AS INT) AS expiry_seconds, outcome, count(*) AS n, CAST(sum(value) AS BIGINT) AS total, count(*) FILTER (WHERE value > 0) AS wins FROM tr GROUP BY GROUPING SETS ((), (generation), (expiry_seconds), (outcome))",
    "session_membership": """
WITH l AS (SELECT candle_id, timezone('America/New_York', open_time_micros) AS x FROM candles), s AS (SELECT *, hour(x) * 3600 + minute(x) * 60 + second(x) AS s, CASE WHEN CAST(x AS DATE) = DATE '2017-01-20' THEN 46800 ELSE 57600 END AS z FROM l)
SELECT candle_id, strftime(x, '%Y-%m-%d %H:%M:%S') AS local_time, coalesce(isodow(x) <= 5 AND s >= 34200 AND s <= z AND CAST(x AS DATE) <> DATE '2017-01-16', false) AS inside FROM s""",
    "continuous_grid": f"WITH {_GRID} SELECT * FROM g",
    "fill_kinds": f"WITH {_GRID} SELECT generation, fill, count(*) AS n, CAST(sum(observations) AS BIGINT) AS observations FROM g GROUP BY 1, 2",
    "coverage_day_states": f"""
WITH {_SPANS}, x AS (SELECT *, unnest(range(s // {DAY}, (e - 1) // {DAY} + 1)) * {DAY} AS day FROM pd), o AS (SELECT generation, family, day, CAST(sum(least(e, day + {DAY}) - greatest(s, day)) AS BIGINT) AS unresolved_micros FROM x GROUP BY 1, 2, 3),
d AS (SELECT generation, family, epoch_us(CAST(day_date AS TIMESTAMP)) AS day, CAST(sum(coalesce(row_count, 0)) AS BIGINT) AS n_rows FROM day_inventory WHERE day_date IS NOT NULL GROUP BY 1, 2, 3)
SELECT d.generation, d.family, d.day, n_rows, coalesce(unresolved_micros, 0) AS unresolved_micros, CASE WHEN coalesce(unresolved_micros, 0) >= {DAY} THEN 'unknown' WHEN coalesce(unresolved_micros, 0) > 0 THEN 'partial' WHEN n_rows > 0 THEN 'complete' ELSE 'empty_known' END AS state FROM d LEFT JOIN o ON o.generation = d.generation AND o.family = d.family AND o.day = d.day""",
    "coverage_complement": f"WITH {_SPANS} SELECT generation, family, e AS start, nxt AS \"end\" FROM (SELECT *, lead(s) OVER (PARTITION BY generation, family ORDER BY s) AS nxt FROM pd) WHERE nxt IS NOT NULL",
    "coverage_containment": f"WITH {_SPANS}, r AS (SELECT DISTINCT generation, family, epoch_us(CAST(day_date AS TIMESTAMP)) AS start FROM day_inventory WHERE day_date IS NOT NULL) SELECT r.generation, r.family, r.start, r.start + 3600000000 AS \"end\", EXISTS (SELECT 1 FROM pd WHERE pd.generation = r.generation AND pd.family = r.family AND pd.s <= r.start AND pd.e >= r.start + 3600000000) AS contained FROM r",
    "role_split_days": "WITH c AS (SELECT CAST(open_time_micros AS DATE) AS day FROM candles), r AS (SELECT day, CASE WHEN day >= DATE '2017-01-01' AND day < DATE '2017-01-15' THEN 'development' WHEN day >= DATE '2017-01-15' AND day < DATE '2017-02-01' THEN 'evaluation' WHEN day >= DATE '2017-02-01' AND day < DATE '2017-03-01' THEN 'holdout' END AS role FROM c) SELECT role, day, count(*) AS n FROM r WHERE role IS NOT NULL GROUP BY 1, 2",
    "newest_inventory": "SELECT generation, day_date, inventory_id, state, row_count FROM day_inventory QUALIFY row_number() OVER (PARTITION BY generation ORDER BY day_date DESC NULLS LAST, inventory_id DESC) = 1",
    "bar_problems": "SELECT candle_id, problem FROM (SELECT candle_id, CASE WHEN open_units IS NULL OR high_units IS NULL OR low_units IS NULL OR close_units IS NULL OR open_time_micros IS NULL THEN 'missing_value' WHEN volume < 0 THEN 'negative_volume' WHEN high_units < greatest(open_units, close_units) THEN 'high_too_low' WHEN low_units > least(open_units, close_units) THEN 'low_too_high' WHEN epoch_us(open_time_micros) % 60000000 <> 0 THEN 'off_grid' END AS problem FROM candles) WHERE problem IS NOT NULL",
    "decimal_prices": "SELECT tick_id, CAST(round(round(price, 5) * 100000) AS BIGINT) AS units, CAST(CAST(round(price, 5) AS DECIMAL(28,5)) AS VARCHAR) AS text FROM ticks WHERE price IS NOT NULL",
    "timestamp_roundtrip": "SELECT tick_id, strftime(event_time_micros, '%Y-%m-%dT%H:%M:%S.%fZ') AS text, epoch_us(event_time_micros) AS micros FROM ticks WHERE event_time_micros IS NOT NULL",
    "page_digests": "SELECT delivery_id, sha256(payload) = regexp_replace(regexp_replace(lower(payload_sha256), '^\\s+|\\s+$', '', 'g'), '^(sha-?256\\s*[:=]\\s*)?(0x)?', '') AS intact FROM raw_pages",
    "event_properties": "SELECT epoch_us(ts) - (epoch_us(ts) - 1800000000) % 3600000000 AS start_micros, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2",
    "stream_retractions": """
WITH pages AS (SELECT regexp_replace(lower(acquisition_id), '^\\s+|\\s+$', '', 'g') AS a, ordinal AS o, min(epoch_us(receipt_time_utc)) AS k FROM raw_pages WHERE receipt_time_utc IS NOT NULL GROUP BY 1, 2),
t AS (SELECT generation, price, CAST(floor(epoch_us(event_time_micros) / 300000000) AS BIGINT) * 300000000 AS p, coalesce(epoch_us(known_at_micros), k) AS arrival FROM ticks LEFT JOIN pages ON a = regexp_replace(lower(acquisition_id), '^\\s+|\\s+$', '', 'g') AND o = page_ordinal WHERE event_time_micros IS NOT NULL)
SELECT generation, p AS period_start_micros, count(*) AS n, count(price) AS n_values, round(coalesce(sum(price), 0.0), 3) AS total FROM t WHERE arrival <= p + 2100000000 GROUP BY 1, 2""",
    "page_ticks": """
WITH d AS (SELECT delivery_id, regexp_replace(lower(acquisition_id), '^\\s+|\\s+$', '', 'g') AS acquisition, ordinal, regexp_replace(regexp_replace(lower(payload_sha256), '^\\s+|\\s+$', '', 'g'), '^(sha-?256\\s*[:=]\\s*)?(0x)?', '') AS digest, payload FROM raw_pages),
j AS (SELECT delivery_id, acquisition, ordinal, digest, CAST(decode(payload) AS JSON) AS p FROM d WHERE sha256(payload) = digest),
a AS (SELECT delivery_id, acquisition, ordinal, digest, CAST(p -> '$.history.times' AS BIGINT[]) AS t, CAST(p -> '$.history.prices' AS VARCHAR[]) AS x FROM j),
r AS (SELECT *, unnest(range(0, len(t))) AS place FROM a WHERE len(t) = len(x))
SELECT delivery_id, acquisition, ordinal, digest, CAST(place AS INT) AS place, t[place + 1] AS t_millis, x[place + 1] AS price FROM r""",
    "one_at_a_time": f"""
WITH RECURSIVE {MARKED}, {_ONE_AT_A_TIME}
SELECT o1.candidate, "row", o3.rn IS NOT NULL AS kept FROM o1 LEFT JOIN o3 ON o3.candidate = o1.candidate AND o3.rn = o1.rn""",
}
ORACLES["page_overlaps"] = ORACLES["page_ticks"].replace("SELECT delivery_id, acquisition, ordinal, digest, CAST(place AS INT) AS place, t[place + 1] AS t_millis, x[place + 1] AS price FROM r", """
SELECT acquisition, ordinal, digest, CAST(len(v) - dropped AS BIGINT) AS n, CAST(dropped AS INT) AS dropped FROM (
  SELECT *, CASE WHEN b IS NULL THEN 0 ELSE coalesce(list_max(list_filter(range(1, least(len(v), len(b)) + 1), lambda k: v[1 : k] = b[len(b) - k + 1 : len(b)])), 0) END AS dropped FROM (
    SELECT *, lag(v) OVER (PARTITION BY acquisition ORDER BY ordinal NULLS FIRST, digest NULLS FIRST) AS b FROM (
      SELECT acquisition, ordinal, digest, list({'t': t[place + 1], 'x': x[place + 1]} ORDER BY place) AS v FROM r WHERE delivery_id IN (SELECT min(delivery_id) FROM a WHERE len(t) = len(x) AND len(t) > 0 GROUP BY acquisition, ordinal, digest) GROUP BY 1, 2, 3)))
WHERE len(v) > dropped""")
