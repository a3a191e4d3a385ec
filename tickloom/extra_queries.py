"""Further queries: conversions by the latest rate, capacity, scores, table checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import asof, capacity, coverage, search
from .research_queries import CODED, CODES, MARKED, _ONE_AT_A_TIME, _labels, _trades, coded_rows
from .session import written
from .sources import table, verify

MONTH = 30 * 86_400_000_000


def converted_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Orders valued at the latest event at or before them, if it isn't too old. The events are one series of rates."""
    e = table(spark, d, "events", "event_id", "ts", "event_type", "value").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("cur", F.lit("0")).where("event_type is not null")
    lo = e.agg(F.min("t")).collect()[0][0] or 0
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice").withColumn("cur", F.lit("0")).withColumn("at", F.lit(lo) + F.col("o_orderkey") * F.lit(1_000_000))
    x = asof.asof(o, e, "cur", "at", "t", ["value"], "rate", tie="event_id")
    fresh = asof.at_most(F.col("rate.value"), F.col("at") - F.col("rate.t"), 300_000_000)
    return x.select("o_orderkey", F.round(F.col("o_totalprice") * fresh, 4).alias("amount"))


def capacity_admissions(spark: SparkSession, d: str) -> DataFrame:
    t = _trades(spark, d).select(F.lit("all").alias("portfolio"), F.col("feature_id").alias("row"), F.col("entry_micros").alias("entry"), F.col("settlement_micros").alias("due"), F.col("expiry_seconds").alias("kind"))
    return capacity.admitted(t.withColumn("portfolio", F.concat(F.lit("p"), F.pmod("row", F.lit(16)).cast("string"))), 8, 3)


def capacity_one_scores(spark: SparkSession, d: str) -> DataFrame:
    t = _trades(spark, d)
    return capacity.scores(t.select(F.col("path").alias("candidate"), F.col("feature_id").alias("row"), F.col("entry_micros").alias("entry"), F.col("settlement_micros").alias("release"), "value"))


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """Labels of all expiries as signals of every candidate: one or two conditions and an expiry. Decisions before 17 January only warm up."""
    labels = _labels(spark, d)
    rows = labels.join(coded_rows(spark, d), "feature_id").select(
        F.col("feature_id").alias("row"), "expiry_seconds", F.when(F.coalesce("entry_micros", "reference_micros") < 1_484_611_200_000_000, 2).otherwise(1).alias("scope"), F.coalesce("entry_micros", "reference_micros").alias("entry"),
        F.coalesce("settlement_micros", F.lit(0)).alias("release"), F.coalesce("settlement_micros", F.lit(0)).alias("settlement"), (F.col("reason") == 0).alias("valid"), *[F.coalesce(F.col("outcome") == k, F.lit(False)).alias(n) for n, k in (("tie", "tie"), ("buy_win", "buy_win"), ("sell_win", "sell_win"))], *CODED,
    )
    rows = written(rows, "rows")
    menu = search.posting_lists(rows, CODED).select("column", "code")
    one = search.candidates(menu, 1, 2).select(F.concat_ws("&", "conditions").alias("name"), "conditions")
    met = search.matched(rows, CODED, one.select(F.col("name").alias("candidate"), "conditions"))
    return met.withColumn("candidate", F.concat_ws("/", "candidate", "expiry_seconds")).drop(*CODED)


def cap1_scores(spark: SparkSession, d: str) -> DataFrame:
    return capacity.score_signals(_signals(spark, d))


def cap1_counters(spark: SparkSession, d: str) -> DataFrame:
    """Short scores of one side each, as they come without the other."""
    s = _signals(spark, d)
    return capacity.score_signals(s, ("buy",), full=False).unionByName(capacity.score_signals(s, ("sell",), full=False))


def cap1_signal_masks(spark: SparkSession, d: str) -> DataFrame:
    return capacity.taken_signals(_signals(spark, d)).where("kept and scope = 1").select("candidate", "row")


def table_outlines(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name, time: verify.outline(table(spark, d, name), time).select(F.lit(name).alias("table"), "n_rows", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "without_time")
    return one("ticks", "event_time_micros").unionByName(one("candles", "open_time_micros")).unionByName(one("raw_pages", "receipt_time_utc"))


def newest_manifests(spark: SparkSession, d: str) -> DataFrame:
    """The newest live manifest of each instrument."""
    g = table(spark, d, "generations").where("retired_at is null").select("instrument", "generation", "published_at", "price_scale")
    return coverage.newest(g, "instrument", "published_at", "generation").select("instrument", "generation", "price_scale")


QUERIES = {f.__name__: f for f in (converted_amounts, capacity_admissions, capacity_one_scores, cap1_scores, cap1_counters, cap1_signal_masks, table_outlines, newest_manifests)}

_CONDITIONS = " UNION ALL ".join(f"SELECT feature_id, '{c}' AS c, '{c}=' || {c} AS v FROM f WHERE {c} IS NOT NULL" for c in CODED)
_SIGNALS = f"""WITH RECURSIVE {MARKED}, {CODES},
lx AS (SELECT feature_id AS "row", expiry_seconds, coalesce(et, ref) AS entry, coalesce(st, 0) AS release, reason = 0 AS valid, coalesce(outcome = 'tie', false) AS tie, coalesce(outcome = 'buy_win', false) AS bw, coalesce(outcome = 'sell_win', false) AS sw FROM lo),
cn AS ({_CONDITIONS}),
cd AS (SELECT feature_id, v AS name FROM cn UNION ALL SELECT a.feature_id, least(a.v, b.v) || '&' || greatest(a.v, b.v) FROM cn a JOIN cn b ON a.feature_id = b.feature_id AND a.v < b.v AND a.c <> b.c),
sg AS MATERIALIZED (SELECT name || '/' || expiry_seconds AS candidate, lx.*, CASE WHEN entry < 1484611200000000 THEN 2 ELSE 1 END AS scope FROM lx JOIN cd ON cd.feature_id = lx."row"),
el AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY entry, "row") AS rn FROM sg WHERE release > 0),
nx AS MATERIALIZED (SELECT a.candidate, a.rn, min(b.rn) AS nrn FROM el a JOIN el b ON a.candidate = b.candidate AND b.rn > a.rn AND b.entry >= a.release GROUP BY 1, 2),
tk2 AS (SELECT candidate, CAST(1 AS BIGINT) AS rn FROM el WHERE rn = 1 UNION ALL SELECT n.candidate, n.nrn FROM tk2 t JOIN nx n ON n.candidate = t.candidate AND n.rn = t.rn),
tkn AS MATERIALIZED (SELECT sg.*, tk.rn IS NOT NULL AS kept FROM sg LEFT JOIN el USING (candidate, "row") LEFT JOIN tk2 tk ON tk.candidate = el.candidate AND tk.rn = el.rn)"""
_SIDED = lambda buy, sell: f""",
sd AS MATERIALIZED (SELECT *, CASE WHEN won > 0 THEN 92 WHEN won < 0 THEN -100 ELSE 0 END AS units FROM (
  SELECT *, 'buy' AS side, CASE WHEN kept AND valid AND NOT tie THEN {buy} ELSE 0 END AS won FROM tkn WHERE scope = 1 UNION ALL SELECT *, 'sell', CASE WHEN kept AND valid AND NOT tie THEN {sell} ELSE 0 END FROM tkn WHERE scope = 1)),
sh AS (SELECT candidate, side, count(*) AS total, count(*) FILTER (WHERE won > 0) AS wins, count(*) FILTER (WHERE won < 0) AS losses, count(*) FILTER (WHERE kept AND valid AND tie) AS ties, count(*) FILTER (WHERE NOT (kept AND valid)) AS invalid FROM sd GROUP BY 1, 2),
sf AS (SELECT *, CASE WHEN side = 'buy' THEN total ELSE 0 END AS buy_signals, CASE WHEN side = 'sell' THEN total ELSE 0 END AS sell_signals, wins * 92 - losses * 100 AS net_units FROM sh)"""  # noqa: E731
_BOTH = _SIGNALS + _SIDED("CASE WHEN bw THEN 1 WHEN sw THEN -1 ELSE 0 END", "CASE WHEN bw THEN -1 WHEN sw THEN 1 ELSE 0 END")
_APART = _SIGNALS + _SIDED("CASE WHEN bw THEN 1 WHEN sw THEN -1 ELSE 0 END", "CASE WHEN sw THEN 1 WHEN bw THEN -1 ELSE 0 END")

ORACLES = {
    "capacity_one_scores": f"""WITH RECURSIVE {MARKED}, {_ONE_AT_A_TIME},
k0 AS (SELECT o1.candidate, value, row_number() OVER w AS no, sum(value) OVER w AS eq FROM o1 JOIN o3 USING (candidate, rn) WINDOW w AS (PARTITION BY o1.candidate ORDER BY rn)),
k1 AS (SELECT *, greatest(max(eq) OVER w, 0) - eq AS dd, """
    + ", ".join(f"CASE WHEN no >= {n} THEN sum(value) OVER (PARTITION BY candidate ORDER BY no ROWS {n - 1} PRECEDING) END AS w{n}" for n in (20, 50, 100))
    + """, no - row_number() OVER (PARTITION BY candidate, sign(value) ORDER BY no) AS r FROM k0 WINDOW w AS (PARTITION BY candidate ORDER BY no)),
k2 AS (SELECT *, no - coalesce(max(CASE WHEN dd <= 0 THEN no END) OVER (PARTITION BY candidate ORDER BY no), 0) AS under FROM k1), ks AS (SELECT candidate, sign(value) AS s, r, count(*) AS n FROM k1 GROUP BY 1, 2, 3),
kt AS (SELECT candidate, coalesce(max(n) FILTER (WHERE s < 0), 0) AS loss_streak, coalesce(max(n) FILTER (WHERE s > 0), 0) AS win_streak FROM ks GROUP BY 1),
ku AS (SELECT candidate, count(*) FILTER (WHERE value > 0) AS wins, count(*) FILTER (WHERE value < 0) AS losses, count(*) FILTER (WHERE value = 0) AS ties, count(*) AS n, CAST(sum(value) AS BIGINT) AS total, CAST(max(dd) AS BIGINT) AS max_drawdown, round(sqrt(avg(pow(dd, 2))), 6) AS ulcer, max(under) AS longest_underwater,
  CAST(min(w20) AS BIGINT) AS worst_20, CAST(min(w50) AS BIGINT) AS worst_50, CAST(min(w100) AS BIGINT) AS worst_100 FROM k2 GROUP BY 1)
SELECT * FROM ku JOIN kt USING (candidate)""",
    "cap1_signal_masks": _SIGNALS + " SELECT candidate, \"row\" FROM tkn WHERE kept AND scope = 1",
    "cap1_counters": _APART + " SELECT * FROM sf",
    "cap1_scores": _BOTH
    + """,
q0 AS (SELECT *, row_number() OVER w AS no, sum(units) OVER w AS eq FROM sd WHERE kept AND valid WINDOW w AS (PARTITION BY candidate, side ORDER BY entry, "row")),
q1 AS (SELECT *, greatest(0, coalesce(max(eq) OVER (PARTITION BY candidate, side ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS pk FROM q0),
q2 AS (SELECT *, eq >= pk AS top, greatest(pk, eq) - eq AS dd, lag(release) OVER w AS prev, lead(release) OVER w AS next, sum(CASE WHEN eq >= pk THEN 1 ELSE 0 END) OVER w AS ep, sum(CASE WHEN units < 0 THEN 0 ELSE 1 END) OVER w AS good,
  CASE WHEN no >= 20 THEN sum(units) OVER (PARTITION BY candidate, side ORDER BY no ROWS 19 PRECEDING) END AS w20, CASE WHEN no >= 50 THEN sum(units) OVER (PARTITION BY candidate, side ORDER BY no ROWS 49 PRECEDING) END AS w50, CASE WHEN no >= 100 THEN sum(units) OVER (PARTITION BY candidate, side ORDER BY no ROWS 99 PRECEDING) END AS w100 FROM q1 WINDOW w AS (PARTITION BY candidate, side ORDER BY no)),
ls AS (SELECT candidate, side, max(n) AS n FROM (SELECT candidate, side, good, count(*) AS n FROM q2 WHERE units < 0 GROUP BY 1, 2, 3) GROUP BY 1, 2),
ep AS (SELECT candidate, side, ep, count(*) AS n, arg_min(release, no) AS since, arg_min(coalesce(prev, entry), no) AS peak, coalesce((arg_max({'x': next}, no)).x, arg_max(release, no)) AS till, (arg_max({'x': next}, no)).x IS NOT NULL AS back FROM q2 WHERE NOT top GROUP BY 1, 2, 3),
eg AS (SELECT candidate, side, max(n) AS uw, max(till - since) AS um, max({'m': till - peak, 't': n + CAST(back AS INT)}) AS f FROM ep GROUP BY 1, 2),
pa AS (SELECT candidate, side, max(dd) AS md, sum(CAST(dd AS DOUBLE) * dd) AS sq, min(w20) AS w20, min(w50) AS w50, min(w100) AS w100, count(*) AS n, sum(units * units) AS us, sum(CASE WHEN units < 0 THEN units * units ELSE 0 END) AS ds FROM q2 GROUP BY 1, 2)
SELECT sf.*, CAST(coalesce(md, 0) AS BIGINT) AS max_drawdown, coalesce(ls.n, 0) AS max_losses, coalesce(sq, 0.0) AS drawdown_squares, coalesce(uw, 0) AS longest_underwater, coalesce(f.t, 0) AS max_drawdown_trades, CAST(coalesce(w20, 0) AS BIGINT) AS worst_20, CAST(coalesce(w50, 0) AS BIGINT) AS worst_50, CAST(coalesce(w100, 0) AS BIGINT) AS worst_100,
  coalesce(pa.n, 0) AS trades, CAST(coalesce(us, 0) AS BIGINT) AS trade_squares, CAST(coalesce(ds, 0) AS BIGINT) AS downside_squares, coalesce(um, 0) AS longest_underwater_micros, coalesce(f.m, 0) AS max_drawdown_micros FROM sf LEFT JOIN pa USING (candidate, side) LEFT JOIN ls USING (candidate, side) LEFT JOIN eg USING (candidate, side)""",
    "converted_amounts": "WITH e AS (SELECT epoch_us(ts) AS t, arg_max(value, event_id) AS value FROM events WHERE event_type IS NOT NULL GROUP BY 1), o AS (SELECT o_orderkey, o_totalprice, (SELECT min(epoch_us(ts)) FROM events WHERE event_type IS NOT NULL) + o_orderkey * 1000000 AS w FROM orders) SELECT o_orderkey, CASE WHEN w - t <= 300000000 THEN round(o_totalprice * value, 4) END AS amount FROM o ASOF LEFT JOIN e ON o.w >= e.t",
    "table_outlines": " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS n_rows, epoch_us(min({t})) AS first, epoch_us(max({t})) AS last, count(*) - count({t}) AS without_time FROM {n}" for n, t in (("ticks", "event_time_micros"), ("candles", "open_time_micros"), ("raw_pages", "receipt_time_utc"))),
    "newest_manifests": "SELECT instrument, generation, price_scale FROM generations WHERE retired_at IS NULL QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY published_at DESC NULLS LAST, generation DESC) = 1",
}
