"""The registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import instant_micros
from .operators import late_events, periods, redelivery, references, regrid, spikes
from . import extra_queries, grid_queries, research_queries, spike_sql, stream_queries
from .sources import table

Query = Callable[[SparkSession, str], DataFrame]


def _late(spark: SparkSession, d: str) -> DataFrame:
    return late_events.changelog(late_events.revisions(table(spark, d, "ticks"), table(spark, d, "raw_pages")))


def _rounded(state: DataFrame) -> DataFrame:
    return state.withColumn("total", F.round(F.col("total").cast("double") + F.coalesce("total_large", F.lit(0.0)), 3)).drop("total_large")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return late_events.corrected_periods(_late(spark, d))


def p1_corrected(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(late_events.consolidate(_late(spark, d)))


def p1_hourly(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(late_events.consolidate(_late(spark, d), grain=3_600_000_000))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    return references.orphans(
        [
            references.Parents("candle", t("candles"), "candle_id", F.col("known_at_micros")),
            references.Parents("feature", t("feature_rows"), "feature_id", F.col("written_at")),
            references.Parents("tick", t("ticks"), "tick_id"),
            references.Parents("manifest", t("generations"), "generation", F.col("published_at"), F.col("retired_at")),
        ],
        [
            references.References("feature_rows", t("feature_rows"), "feature_id", "written_at", (("candle_id", "candle"),)),
            references.References("outcomes", t("outcomes"), "outcome_id", "written_at", (("feature_id", "feature"), ("entry_tick_id", "tick"), ("settlement_tick_id", "tick"))),
            references.References("declarations", t("declarations"), "declaration_id", "recorded_at", (("generations", "manifest"),)),
        ],
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_id", "ref_field", "ref_key")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, d))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return regrid.regular_grid(regrid.period_readings(table(spark, d, "ticks")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).where("fill <> 'observed'").select("generation", "period_start_micros")


def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).withColumn("value", F.round("value", 6))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return redelivery.deliveries(table(spark, d, "raw_pages")).where("copy").select("delivery_id")


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    return redelivery.deliveries(table(spark, d, "raw_pages")).where("not copy").select("delivery_id", F.col("producer").alias("acquisition"), F.col("number").alias("ordinal"), "digest")


def p6_flags(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible_rows(table(spark, d, "ticks"), table(spark, d, "generations"), table(spark, d, "candles"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_flags(spark, d).select("row_table", "row_id").distinct()


def _spans(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "day_inventory", "generation", "family", "duration_seconds", "first_time", "last_time", "unresolved")
    covered = F.struct(F.lit("covered").alias("span_kind"), F.col("first_time").alias("s"), F.col("last_time").alias("e"), (F.col("duration_seconds").cast("bigint") * 1_000_000).alias("more"))
    unresolved = F.transform(F.coalesce("unresolved", F.array()), lambda u: F.struct(F.lit("unresolved").alias("span_kind"), u["span_start"].alias("s"), u["span_end"].alias("e"), F.lit(0).cast("bigint").alias("more")))
    rows = days.select("generation", "family", F.explode(F.concat(F.array(covered), unresolved)).alias("x"))
    return rows.select("generation", "family", "x.span_kind", instant_micros(F.col("x.s")).alias("s"), (instant_micros(F.col("x.e")) + F.col("x.more")).alias("e"))


P7_KEYS = ("generation", "family", "span_kind")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return periods.gaps(periods.continuous_periods(_spans(spark, d), P7_KEYS, "s", "e"), P7_KEYS)


def p7_periods(spark: SparkSession, d: str) -> DataFrame:
    return periods.continuous_periods(_spans(spark, d), P7_KEYS, "s", "e").drop("gap_end")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_corrected, p1_hourly, p3_found, p3_report, p4_found, p4_grid, p5_found, p5_kept, p6_found, p6_flags, p7_found, p7_periods)} | stream_queries.QUERIES | research_queries.QUERIES | extra_queries.QUERIES | grid_queries.QUERIES

_P1_ARRIVED = """
WITH pages AS (SELECT regexp_replace(lower(acquisition_id), '^\\s+|\\s+$', '', 'g') AS a, ordinal AS o, min(epoch_us(receipt_time_utc)) AS k FROM raw_pages WHERE receipt_time_utc IS NOT NULL GROUP BY 1, 2),
arrived AS (
  SELECT generation, price, CAST(floor(epoch_us(event_time_micros) / 300000000) AS BIGINT) * 300000000 AS p, coalesce(epoch_us(known_at_micros), k) AS arrival
  FROM ticks LEFT JOIN pages ON a = regexp_replace(lower(acquisition_id), '^\\s+|\\s+$', '', 'g') AND o = page_ordinal
  WHERE event_time_micros IS NOT NULL)
"""
_P1_STATE = """, kept AS (SELECT *, CAST(price AS DECIMAL(28,9)) AS x, CAST(greatest(0, ceil((arrival - p - 300000000) / 60000000)) AS BIGINT) AS v FROM arrived WHERE arrival <= p + 2100000000),
periods AS (SELECT generation, p, count(*) AS n, count(x) AS n_values, sum(x) AS total, min(x) AS low, max(x) AS high, count(DISTINCT v) AS versions FROM kept GROUP BY 1, 2)
"""
_P7 = """
WITH spans AS (
  SELECT generation, family, 'covered' AS span_kind, epoch_us(CAST(first_time AS TIMESTAMPTZ)) AS s, epoch_us(CAST(last_time AS TIMESTAMPTZ)) + duration_seconds * 1000000 AS e FROM day_inventory
  UNION ALL
  SELECT generation, family, 'unresolved', epoch_us(CAST(u.span_start AS TIMESTAMPTZ)), epoch_us(CAST(u.span_end AS TIMESTAMPTZ)) FROM (SELECT generation, family, unnest(unresolved) AS u FROM day_inventory)),
good AS (SELECT * FROM spans WHERE s < e),
reach AS (SELECT *, max(e) OVER (PARTITION BY generation, family, span_kind ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM good),
islands AS (SELECT *, sum(CASE WHEN m IS NULL OR m < s THEN 1 ELSE 0 END) OVER (PARTITION BY generation, family, span_kind ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM reach),
periods AS (SELECT generation, family, span_kind, min(s) AS period_start, max(e) AS period_end FROM islands GROUP BY generation, family, span_kind, g)
"""
_P3 = """
WITH refs AS (
  SELECT 'feature_rows' AS ref_table, f.feature_id AS ref_id, 'candle_id' AS ref_field, CAST(f.candle_id AS VARCHAR) AS ref_key, f.written_at AS w, c.candle_id IS NOT NULL AS found, c.known_at_micros AS since, CAST(NULL AS TIMESTAMPTZ) AS until
  FROM feature_rows f LEFT JOIN candles c USING (candle_id) WHERE f.candle_id IS NOT NULL
  UNION ALL SELECT 'outcomes', o.outcome_id, 'feature_id', CAST(o.feature_id AS VARCHAR), o.written_at, f.feature_id IS NOT NULL, f.written_at, NULL FROM outcomes o LEFT JOIN feature_rows f USING (feature_id) WHERE o.feature_id IS NOT NULL
  UNION ALL SELECT 'outcomes', o.outcome_id, 'entry_tick_id', CAST(o.entry_tick_id AS VARCHAR), o.written_at, t.tick_id IS NOT NULL, NULL, NULL FROM outcomes o LEFT JOIN ticks t ON t.tick_id = o.entry_tick_id WHERE o.entry_tick_id IS NOT NULL
  UNION ALL SELECT 'outcomes', o.outcome_id, 'settlement_tick_id', CAST(o.settlement_tick_id AS VARCHAR), o.written_at, t.tick_id IS NOT NULL, NULL, NULL FROM outcomes o LEFT JOIN ticks t ON t.tick_id = o.settlement_tick_id WHERE o.settlement_tick_id IS NOT NULL
  UNION ALL SELECT 'declarations', d.declaration_id, 'generations', d.g, d.recorded_at, x.generation IS NOT NULL, x.published_at, x.retired_at FROM (SELECT declaration_id, recorded_at, unnest(generations) AS g FROM declarations) d LEFT JOIN generations x ON x.generation = d.g WHERE d.g IS NOT NULL),
misses AS (
  SELECT DISTINCT ref_table, ref_id, ref_field, ref_key, CAST(w AS DATE) AS day, CASE WHEN NOT found THEN 'missing' WHEN since > w THEN 'later' ELSE 'retired' END AS reason FROM refs WHERE NOT found OR since > w OR until <= w)
"""
_P5 = """
WITH d AS (SELECT delivery_id, regexp_replace(lower(acquisition_id), '^\\s+|\\s+$', '', 'g') AS acquisition, ordinal, regexp_replace(regexp_replace(lower(payload_sha256), '^\\s+|\\s+$', '', 'g'), '^(sha-?256\\s*[:=]\\s*)?(0x)?', '') AS digest FROM raw_pages),
r AS (SELECT *, row_number() OVER (PARTITION BY acquisition, ordinal, digest ORDER BY delivery_id) AS k FROM d)
"""

ORACLES: dict[str, str] = {
    "p1_found": _P1_ARRIVED + "SELECT DISTINCT generation, p AS period_start_micros FROM arrived WHERE arrival > p + 300000000 AND arrival <= p + 2100000000",
    "p1_corrected": _P1_ARRIVED + _P1_STATE + "SELECT generation, p AS period_start_micros, n, n_values, round(CAST(total AS DOUBLE), 3) AS total, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, versions FROM periods",
    "p1_hourly": _P1_ARRIVED + _P1_STATE + "SELECT generation, CAST(floor(p / 3600000000) AS BIGINT) * 3600000000 AS period_start_micros, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_values) AS BIGINT) AS n_values, round(CAST(sum(total) AS DOUBLE), 3) AS total, CAST(min(low) AS DOUBLE) AS low, CAST(max(high) AS DOUBLE) AS high, CAST(sum(versions) AS BIGINT) AS versions FROM periods GROUP BY 1, 2",
    "p3_found": _P3 + "SELECT ref_table, ref_id, ref_field, ref_key FROM misses",
    "p3_report": _P3 + "SELECT ref_table, day, reason, count(*) AS n_references, count(DISTINCT ref_id) AS n_rows FROM misses GROUP BY 1, 2, 3",
    "p4_found": """
WITH m AS (SELECT DISTINCT generation, CAST(floor(epoch_us(event_time_micros) / 60000000) AS BIGINT) AS m FROM ticks WHERE event_time_micros IS NOT NULL AND price IS NOT NULL),
n AS (SELECT generation, m, lead(m) OVER (PARTITION BY generation ORDER BY m) AS next FROM m)
SELECT generation, unnest(range(m + 1, next)) * 60000000 AS period_start_micros FROM n WHERE next > m + 1""",
    "p4_grid": """
WITH m AS (SELECT generation, CAST(floor(epoch_us(event_time_micros) / 60000000) AS BIGINT) AS x, arg_max(price, (epoch_us(event_time_micros), tick_id)) AS y, count(*) AS n FROM ticks WHERE event_time_micros IS NOT NULL AND price IS NOT NULL GROUP BY 1, 2),
n AS (SELECT *, CAST(x - lag(x) OVER w AS DOUBLE) AS hb, (y - lag(y) OVER w) / (x - lag(x) OVER w) AS db, CAST(lead(x) OVER w - x AS DOUBLE) AS h, lead(y) OVER w AS y1, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS dd,
  CAST(lead(x, 2) OVER w - lead(x) OVER w AS DOUBLE) AS hn, (lead(y, 2) OVER w - lead(y) OVER w) / (lead(x, 2) OVER w - lead(x) OVER w) AS dn FROM m WINDOW w AS (PARTITION BY generation ORDER BY x)),
e AS (SELECT *, coalesce(hb <= 31, false) AS back, coalesce(hn <= 31, false) AS nxt, ((2 * h + hn) * dd - h * dn) / (h + hn) AS el, ((2 * h + hb) * dd - h * db) / (h + hb) AS er FROM n),
k AS (SELECT *, CASE WHEN back THEN CASE WHEN db * dd <= 0 THEN 0.0 ELSE 3 * (h + hb) / ((2 * h + hb) / db + (h + 2 * hb) / dd) END WHEN nxt THEN CASE WHEN el * dd <= 0 THEN 0.0 WHEN dd * dn <= 0 AND abs(el) > 3 * abs(dd) THEN 3 * dd ELSE el END ELSE dd END AS m0,
  CASE WHEN nxt THEN CASE WHEN dd * dn <= 0 THEN 0.0 ELSE 3 * (hn + h) / ((2 * hn + h) / dd + (hn + 2 * h) / dn) END WHEN back THEN CASE WHEN er * dd <= 0 THEN 0.0 WHEN dd * db <= 0 AND abs(er) > 3 * abs(dd) THEN 3 * dd ELSE er END ELSE dd END AS m1 FROM e),
j AS (SELECT *, unnest(range(0, CAST(coalesce(h, 1) AS BIGINT))) AS j FROM k), t AS (SELECT *, j / h AS t FROM j)
SELECT generation, (x + j) * 60000000 AS period_start_micros, round(CASE WHEN j = 0 THEN y WHEN h <= 31 THEN (1 + 2 * t) * (1 - t) * (1 - t) * y + t * (1 - t) * (1 - t) * h * m0 + t * t * (3 - 2 * t) * y1 + t * t * (t - 1) * h * m1 END, 6) AS value,
  CASE WHEN j = 0 THEN n ELSE 0 END AS n_readings, CASE WHEN j = 0 THEN 'observed' WHEN h <= 31 THEN 'filled' ELSE 'gap' END AS fill FROM t""",
    "p5_found": _P5 + "SELECT delivery_id FROM r WHERE k > 1",
    "p5_kept": _P5 + "SELECT delivery_id, acquisition, ordinal, digest FROM r WHERE k = 1",
    "p6_found": spike_sql.flags() + " SELECT DISTINCT row_table, row_id FROM flags",
    "p6_flags": spike_sql.flags() + " SELECT * FROM flags",
    "p7_found": _P7 + "SELECT generation, family, span_kind, period_end AS gap_start_micros, nxt AS gap_end_micros FROM (SELECT *, lead(period_start) OVER (PARTITION BY generation, family, span_kind ORDER BY period_start) AS nxt FROM periods) WHERE nxt IS NOT NULL",
    "p7_periods": _P7 + "SELECT * FROM periods",
} | stream_queries.ORACLES | research_queries.ORACLES | extra_queries.ORACLES | grid_queries.ORACLES
