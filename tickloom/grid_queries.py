"""Queries and SQL of calendars, continuous grids, inventories, reachability, exact arithmetic and families of candidates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import combinatorics, exact
from .functions.text import instant_micros
from .operators import asof, coverage, encodings, paths, search, sessions
from .research_queries import CODED, CODES, COMBINED, MARKED, PATH_ORDER, WEEKLY, _coded, _trades, path_drawdowns
from .sources import files, table

DAY = coverage.DAY


def session_intervals(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "candles").select(F.to_date("open_time_micros").alias("day"))
    return sessions.intervals(days, WEEKLY)


def next_session_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The first 5-minute bucket in session from each feature row's close, within four days."""
    rows = table(spark, d, "feature_rows").select("feature_id", F.unix_micros("close_time_micros").alias("at")).where("at is not null").withColumn("limit", F.col("at") + 4 * DAY)
    near = rows.select(F.explode(F.sequence(F.floor(F.col("at") / DAY) - 1, F.floor(F.col("limit") / DAY) + 1)).alias("k")).distinct().select(F.date_from_unix_date(F.col("k").cast("int")).alias("day"))
    return sessions.next_buckets(rows, sessions.intervals(near, WEEKLY), 300, 60).select("feature_id", "bucket")


def daily_window_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candles").select("candle_id", F.unix_micros("open_time_micros").alias("t"))
    return c.where(sessions.daily_window(F.col("t"), "America/New_York", "01:00:00", "10:30:00")).select("candle_id")


def _grid_candles(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candles")
    return c.select("generation", F.unix_micros("open_time_micros").alias("open_micros"), F.unix_micros("known_at_micros").alias("known_at_micros"), "open_units", "high_units", "low_units", "close_units", F.col("observations").cast("bigint").alias("observations"), "missing_buckets_before", sessions.fill_kind(c).alias("fill"))


def continuous_known(spark: SparkSession, d: str) -> DataFrame:
    cover = table(spark, d, "generations").select("generation", F.unix_micros("coverage_start").alias("start"), F.unix_micros("coverage_end").alias("end"))
    return sessions.continuous_known(_grid_candles(spark, d), cover).select("generation", "open_micros", "close_units", "fill", "known_at_micros")


def carried_gaps(spark: SparkSession, d: str) -> DataFrame:
    return sessions.carried_gaps(_grid_candles(spark, d))


def session_counts(spark: SparkSession, d: str) -> DataFrame:
    """Candles inside and outside the session per generation and local weekday."""
    c = table(spark, d, "candles").select("generation", F.unix_micros("open_time_micros").alias("t")).where("t is not null")
    at = sessions.local_time(F.col("t"), WEEKLY.zone)
    return c.groupBy("generation", F.weekday(at).alias("weekday")).agg(F.count_if(sessions.in_session(F.col("t"), WEEKLY)).alias("inside"), F.count_if(~sessions.in_session(F.col("t"), WEEKLY)).alias("outside"))


def candle_days(spark: SparkSession, d: str) -> DataFrame:
    """The inventory that the candles themselves make."""
    t = F.unix_micros("open_time_micros")
    c = table(spark, d, "candles").where("open_time_micros is not null").select("generation", "duration_seconds", t.alias("t"), (t - F.pmod(t, F.lit(DAY))).alias("day"))
    return coverage.full_grid(c.groupBy("generation", "duration_seconds", "day").agg(F.count(F.lit(1)).alias("n_rows"), F.min("t").alias("first"), F.max("t").alias("last")))


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "day_inventory")
    return t.select("inventory_id", "generation", "duration_seconds", coverage.day_start(F.col("day_date")).alias("day"), F.col("row_count").alias("n_rows"), instant_micros(F.col("first_time")).alias("first"), instant_micros(F.col("last_time")).alias("last"), "state")


def full_grid_days(spark: SparkSession, d: str) -> DataFrame:
    return coverage.full_grid(_inventory(spark, d)).select("inventory_id", "full")


def inventory_problems(spark: SparkSession, d: str) -> DataFrame:
    return coverage.inventory_problems(_inventory(spark, d)).where("problem is not null").select("inventory_id", "problem")


def span_disorder(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "day_inventory").select("inventory_id", F.posexplode("unresolved").alias("place", "u"))
    spans = t.select("inventory_id", "place", instant_micros(F.col("u.span_start")).alias("start"), instant_micros(F.col("u.span_end")).alias("end"))
    return coverage.disorder(spans, ["inventory_id"], "place").select("inventory_id", "place", "problem")


def coverage_findings(spark: SparkSession, d: str) -> DataFrame:
    cover = table(spark, d, "generations").select("generation", F.unix_micros("coverage_start").alias("start"), F.unix_micros("coverage_end").alias("end"))
    return coverage.against_coverage(_inventory(spark, d), cover, "generation")


def reachable_nodes(spark: SparkSession, d: str) -> DataFrame:
    """What the valid outcomes rest on: feature rows, candles, generations."""
    o, f, c = (table(spark, d, n) for n in ("outcomes", "feature_rows", "candles"))
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), c.cast("string"))
    edges = o.where("reason = 0").select(name("outcome", F.col("outcome_id")).alias("source"), name("feature", F.col("feature_id")).alias("target"))
    edges = edges.unionByName(f.select(name("feature", F.col("feature_id")).alias("source"), name("candle", F.col("candle_id")).alias("target"))).unionByName(c.select(name("candle", F.col("candle_id")).alias("source"), name("generation", F.col("generation")).alias("target")))
    return coverage.reachable(edges, o.where("reason = 0").select(name("outcome", F.col("outcome_id")).alias("node"))).withColumn("steps", F.col("steps").cast("int"))


def basis_points(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candles", "candle_id", "open_units", "close_units")
    return c.select("candle_id", exact.basis_points_text(F.col("close_units") - F.col("open_units"), F.col("open_units")).alias("text"))


def exact_totals(spark: SparkSession, d: str) -> DataFrame:
    return exact.exact_sums(table(spark, d, "candles", "generation", "volume"), ["generation"], "volume").withColumn("total", F.round("total", 6))


def rescaled_prices(spark: SparkSession, d: str) -> DataFrame:
    """Order totals at one and two digits, where that loses nothing."""
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice").withColumn("p", F.round("o_totalprice", 2).cast("decimal(18,2)"))
    return o.select("o_orderkey", exact.rescaled(F.col("p"), 1).cast("string").alias("one"), exact.rescaled(F.col("p"), 3).cast("string").alias("three"))


def page_checksums(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_pages", "delivery_id", "payload").select("delivery_id", exact.crc32c(F.col("payload")).alias("crc32c"), F.octet_length("payload").alias("n_bytes"))


def bars_out_of_order(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candles", "candle_id", "generation", "open_time_micros").where("open_time_micros is not null")
    return files.out_of_order(c, "generation", "open_time_micros", "candle_id").select("candle_id")


def fifth_codes(spark: SparkSession, d: str) -> DataFrame:
    """The fifth of the development cuts that each feature row's activity lies in."""
    rows = table(spark, d, "feature_rows", "feature_id", "instrument", "activity_score")
    cuts = encodings.development_fifths(rows, ["instrument"], "activity_score")
    return rows.join(cuts, "instrument", "left").select("feature_id", encodings.fifth(F.col("activity_score"), F.col("cuts")).alias("fifth"))


def path_stability(spark: SparkSession, d: str) -> DataFrame:
    return paths.stability(path_drawdowns(spark, d))


def slot_mask(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows whose decision lies in the installed window and the daily one."""
    f = table(spark, d, "feature_rows").select("feature_id", F.unix_micros("known_at_micros").alias("at"))
    inside = (F.col("at") >= 1_484_006_400_000_000) & (F.col("at") < 1_485_216_000_000_000) & sessions.daily_window(F.col("at"), "America/New_York", "09:30:00", "16:00:00")
    return f.select("feature_id", F.coalesce(inside, F.lit(False)).alias("open"))


def projected_codes(spark: SparkSession, d: str) -> DataFrame:
    """For each feature row the direction code of the latest candle known then, -1 without one."""
    base = table(spark, d, "feature_rows").select("feature_id", "generation", F.unix_micros("known_at_micros").alias("known"))
    code = F.when(F.col("close_units") > F.col("open_units"), 1).when(F.col("close_units") < F.col("open_units"), 2).when(F.col("close_units") == F.col("open_units"), 0)
    other = table(spark, d, "candles").select("generation", "candle_id", F.unix_micros("known_at_micros").alias("c_known"), code.alias("code"))
    x = asof.asof(base, other, "generation", "known", "c_known", ["code"], "latest", tie="candle_id")
    return x.select("feature_id", F.coalesce("latest.code", F.lit(-1)).alias("code"))


def candidate_gates(spark: SparkSession, d: str) -> DataFrame:
    s = search.combinations(_coded(spark, d), CODED).withColumn("net_units", F.col("wins") * 92 - F.col("losses") * 100)
    return search.gated(s, 40, -2_000).select("conditions", "net_units", "gate", "place")


def family_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Every set of one to three conditions of the menu with its number, by the closed form, and that the number leads back to it."""
    menu = search.posting_lists(_coded(spark, d), CODED).select("column", "code").distinct()
    order = menu.select(F.concat_ws("=", "column", F.col("code").cast("string")).alias("c"), "column").collect()  # the menu
    place = {c: k for k, c in enumerate(sorted(r["c"] for r in order))}
    n = len(place)
    sets = search.candidates(menu, 1, 3)

    @F.pandas_udf("number bigint, back boolean")
    def numbered(conditions: pd.Series) -> pd.DataFrame:
        chosen = [[place[c] for c in x] for x in conditions]
        ranks = [combinatorics.member_rank(n, 1, c) for c in chosen]
        return pd.DataFrame({"number": ranks, "back": [combinatorics.member_at(n, 1, 3, r)[0] == c for r, c in zip(ranks, chosen)]})

    return sets.select(F.concat_ws("&", "conditions").alias("conditions"), numbered("conditions").alias("x")).select("conditions", "x.*")


QUERIES = {
    f.__name__: f
    for f in (
        session_intervals, next_session_buckets, daily_window_rows, continuous_known, carried_gaps, session_counts, candle_days, full_grid_days, inventory_problems, span_disorder, coverage_findings, reachable_nodes, basis_points, exact_totals,
        rescaled_prices, page_checksums, bars_out_of_order, fifth_codes, path_stability, slot_mask, projected_codes, candidate_gates, family_numbers,
    )
}

_SESSION = "CASE WHEN day = DATE '2017-01-20' THEN 46800 ELSE 57600 END"
_BOUND = lambda s: f"epoch_us(timezone('America/New_York', CAST(day AS TIMESTAMP) + to_seconds({s})))"
_SESSIONS = f"SELECT day, {_BOUND('34200')} AS open_micros, {_BOUND(_SESSION)} AS close_micros FROM dy WHERE isodow(day) <= 5 AND day <> DATE '2017-01-16'"
_KIND = "CASE WHEN open_units = high_units AND open_units = low_units AND open_units = close_units AND volume = 0 THEN 'source' ELSE 'none' END"
_PLAIN = "epoch_us(CAST({} AS TIMESTAMPTZ))"
_INVENTORY = f"iv AS (SELECT inventory_id, generation, duration_seconds, epoch_us(CAST(day_date AS TIMESTAMP)) AS day, row_count AS n, {_PLAIN.format('first_time')} AS f, {_PLAIN.format('last_time')} AS l, state FROM day_inventory)"
_COVER = "cv AS (SELECT generation, epoch_us(coverage_start) AS s, epoch_us(coverage_end) AS e FROM generations)"
_MENU = " UNION ".join(f"SELECT '{c}' AS col, '{c}=' || {c} AS c FROM coded WHERE {c} IS NOT NULL" for c in CODED)

ORACLES = {
    "session_intervals": f"WITH dy AS (SELECT DISTINCT CAST(open_time_micros AS DATE) AS day FROM candles WHERE open_time_micros IS NOT NULL) {_SESSIONS}",
    "next_session_buckets": f"""WITH r AS (SELECT feature_id, epoch_us(close_time_micros) AS a0 FROM feature_rows WHERE close_time_micros IS NOT NULL), b AS (SELECT min(a0) // {DAY} - 2 AS lo, max(a0) // {DAY} + 7 AS hi FROM r),
dy AS (SELECT CAST(DATE '1970-01-01' + CAST(k AS INT) AS DATE) AS day FROM (SELECT unnest(range(lo, hi)) AS k FROM b)), se AS ({_SESSIONS}), g AS (SELECT unnest(range((open_micros - 60000000) // 300000000, (close_micros - 60000000) // 300000000 + 1)) * 300000000 + 60000000 AS bucket, open_micros, close_micros FROM se),
k AS (SELECT bucket FROM g WHERE bucket >= open_micros AND bucket <= close_micros) SELECT feature_id, CASE WHEN bucket + 300000000 <= a0 + {4 * DAY} THEN bucket END AS bucket FROM r ASOF LEFT JOIN k ON r.a0 <= k.bucket""",
    "daily_window_rows": "SELECT candle_id FROM candles WHERE strftime(timezone('America/New_York', open_time_micros), '%H:%M:%S') >= '01:00:00' AND strftime(timezone('America/New_York', open_time_micros), '%H:%M:%S') < '10:30:00'",
    "continuous_known": f"""WITH {_COVER}, g0 AS (SELECT generation, epoch_us(open_time_micros) AS o, close_units, epoch_us(known_at_micros) AS k, {_KIND} AS fill FROM candles), g1 AS (SELECT *, lead(o) OVER (PARTITION BY generation ORDER BY o) AS nxt FROM g0),
g2 AS (SELECT generation, o, close_units, fill, k FROM g0 UNION ALL SELECT generation, unnest(range(o + 60000000, nxt, 60000000)), close_units, 'engine', NULL FROM g1 WHERE nxt > o + 60000000
  UNION ALL SELECT generation, unnest(range(o + 60000000, e - 59999999, 60000000)), close_units, 'engine', NULL FROM g1 JOIN cv USING (generation) WHERE nxt IS NULL)
SELECT g2.generation, o AS open_micros, close_units, fill, CASE WHEN fill <> 'engine' THEN k WHEN o >= s AND o + 60000000 <= e THEN o + 60000000 ELSE first_value(k IGNORE NULLS) OVER (PARTITION BY g2.generation ORDER BY o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS known_at_micros FROM g2 LEFT JOIN cv ON cv.generation = g2.generation""",
    "carried_gaps": f"""WITH c AS (SELECT generation, epoch_us(open_time_micros) AS o, coalesce(missing_buckets_before, 0) AS m, {_KIND} AS fill FROM candles), n AS (SELECT *, coalesce(sum(CASE WHEN fill = 'none' THEN 1 ELSE 0 END) OVER (PARTITION BY generation ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM c)
SELECT generation, max(o) FILTER (WHERE fill = 'none') AS open_micros, count(*) FILTER (WHERE fill <> 'none') AS n_fills, CAST(sum(m) AS BIGINT) AS carried_missing FROM n GROUP BY generation, g HAVING max(o) FILTER (WHERE fill = 'none') IS NOT NULL""",
    "session_counts": """WITH l AS (SELECT generation, timezone('America/New_York', open_time_micros) AS x FROM candles WHERE open_time_micros IS NOT NULL), s AS (SELECT *, hour(x) * 3600 + minute(x) * 60 + second(x) AS s, CASE WHEN CAST(x AS DATE) = DATE '2017-01-20' THEN 46800 ELSE 57600 END AS z FROM l),
i AS (SELECT generation, CAST(isodow(x) - 1 AS INT) AS weekday, isodow(x) <= 5 AND s >= 34200 AND s <= z AND CAST(x AS DATE) <> DATE '2017-01-16' AS i FROM s) SELECT generation, weekday, count(*) FILTER (WHERE i) AS inside, count(*) FILTER (WHERE NOT i) AS outside FROM i GROUP BY 1, 2""",
    "candle_days": f"""WITH c AS (SELECT generation, duration_seconds, epoch_us(open_time_micros) AS t, epoch_us(open_time_micros) // {DAY} * {DAY} AS day FROM candles WHERE open_time_micros IS NOT NULL), a AS (SELECT generation, duration_seconds, day, count(*) AS n_rows, min(t) AS first, max(t) AS last FROM c GROUP BY 1, 2, 3)
SELECT *, n_rows * duration_seconds = 86400 AND first = day AND last = day + {DAY} - duration_seconds * 1000000 AS "full" FROM a""",
    "full_grid_days": f"WITH {_INVENTORY} SELECT inventory_id, coalesce(n * duration_seconds = 86400 AND f = day AND l = day + {DAY} - duration_seconds * 1000000, false) AS \"full\" FROM iv",
    "inventory_problems": f"""WITH {_INVENTORY}, p AS (SELECT inventory_id, CASE WHEN day IS NULL THEN 'bad_day' WHEN coalesce(n, 0) < 0 THEN 'negative_rows' WHEN coalesce(n, 0) > 0 AND (f IS NULL OR l IS NULL) THEN 'rows_without_bounds' WHEN coalesce(n, 0) = 0 AND (f IS NOT NULL OR l IS NOT NULL) THEN 'bounds_without_rows'
  WHEN l < f THEN 'reversed' WHEN f < day OR l >= day + {DAY} THEN 'outside_day' WHEN state = 'complete' AND coalesce(n, 0) = 0 THEN 'state_without_rows' WHEN state = 'empty_known' AND coalesce(n, 0) > 0 THEN 'rows_in_empty' END AS problem FROM iv) SELECT * FROM p WHERE problem IS NOT NULL""",
    "span_disorder": f"""WITH u AS (SELECT inventory_id, unnest(range(0, len(unresolved))) AS place, unresolved FROM day_inventory), s AS (SELECT inventory_id, CAST(place AS INT) AS place, {_PLAIN.format('unresolved[place + 1].span_start')} AS s, {_PLAIN.format('unresolved[place + 1].span_end')} AS e FROM u),
p AS (SELECT inventory_id, place, CASE WHEN s = e THEN 'empty' WHEN s > e THEN 'reversed' WHEN s < lag(e) OVER (PARTITION BY inventory_id ORDER BY place) THEN 'overlap' END AS problem FROM s) SELECT * FROM p WHERE problem IS NOT NULL""",
    "coverage_findings": f"""WITH {_INVENTORY}, {_COVER}, c AS (SELECT DISTINCT generation, unnest(range(s // {DAY}, (e - 1) // {DAY} + 1)) * {DAY} AS day FROM cv), i AS (SELECT DISTINCT generation, day FROM iv WHERE day IS NOT NULL)
SELECT generation, day, 'missing' AS finding FROM c ANTI JOIN i USING (generation, day) UNION ALL SELECT generation, day, 'outside' FROM i ANTI JOIN c USING (generation, day)""",
    "reachable_nodes": """WITH RECURSIVE e AS (SELECT 'outcome:' || outcome_id AS s, 'feature:' || feature_id AS t FROM outcomes WHERE reason = 0 AND feature_id IS NOT NULL UNION SELECT 'feature:' || feature_id, 'candle:' || candle_id FROM feature_rows WHERE candle_id IS NOT NULL UNION SELECT 'candle:' || candle_id, 'generation:' || generation FROM candles),
w AS (SELECT 'outcome:' || outcome_id AS node, 0 AS steps FROM outcomes WHERE reason = 0 UNION SELECT t, steps + 1 FROM w JOIN e ON node = s) SELECT node, CAST(min(steps) AS INT) AS steps FROM w GROUP BY 1""",
    "basis_points": """WITH a AS (SELECT candle_id, close_units - open_units AS m, abs(open_units) AS d, CAST(abs(close_units - open_units) AS HUGEINT) * 100000000000000 AS n FROM candles), q AS (SELECT *, n // nullif(d, 0) AS q, n % nullif(d, 0) AS r FROM a),
h AS (SELECT candle_id, m, q + CASE WHEN r * 2 > d OR (r * 2 = d AND q % 2 = 1) THEN 1 ELSE 0 END AS q FROM q) SELECT candle_id, CASE WHEN q IS NOT NULL THEN CASE WHEN m < 0 AND q > 0 THEN '-' ELSE '' END || (q // 10000000000) || '.' || lpad(CAST(q % 10000000000 AS VARCHAR), 10, '0') END AS text FROM h""",
    "exact_totals": "SELECT generation, round(coalesce(fsum(volume), 0.0), 6) AS total FROM candles GROUP BY 1 HAVING count(volume) > 0",
    "rescaled_prices": "WITH o AS (SELECT o_orderkey, CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) AS p FROM orders) SELECT o_orderkey, CASE WHEN CAST(p AS DECIMAL(18,1)) = p THEN CAST(CAST(p AS DECIMAL(18,1)) AS VARCHAR) END AS one, CAST(CAST(p AS DECIMAL(18,3)) AS VARCHAR) AS three FROM o",
    "bars_out_of_order": "SELECT candle_id FROM (SELECT candle_id, open_time_micros <= lag(open_time_micros) OVER (PARTITION BY generation ORDER BY candle_id) AS bad FROM candles WHERE open_time_micros IS NOT NULL) WHERE bad",
    "fifth_codes": "WITH q AS (SELECT instrument, list_distinct(quantile_cont(activity_score, [0.2, 0.4, 0.6, 0.8])) AS c FROM feature_rows WHERE activity_score IS NOT NULL GROUP BY 1 HAVING count(DISTINCT activity_score) >= 4) SELECT feature_id, CASE WHEN activity_score IS NOT NULL AND c IS NOT NULL THEN CAST(len(list_filter(c, lambda x: x < activity_score)) AS INT) END AS fifth FROM feature_rows LEFT JOIN q USING (instrument)",
    "path_stability": f"""WITH {MARKED}, eq AS (SELECT *, sum(value) OVER w AS equity, row_number() OVER w AS no FROM tr WINDOW w AS (PARTITION BY path ORDER BY et, feature_id)), pk AS (SELECT *, greatest(max(equity) OVER (PARTITION BY path ORDER BY no), 0) - equity AS dd FROM eq),
uw AS (SELECT *, no - coalesce(max(CASE WHEN dd <= 0 THEN no END) OVER (PARTITION BY path ORDER BY no), 0) AS under FROM pk), pp AS (SELECT path, max(dd) AS d, max(under) AS u FROM uw GROUP BY 1)
SELECT count(*) AS replicates, CAST(quantile_cont(d, 0.5) AS DOUBLE) AS median_drawdown, CAST(quantile_cont(d, 0.95) AS DOUBLE) AS p95_drawdown, CAST(quantile_cont(u, 0.95) AS DOUBLE) AS p95_underwater FROM pp""",
    "slot_mask": "SELECT feature_id, coalesce(epoch_us(known_at_micros) >= 1484006400000000 AND epoch_us(known_at_micros) < 1485216000000000 AND strftime(timezone('America/New_York', known_at_micros), '%H:%M:%S') >= '09:30:00' AND strftime(timezone('America/New_York', known_at_micros), '%H:%M:%S') < '16:00:00', false) AS \"open\" FROM feature_rows",
    "projected_codes": """WITH c AS (SELECT generation, epoch_us(known_at_micros) AS k, arg_max({'c': CASE WHEN close_units > open_units THEN 1 WHEN close_units < open_units THEN 2 WHEN close_units = open_units THEN 0 END}, candle_id) AS x FROM candles WHERE known_at_micros IS NOT NULL GROUP BY 1, 2), b AS (SELECT feature_id, generation, epoch_us(known_at_micros) AS k FROM feature_rows)
SELECT feature_id, CAST(coalesce(x.c, -1) AS INT) AS code FROM b ASOF LEFT JOIN c ON b.generation = c.generation AND b.k >= c.k""",
    "candidate_gates": f"WITH {COMBINED}, n AS (SELECT *, wins * 92 - losses * 100 AS net_units FROM score), g AS (SELECT *, CASE WHEN wins + losses < 40 THEN 'too_few' WHEN net_units <= -2000 THEN 'unprofitable' END AS gate FROM n) SELECT conditions, net_units, gate, CASE WHEN gate IS NULL THEN row_number() OVER (PARTITION BY gate IS NULL ORDER BY net_units DESC, wins + losses DESC, conditions) END AS place FROM g",
    "family_numbers": f"""WITH {CODES}, m AS ({_MENU}), p AS (SELECT *, row_number() OVER (ORDER BY c) - 1 AS i FROM m), al AS (SELECT c AS conditions, 1 AS size, col AS k1, '' AS k2, '' AS k3, [i] AS ix FROM p
  UNION ALL SELECT a.c || '&' || b.c, 2, a.col, b.col, '', [a.i, b.i] FROM p a JOIN p b ON a.i < b.i UNION ALL SELECT a.c || '&' || b.c || '&' || c.c, 3, a.col, b.col, c.col, [a.i, b.i, c.i] FROM p a JOIN p b ON a.i < b.i JOIN p c ON b.i < c.i),
r AS (SELECT *, row_number() OVER (ORDER BY size, ix) - 1 AS number FROM al) SELECT conditions, number, true AS back FROM r WHERE k1 <> k2 AND k2 <> k3 OR size = 1 OR (size = 2 AND k1 <> k2)""",
}
