"""SQL of implausible readings, written apart from the operator: whole series as lists, every width and length tried in turn."""

from __future__ import annotations

from .operators import spikes as sp

W, T, BACK, RATIO, USUAL = sp.WIDTH, sp.OUTLYING, sp.RETURN, sp.STILL_RATIO, sp.USUAL


def flags() -> str:
    own = "(PARTITION BY k, g ORDER BY pos)"
    sums = {1: ("u", "lag(u) OVER w"), 2: ("u + lead(u) OVER w", "lag(u) OVER w + lag(u, 2) OVER w"), 4: ("u + lead(u) OVER w + lead(u, 2) OVER w + lead(u, 3) OVER w", "lag(u) OVER w + lag(u, 2) OVER w + lag(u, 3) OVER w + lag(u, 4) OVER w")}
    details = ", ".join(f"(({a}) - ({b})) / {n} AS d{n}" for n, (a, b) in sums.items())
    sized = " UNION ALL ".join(f"SELECT k, g, {n} AS n, floor(log2(abs(d{n})) * {sp.BINS}) AS b FROM det WHERE d{n} <> 0" for n in sp.WIDTHS)
    pairs = " UNION ALL ".join(
        f"SELECT k, g, pos AS i, {n} AS n, {m} AS m FROM (SELECT k, g, pos, d{n} AS a, lead(d{n}, {m}) OVER {own} AS b, s FROM det JOIN sc USING (k, g) WHERE sc.n = {n}) WHERE abs(a) > {T} * s AND abs(b) > {T} * s AND a * b < 0" for n in sp.WIDTHS for m in range(n, W + 1)
    )
    ends = " UNION ALL ".join(f"SELECT *, {h} AS h FROM sides WHERE size > {h}" for h in range(1, W + 1))
    return f"""
WITH scale AS (SELECT generation, max(price_scale) AS s FROM generations GROUP BY 1),
raw AS (
  SELECT 'ticks' AS k, generation AS g, epoch_us(event_time_micros) AS t, CASE WHEN s IS NULL THEN price ELSE round(price * pow(10.0, s)) END AS u, CAST(NULL AS DOUBLE) AS own, tick_id AS id FROM ticks LEFT JOIN scale USING (generation) WHERE price IS NOT NULL
  UNION ALL SELECT 'candles.high', generation, epoch_us(open_time_micros), CAST(high_units AS DOUBLE), CAST(greatest(open_units, close_units) AS DOUBLE), candle_id FROM candles WHERE high_units IS NOT NULL
  UNION ALL SELECT 'candles.low', generation, epoch_us(open_time_micros), CAST(low_units AS DOUBLE), CAST(least(open_units, close_units) AS DOUBLE), candle_id FROM candles WHERE low_units IS NOT NULL),
lev AS (SELECT k, g, pow(2.0, (quantile_cont(floor(log2(u) * {sp.BINS}), 0.5) + 0.5) / {sp.BINS}) AS level FROM raw WHERE u > 0 AND NOT isnan(u) AND NOT isinf(u) GROUP BY 1, 2),
held AS (SELECT raw.*, isnan(u) OR isinf(u) OR u <= 0 OR coalesce(u > level * {sp.FACTOR} OR u < level / {sp.FACTOR}, false) AS wrong FROM raw LEFT JOIN lev USING (k, g)),
dist AS (SELECT k, g, t, u, max(own) AS own, row_number() OVER (PARTITION BY k, g ORDER BY t, u) AS pos FROM held WHERE NOT wrong AND t IS NOT NULL GROUP BY k, g, t, u),
det AS MATERIALIZED (SELECT *, {details} FROM dist WINDOW w AS {own}),
bins AS ({sized}),
sc AS (SELECT k, g, n, pow(2.0, (max(b) + 1) / {sp.BINS}) AS s FROM (SELECT *, row_number() OVER (PARTITION BY k, g, n ORDER BY b) AS r, count(*) OVER (PARTITION BY k, g, n) AS c FROM bins) WHERE r <= -(-3 * c // 4) GROUP BY k, g, n),
arr AS (SELECT k, g, list(u ORDER BY pos) AS a, list(own ORDER BY pos) AS o, count(*) AS size FROM dist GROUP BY 1, 2),
cand AS ({pairs}),
tried AS (SELECT cand.*, s, a, list_avg(a[i - n : i - 1]) AS base, list_avg(a[i + m : i + m + n - 1]) AS after, a[i : i + m - 1] AS x, list_concat(a[i - n : i - 1], a[i + m : i + m + n - 1]) AS around FROM cand JOIN arr USING (k, g) JOIN sc USING (k, g, n)),
high AS (SELECT *, list_min(list_transform(x, lambda v: (v - base) * sign(x[1] - base))) AS height, list_median(a[greatest(1, i - {2 * W}) : i + m - 1 + {2 * W}]) AS level FROM tried),
good AS (SELECT * FROM high WHERE height > {T} * s AND abs(after - base) <= {BACK} * height AND list_max(list_transform(around, lambda v: abs(v - base))) <= 0.5 * height AND abs(base - level) < abs(list_avg(x) - level)),
sides AS (SELECT k, g, false AS back, a, o, size, s FROM arr JOIN sc USING (k, g) WHERE n = 1 UNION ALL SELECT k, g, true, list_reverse(a), list_reverse(o), size, s FROM arr JOIN sc USING (k, g) WHERE n = 1),
lone AS (SELECT *, list_min(list_transform(a[1 : h], lambda v: (v - a[h + 1]) * sign(a[1] - a[h + 1]))) AS least FROM ({ends})),
edge AS (SELECT *, unnest(range(1, h + 1)) AS p FROM lone WHERE least > {T} * s AND list_max(list_transform(a[h + 1 : h + {W + 1}], lambda v: abs(v - a[h + 1]))) <= 0.5 * least),
told AS (SELECT k, g, CASE WHEN back THEN size + 1 - p ELSE p END AS pos FROM edge WHERE CASE WHEN o[p] IS NULL THEN 2 * h - 1 <= {W} AND h < size - h ELSE abs(a[p] - o[p]) > greatest({T} * s, least * {1 - BACK}) END),
spiked AS (SELECT DISTINCT k, g, pos FROM (SELECT k, g, unnest(range(i, i + m)) AS pos FROM good UNION ALL SELECT k, g, pos FROM told)),
calm AS (SELECT dist.* FROM dist ANTI JOIN spiked USING (k, g, pos)),
steps AS (SELECT *, CASE WHEN lag(u) OVER {own} = u THEN 0 ELSE 1 END AS new FROM calm),
numbered AS (SELECT *, sum(new) OVER {own} AS run FROM steps),
runs AS (SELECT k, g, run, any_value(u) AS u, min(t) AS first, max(t) AS last, count(*) AS n FROM numbered GROUP BY 1, 2, 3),
facts AS (SELECT k, g, count(*) AS size, count(*) FILTER (WHERE d1 = 0) AS zeros FROM det GROUP BY 1, 2),
usual AS (SELECT k, g, greatest(2.0, {RATIO} * CASE WHEN zeros <= 0 THEN 1.0 WHEN zeros >= greatest(size - 1, 1) THEN 'inf'::DOUBLE ELSE 1 + ln(greatest(greatest(size - 1, 1) - zeros, 2)) / ln(CAST(greatest(size - 1, 1) AS DOUBLE) / zeros) END) AS least FROM facts),
sizes AS (SELECT k, g, n, n >= {RATIO} * coalesce(lag(n) OVER (PARTITION BY k, g ORDER BY n), 0) AND n >= least AS cut FROM (SELECT DISTINCT k, g, n FROM runs) JOIN usual USING (k, g)),
ordinary AS (SELECT k, g, coalesce(max(n) FILTER (WHERE n < coalesce(b, n + 1)), 0) AS n FROM (SELECT *, min(n) FILTER (WHERE cut) OVER (PARTITION BY k, g) AS b FROM sizes) GROUP BY 1, 2),
floors AS (SELECT k, {RATIO} * quantile_cont(n, {USUAL}) AS f FROM ordinary GROUP BY 1),
since AS (SELECT k, g, min(n) AS n FROM sizes JOIN floors USING (k) WHERE cut AND n >= f GROUP BY 1, 2),
long AS (SELECT runs.* FROM runs JOIN since USING (k, g) WHERE runs.n >= since.n),
found AS (
  SELECT k, id, 'impossible' AS reason FROM held WHERE wrong
  UNION SELECT h.k, h.id, 'spike' FROM held h JOIN dist USING (k, g, t, u) JOIN spiked USING (k, g, pos) WHERE NOT wrong
  UNION SELECT h.k, h.id, 'still' FROM held h JOIN long USING (k, g, u) WHERE NOT wrong AND t BETWEEN first AND last),
flags AS (SELECT DISTINCT string_split(k, '.')[1] AS row_table, id AS row_id, reason FROM found UNION SELECT 'candles', candle_id, 'crossed' FROM candles WHERE high_units < low_units)"""
