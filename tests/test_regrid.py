import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from tickloom.operators import regrid

T0 = datetime(2020, 1, 1, tzinfo=timezone.utc)


def frame(spark, rows):
    return spark.createDataFrame([(g, None if m is None else T0 + timedelta(minutes=m), p, i, "x") for i, (g, m, p) in enumerate(rows)], "generation string, event_time_micros timestamp, price double, tick_id bigint, fill string")


def slopes(x, y):
    """Shape-preserving slopes of one segment, written out."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    n = len(x)
    if n == 2:
        return np.array([d[0], d[0]])
    m = np.zeros(n)
    for k in range(1, n - 1):
        if d[k - 1] * d[k] > 0:
            w1, w2 = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
            m[k] = (w1 + w2) / (w1 / d[k - 1] + w2 / d[k])

    def end(h0, h1, d0, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if np.sign(s) != np.sign(d0):
            return 0.0
        return 3 * d0 if np.sign(d0) != np.sign(d1) and abs(s) > 3 * abs(d0) else s

    m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    return m


def brute(points, max_fill):
    out, xs = {}, sorted(points)
    segments = [[xs[0]]]
    for a, b in zip(xs, xs[1:]):
        if b - a > max_fill + 1:
            segments.append([])
        segments[-1].append(b)
    for s in segments:
        x, y = np.array(s, float), np.array([points[k] for k in s])
        m = slopes(x, y) if len(s) > 1 else None
        for k, (a, b) in enumerate(zip(s, s[1:])):
            for g in range(a + 1, b):
                t, h = (g - a) / (b - a), b - a
                out[g] = ("filled", (1 + 2 * t) * (1 - t) ** 2 * y[k] + t * (1 - t) ** 2 * h * m[k] + t * t * (3 - 2 * t) * y[k + 1] + t * t * (t - 1) * h * m[k + 1])
    for g in range(xs[0], xs[-1] + 1):
        out.setdefault(g, ("observed", points[g]) if g in points else ("gap", None))
    return out


@pytest.mark.parametrize("shard", [1, 5, 1440])
def test_against_brute_force(spark, shard):
    rnd = random.Random(2)
    points = {m: float(rnd.randrange(50)) for m in rnd.sample(range(300), 90)}
    rows = [("g", m, p) for m, p in points.items()]
    got = {(r["period_start_micros"] - int(T0.timestamp() * 1e6)) // 60_000_000: (r["fill"], r["value"]) for r in regrid.regular_grid(regrid.period_readings(frame(spark, rows)), max_fill=4, shard_periods=shard).collect()}
    want = brute(points, 4)
    assert set(got) == set(want)
    for k, (fill, v) in want.items():
        assert got[k][0] == fill and (v is None and got[k][1] is None or got[k][1] == pytest.approx(v, abs=1e-9)), k


def test_cases(spark):
    rows = [("one", 3, 1.0), ("two", 0, 1.0), ("two", 4, 5.0), (None, 0, 2.0), (None, 2, 2.0), ("nulls", None, 1.0), ("nulls", 1, None), ("same", 5, 1.0), ("same", 5, 9.0)]
    got = sorted(((r[0] or "", (r[1] - int(T0.timestamp() * 1e6)) // 60_000_000, r["value"], r["fill"]) for r in regrid.regular_grid(regrid.period_readings(frame(spark, rows))).collect()))
    assert got == [("", 0, 2.0, "observed"), ("", 1, 2.0, "filled"), ("", 2, 2.0, "observed"), ("one", 3, 1.0, "observed"), ("same", 5, 9.0, "observed"), *[("two", m, pytest.approx(1.0 + m), "observed" if m in (0, 4) else "filled") for m in range(5)]]
    assert regrid.regular_grid(regrid.period_readings(frame(spark, []))).count() == 0


def test_long_silence_expands_in_steps(spark):
    grid = regrid.regular_grid(regrid.period_readings(frame(spark, [("g", 0, 1.0), ("g", 1000, 2.0)])), shard_periods=7)
    assert grid.count() == 1001 and grid.where("fill = 'gap'").count() == 999 and grid.select("period_start_micros").distinct().count() == 1001
