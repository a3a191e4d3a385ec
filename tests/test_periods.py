import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions.text import digest, identifier, instant_micros
from tickloom.operators.periods import continuous_periods, gaps


def brute(rows):
    out = {}
    for key in {r[:2] for r in rows}:
        spans, merged = sorted((s, e) for a, b, s, e in rows if (a, b) == key and s is not None and e is not None and s < e), []
        for s, e in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        for k, (s, e) in enumerate(merged):
            out[(*key, s, e)] = merged[k + 1][0] if k + 1 < len(merged) else None
    return out


def periods(spark, rows, block):
    df = spark.createDataFrame([(*r, "x") for r in rows], "g string, f string, s bigint, e bigint, period_start string")
    return continuous_periods(df, ["g", "f"], "s", "e", block)


@pytest.mark.parametrize("block", [30 * 86_400_000_000, 50, 7])
def test_against_brute_force(spark, block):
    rnd = random.Random(4)
    rows = [(rnd.choice(["hot", "hot", "b", None]), rnd.choice(["x", None]), rnd.choice([None, s := rnd.randrange(-200, 400), s]), rnd.choice([None, s + rnd.randrange(-3, 25), s + rnd.randrange(60)])) for _ in range(160)]
    got = [tuple(r) for r in periods(spark, rows, block).collect()]
    assert {r[:4]: r[4] for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_far_ends_and_settings(spark):
    """A span that lasts for ages is one row, and the setting the merge needs is put back."""
    before = spark.conf.get("spark.sql.sessionWindow.merge.sessions.in.local.partition", None)
    far = 250_000 * 365 * 86_400_000_000 // 1_000
    rows = [("g", "f", k * 1_000, k * 1_000 + 10) for k in range(200)] + [("g", "f", 50_500, far), ("g", "f", far + 5, far + 6), ("h", "f", -5, far)] * 3
    got = [tuple(r) for r in periods(spark, rows, 1_000).collect()]
    assert {r[:4]: r[4] for r in got} == brute(rows) and len(got) == len(brute(rows))
    assert spark.conf.get("spark.sql.sessionWindow.merge.sessions.in.local.partition", None) == before


def test_touching_nesting_repeats_and_empty(spark):
    p = periods(spark, [("g", "f", 0, 10), ("g", "f", 10, 20), ("g", "f", 12, 15), ("g", "f", 0, 10), ("g", "f", 21, 22), ("g", "f", 5, 5)], 1000)
    assert [tuple(r) for r in gaps(p, ["g", "f"]).collect()] == [("g", "f", 20, 21)]
    assert periods(spark, [], 10).count() == 0


def test_spellings(spark):
    texts = ["2017-01-10T12:52:00Z", "2017-01-10 12:52:00.000000+00:00", " 2017-01-10t12:52:00.0z", "2017-01-10T14:52:00+02:00", "2017-01-10T14:52:00+0200", "20170110T125200Z", "2017-01-10T12:52", "2017-01-10T12:52:00,000Z", "no", "", None, "2017-13-10T12:52:00Z"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(instant_micros(F.col("t"))).collect()]
    assert got == [1484052720000000] * 8 + [None] * 4
    row = spark.range(1).select(identifier(F.lit(" ACQ-1\t")), digest(F.lit("SHA-256: AB")), digest(F.lit("sha256:ab")), digest(F.lit("0xAB"))).collect()[0]
    assert tuple(row) == ("acq-1", "ab", "ab", "ab")
