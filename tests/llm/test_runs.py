import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tickloom.llm import runs

T0 = datetime(2020, 1, 1, tzinfo=timezone.utc)
SCHEMA = "generation string, event_time_micros timestamp, tick_id bigint, price double, value string, n_records string"


def frame(spark, rows):
    return spark.createDataFrame([(g, None if t is None else T0 + timedelta(seconds=t), i, p, "x", "y") for g, t, i, p in rows], SCHEMA)


def brute(rows, least):
    out = set()
    for g in {r[0] for r in rows}:
        x = sorted(((t, i, p) for gg, t, i, p in rows if gg == g and t is not None and p is not None), key=lambda r: r[:2])
        k = 0
        while k < len(x):
            e = k
            while e + 1 < len(x) and x[e + 1][2] == x[k][2]:
                e += 1
            if e - k + 1 >= least:
                out.add((g, x[k][1], e - k + 1, (x[e][0] - x[k][0]) * 1_000_000))
            k = e + 1
    return out


def collapsed(df, shards, least=1):
    return [(r["generation"], r["first_id"], r["n_records"], r["duration_micros"]) for r in runs.collapse_runs(df, F.col("price"), shards=shards, min_records=least).collect()]


def test_against_brute_force_over_shards(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", "hot", "hot", "b", None]), rnd.choice([None, *range(40)]), i, rnd.choice([None, 1.0, 1.0, 2.0])) for i in range(400)]
    df = frame(spark, rows)
    for shards in (1, 7):
        for least in (1, 2):
            got = collapsed(df, shards, least)
            assert len(got) == len(set(got)) and set(got) == brute(rows, least)


def test_one_run_over_all_shards_and_equal_runs_apart(spark):
    rows = [("g", t, t, 5.0) for t in range(50)] + [("h", 0, 100, 1.0), ("h", 1, 101, 2.0), ("h", 2, 102, 1.0)]
    assert set(collapsed(frame(spark, rows), 9)) == {("g", 0, 50, 49_000_000), ("h", 100, 1, 0), ("h", 101, 1, 0), ("h", 102, 1, 0)}


def test_empty_and_rounding(spark):
    assert collapsed(frame(spark, []), 3) == []
    ticks = frame(spark, [("g", 0, 0, 1.001), ("g", 1, 1, 1.004), ("g", 2, 2, 1.006), ("u", 0, 3, 1.001), ("u", 1, 4, 1.004)])
    scales = spark.createDataFrame([("g", 2), ("g", 2), (None, 3)], "generation string, price_scale int")
    assert [(r["first_id"], r["n_records"]) for r in runs.standing_prices(ticks, scales).collect()] == [(0, 2)]
