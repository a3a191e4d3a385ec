import json
import random
from datetime import date, datetime, timezone
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tickloom.functions import exact
from tickloom.operators import coverage, search, sessions
from tickloom.sources import files

M = 1_000_000


def micros(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * M


def test_skipped_and_doubled_hours_are_refused(spark):
    walls = ["2017-03-12 02:30:00", "2017-11-05 01:30:00", "2017-11-05 00:30:00", "2017-11-05 02:30:00", "2017-03-12 03:30:00"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in walls], "w string").coalesce(1).select(sessions.boundary(F.to_timestamp("w"), "America/New_York")).collect()]
    assert got == [None, None, micros(2017, 11, 5, 4, 30), micros(2017, 11, 5, 7, 30), micros(2017, 3, 12, 7, 30)]


def test_intervals_and_next_buckets(spark):
    week = sessions.Weekly(days={0: (0, 3600), 2: (36_000, 36_090)}, closed=("2017-01-09",), early={"2017-01-02": 1800})
    days = spark.createDataFrame([(date(2017, 1, k),) for k in (1, 2, 2, 4, 9, 16)] + [(None,)], "day date")
    got = {r["day"].day: (r["open_micros"], r["close_micros"]) for r in sessions.intervals(days, week).collect()}
    assert got == {2: (micros(2017, 1, 2, 5), micros(2017, 1, 2, 5, 30)), 4: (micros(2017, 1, 4, 15), micros(2017, 1, 4, 15, 1, 30)), 16: (micros(2017, 1, 16, 5), micros(2017, 1, 16, 6))}
    far = micros(2017, 2, 1)
    rows = [(1, micros(2017, 1, 1), far), (2, micros(2017, 1, 2, 5, 30), far), (3, micros(2017, 1, 2, 5, 30) + 1, far), (4, micros(2017, 1, 2, 5, 10), micros(2017, 1, 2, 5, 14)), (5, micros(2017, 1, 17), far), (6, None, far)]
    out = {r["k"]: r["bucket"] for r in sessions.next_buckets(spark.createDataFrame(rows, "k int, at bigint, limit bigint"), sessions.intervals(days, week), 300).collect()}
    # The session of the 4th holds its opening bucket only; after that comes the 16th.
    assert out == {1: micros(2017, 1, 2, 5), 2: micros(2017, 1, 2, 5, 30), 3: micros(2017, 1, 4, 15), 4: None, 5: None, 6: None}
    assert sessions.next_buckets(spark.createDataFrame(rows, "k int, at bigint, limit bigint"), sessions.intervals(days.limit(0), week), 300).where("bucket is not null").count() == 0


def test_fills_known_and_trailing(spark):
    c = spark.createDataFrame([("g", 0, 130 * M, 5), ("g", 240 * M, 301 * M, 7), ("h", 0, 61 * M, 1)], "generation string, open_micros bigint, known_at_micros bigint, close_units bigint")
    c = c.selectExpr("*", "close_units as open_units", "close_units as high_units", "close_units as low_units", "1L as observations", "'none' as fill")
    cover = spark.createDataFrame([("g", 0, 190 * M), ("h", 0, 200 * M)], "generation string, start bigint, end bigint")
    got = {(r["generation"], r["open_micros"] // M): (r["fill"], r["known_at_micros"] // M) for r in sessions.continuous_known(c, cover).collect()}
    assert got == {("g", 0): ("none", 130), ("g", 60): ("engine", 120), ("g", 120): ("engine", 180), ("g", 180): ("engine", 301), ("g", 240): ("none", 301), ("h", 0): ("none", 61), ("h", 60): ("engine", 120), ("h", 120): ("engine", 180)}


def test_inventories(spark):
    day = 86_400 * M
    rows = [(1, 0, 1440, 0, day - 60 * M, "complete"), (2, 0, 1440, 60 * M, day - 60 * M, "complete"), (3, None, 1, 0, 0, "partial"), (4, 0, -1, 0, 0, "partial"), (5, 0, 3, None, 0, "partial"), (6, 0, 0, 5, None, "partial"), (7, 0, 2, 9, 5, "partial"), (8, 0, 2, 0, day, "partial"), (9, 0, None, None, None, "complete"), (10, 0, 2, 0, 5, "empty_known"), (11, 0, 2, 0, 5, None)]
    df = spark.createDataFrame(rows, "i int, day bigint, n_rows bigint, first bigint, last bigint, state string").withColumn("duration_seconds", F.lit(60))
    assert {r["i"]: r["problem"] for r in coverage.inventory_problems(df).collect()} == {1: None, 2: None, 3: "bad_day", 4: "negative_rows", 5: "rows_without_bounds", 6: "bounds_without_rows", 7: "reversed", 8: "outside_day", 9: "state_without_rows", 10: "rows_in_empty", 11: None}
    assert [r["i"] for r in coverage.full_grid(df).where("full").collect()] == [1]
    spans = spark.createDataFrame([("a", 0, 1, 5), ("a", 1, 5, 7), ("a", 2, 6, 9), ("b", 0, 3, 3), ("b", 1, 9, 2)], "k string, place int, start bigint, end bigint")
    assert sorted((r["k"], r["place"], r["problem"]) for r in coverage.disorder(spans, ["k"], "place").collect()) == [("a", 2, "overlap"), ("b", 0, "empty"), ("b", 1, "reversed")]
    listed = spark.createDataFrame([("a", 0), ("a", 2 * day), ("a", None)], "g string, day bigint")
    cover = spark.createDataFrame([("a", 0, 2 * day), ("z", 0, 1)], "g string, start bigint, end bigint")
    assert sorted((r["g"], r["day"] // day, r["finding"]) for r in coverage.against_coverage(listed, cover, "g").collect()) == [("a", 1, "missing"), ("a", 2, "outside"), ("z", 0, "missing")]


def test_reachability_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("a", "d"), (None, "q"), ("b", None)], "source string, target string")
    roots = spark.createDataFrame([("a",), ("lone",), (None,), ("a",)], "node string")
    assert {(r["node"], r["steps"]) for r in coverage.reachable(edges, roots).collect()} == {("a", 0), ("lone", 0), ("b", 1), ("d", 1), ("c", 2)}
    assert coverage.reachable(edges.limit(0), roots.limit(0)).count() == 0


def test_exact_arithmetic(spark):
    assert exact.crc32c_all([b"123456789", None, b"", bytes(32)]) == [0xE3069283, None, 0, 0x8A9136AA]
    rnd = random.Random(3)
    rows = [(rnd.randrange(-10**15, 10**15), rnd.choice([0, 3, 8, rnd.randrange(-10**6, 10**6)])) for _ in range(200)] + [(1, 2 * 10**14), (3, 2 * 10**14), (-1, 2 * 10**14), (None, 5), (5, None)]
    got = spark.createDataFrame(rows, "m bigint, e bigint").coalesce(1).select(exact.basis_points_text(F.col("m"), F.col("e"))).collect()
    for (m, e), r in zip(rows, got):
        if m is None or not e:
            assert r[0] is None
        else:
            n = round(Fraction(abs(m) * 10**14, abs(e)))  # ties to even
            assert r[0] == ("-" if m < 0 and n else "") + f"{n // 10**10}.{n % 10**10:010d}"
    values = [("a", 1e16), ("a", 1.0), ("a", -1e16), ("b", 0.1)] + [("b", 0.1)] * 9 + [("c", None), (None, 2.5)]
    sums = {r["k"]: r["total"] for r in exact.exact_sums(spark.createDataFrame(values, "k string, v double").repartition(3), ["k"], "v").collect()}
    assert sums == {"a": 1.0, "b": 1.0, None: 2.5}


def test_gates_and_ranks(spark):
    rows = [("a", 60, 10, 500), ("b", 60, 10, 900), ("c", 70, 10, 900), ("d", 2, 1, 900), ("e", 60, 10, 0), ("f", 60, 10, 900)]
    got = {r["conditions"]: (r["gate"], r["place"]) for r in search.gated(spark.createDataFrame(rows, "conditions string, wins bigint, losses bigint, net_units bigint"), 10).collect()}
    assert got == {"c": (None, 1), "b": (None, 2), "f": (None, 3), "a": (None, 4), "d": ("too_few", None), "e": ("unprofitable", None)}


def test_candidates_and_matches_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(k, *[rnd.choice([None, -1, 0, 1, 2]) for _ in range(3)], "z") for k in range(80)]
    df = spark.createDataFrame(rows, "row int, a int, b int, c int, conditions string").drop("conditions")
    menu = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("c", 2), ("c", 2)], "column string, code int")
    sets = {tuple(r["conditions"]) for r in search.candidates(menu, 1, 3).collect()}
    assert len(sets) == 4 + 5 + 2 and ("a=0", "b=0", "c=2") in sets
    named = search.candidates(menu, 1, 3).select(F.concat_ws("&", "conditions").alias("candidate"), "conditions").unionByName(spark.createDataFrame([("none", []), ("twice", ["a=0", "a=0"]), ("gone", ["a=0", "b=9"])], "candidate string, conditions array<string>"))
    got = {(r["candidate"], r["row"]) for r in search.matched(df, ["a", "b", "c"], named).collect()}
    held = {r[0]: {f"{n}={v}" for n, v in zip("abc", r[1:4]) if v is not None and v >= 0} for r in rows}
    want = {("&".join(s), k) for s in sets for k, h in held.items() if set(s) <= h} | {("twice", k) for k, h in held.items() if "a=0" in h}
    assert got == want


def test_daily_tables_of_bars_candles_and_pages(spark, tmp_path):
    t0 = micros(2020, 1, 1)
    bars = spark.createDataFrame([("X", 1, t0 // M + s, 7200 + off, p, 1.0, 2.0, lo, 1.5, v, per) for s, off, p, lo, v, per in ((0, 0, 0, 0.5, 1.0, 60), (60, 60, 0, 0.5, None, 60), (120, 0, 0, 1.2, 1.0, 60), (86400, 0, 0, 0.5, 1.0, 300))], "symbol string, symbol_id int, u bigint, off bigint, p int, open double, high double, low double, close double, volume double, period_s int")
    bars = bars.select("symbol", "symbol_id", F.timestamp_seconds("u").alias("timestamp_utc"), F.col("u").alias("unix_utc_s"), (F.col("u") + F.col("off")).alias("server_time_s"), "open", "high", "low", "close", "volume", "period_s")
    files.write_bars(bars, str(tmp_path / "bars"))
    got = files.read_bars(spark, str(tmp_path / "bars"), "2020-01-01", "2020-01-02", 60, 7200)
    assert sorted(((r["unix_utc_s"] - t0 // M, r["problem"]) for r in got.collect())) == [(0, None), (60, "clock"), (120, "low_too_high"), (86400, "period")]
    assert files.read_bars(spark, str(tmp_path / "bars"), "2020-01-02", "2020-01-09", 60, 7200).count() == 1
    order = spark.createDataFrame([("g", 1, 1), ("g", 1, 2), ("g", 5, 3), ("g", 4, 4), ("h", 0, 5)], "generation string, t bigint, i int")
    assert sorted(r["i"] for r in files.out_of_order(order, "generation", "t", "i").collect()) == [2, 4]
    c = [("g", t0, t0 + 60 * M, t0 + 61 * M, 1, 2, 1, 2, 3, "none"), ("g", t0 + 60 * M, t0 + 90 * M, t0 + 99 * M, 1, 2, 1, 2, 3, "none"), ("g", t0 + 61 * M, t0 + 121 * M, t0 + 121 * M, 1, 2, 1, 2, 3, "none"), ("g", t0 + 120 * M, t0 + 180 * M, t0 + 100 * M, 1, 2, 1, 2, 3, "none"), ("g", t0 + 180 * M, t0 + 240 * M, t0 + 240 * M, 1, 1, 1, 2, 3, "source")]
    files.write_candles(spark.createDataFrame(c, files.CANDLES), str(tmp_path / "candles"))
    back = files.read_candles(spark, str(tmp_path / "candles"), "2020-01-01", "2020-01-01", 60)
    assert [r["problem"] for r in back.orderBy("open_micros").collect()] == [None, "length", "off_grid", "early", "range"]
    import hashlib

    pages = [("q", 1, b"abc", hashlib.sha256(b"abc").hexdigest(), datetime(2020, 1, 1, 5)), ("q", 2, b"abd", "00", datetime(2020, 1, 2, 5)), ("q", 3, None, None, datetime(2020, 1, 2, 6))]
    files.write_pages(spark.createDataFrame(pages, files.PAGES), str(tmp_path / "pages"))
    assert [(r["ordinal"], r["intact"]) for r in files.read_pages(spark, str(tmp_path / "pages"), "2020-01-01", "2020-01-02").orderBy("ordinal").collect()] == [(1, True), (2, False), (3, None)]
    inventory = spark.createDataFrame([(date(2020, 1, 2), 2), (date(2020, 1, 5), 0)], "date date, n_rows bigint")
    rows = files.read_generation(spark, str(tmp_path / "pages"), inventory, files.PAGES, "receipt_time_utc").collect()
    assert [(r["ordinal"], r["listed_rows"], r["day_no"]) for r in rows] == [(2, 2, 1), (3, 2, 1)]


def test_archive_plan_and_published_tables(spark, tmp_path):
    (tmp_path / "a" / "deep").mkdir(parents=True)
    for name in ("X_2020-01-01_ticks.parquet", "X_2020-01-02_ticks.parquet", "deep/X_2020-01-02_ticks.parquet", "Y_2020-13-02_ticks.parquet", "notes.txt", "Z_2020-01-05_ticks.parquet"):
        (tmp_path / "a" / name).write_bytes(b"1234")
    for name, rows in (("X_2020-01-01", 7), ("X_2020-01-02", 8)):
        (tmp_path / "a" / f"{name}_ticks.meta.json").write_text(json.dumps({"rows": rows}))
    got = {r["path"].split("/a/")[1]: (r["name"], r["n_rows"], r["problem"]) for r in files.daily_archive(spark, str(tmp_path / "a")).collect()}
    assert got == {"X_2020-01-01_ticks.parquet": ("X", 7, None), "X_2020-01-02_ticks.parquet": ("X", 8, "repeated"), "deep/X_2020-01-02_ticks.parquet": ("X", None, "repeated"), "Y_2020-13-02_ticks.parquet": ("Y", None, "undeclared"), "notes.txt": (None, None, "undeclared"), "Z_2020-01-05_ticks.parquet": ("Z", None, "no_meta")}
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "i bigint, s string")
    at = str(tmp_path / "table")
    assert files.publish(df, at)["rows"] == 3 and files.verified(spark, at, "i bigint, s string")["rows"] == 3
    df.limit(1).write.mode("append").parquet(at)
    with pytest.raises(ValueError):
        files.verified(spark, at, "i bigint, s string")
    with pytest.raises(Exception):
        files.publish(df, at)
