import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom import research_queries
from tickloom.operators import asof, late_events, paths, search
from tickloom.sources import files
from tickloom.streaming import jobs


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("shard", [900_000_000, 5])
def test_asof(spark, forward, shard):
    rnd = random.Random(1)
    left = [(i, rnd.choice(["a", "a", "b", None]), rnd.choice([None, *range(60)])) for i in range(120)]
    right = [(rnd.choice(["a", "a", None]), rnd.choice([None, *range(60)]), k) for k in range(50)]
    x = asof.asof(spark.createDataFrame(left, "i bigint, k string, t bigint"), spark.createDataFrame(right, "k string, rt bigint, v bigint"), "k", "t", "rt", ["v"], "m", forward, "v", shard)
    got = {r["i"]: None if r["m"] is None else (r["m"]["rt"], r["m"]["v"]) for r in x.collect()}
    for i, k, t in left:
        fit = [(rt, v) for kk, rt, v in right if kk == k and rt is not None and t is not None and (rt >= t if forward else rt <= t)]
        assert got[i] == ((min(fit) if forward else max(fit)) if fit else None)
    assert x.columns == ["i", "k", "t", "m"] and len(got) == 120


def test_tail_and_adjustment(spark):
    from math import comb

    for w, n, p in ((3, 5, 0.5), (0, 4, 0.3), (40, 60, 0.52), (7, 7, 0.1)):
        assert search.upper_tail(w, n - w, p) == pytest.approx(sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(w, n + 1)))
    for n in (10**4, 10**6):  # against sums of the exact logarithms
        w = np.array([n // 2 - 300, n // 2, n // 2 + 40, n // 2 + 500])
        for k, got in zip(w, search.upper_tails(w, n - w, 0.5)):
            terms = [comb(10**4, j) for j in range(k, 10**4 + 1)] if n == 10**4 else None
            assert terms is None or got == pytest.approx(sum(terms) / 2**10**4, rel=1e-9)
            assert 0 <= got <= 1
    assert search.upper_tails(np.array([5 * 10**7 + 5000]), np.array([5 * 10**7 - 5000]), 0.5)[0] == pytest.approx(0.15865525, rel=2e-4)
    assert search.upper_tails(np.array([0, 3, 3]), np.array([0, 0, 2]), 0.0).tolist() == [1.0, 0.0, 0.0] and search.upper_tails(np.array([3]), np.array([2]), 1.0)[0] == 1.0
    rnd = random.Random(2)
    ps = [(f"c{k}", rnd.choice([None, 0.0, 1.0, 1.0, 1e-9, rnd.random() ** 3])) for k in range(80)]
    got = {r["conditions"]: r["adjusted"] for r in search.adjusted(spark.createDataFrame(ps, "conditions string, p_value double")).collect()}
    order = sorted((p, c) for c, p in ps if p is not None)
    for k, (_, c) in enumerate(order):
        assert got[c] == pytest.approx(min(1.0, min(q * len(order) / (j + 1) for j, (q, _) in list(enumerate(order))[k:])))
    assert all(got[c] is None for c, p in ps if p is None) and len(got) == 80


def test_one_at_a_time(spark):
    rnd = random.Random(3)
    rows = [(f"c{rnd.randrange(4)}", k, e := rnd.randrange(100), e + rnd.choice([0, 5, 30])) for k in range(200)] + [("c0", 900, None, 5), ("c0", 901, 3, None)]
    got = {r["row"]: r["kept"] for r in search.one_at_a_time(spark.createDataFrame(rows, "candidate string, row bigint, entry bigint, release bigint")).collect()}
    for c in {r[0] for r in rows}:
        busy = -1
        for _, k, e, z in sorted((r for r in rows if r[0] == c and r[2] is not None), key=lambda r: (r[2], r[1])):
            z = z or 0
            assert got[k] == (busy <= e and z > 0)
            busy = z if got[k] else busy
    assert 900 not in got


def test_paths(spark):
    v = [3, -5, 1, -1, 0, 9, -2, -2, 4]
    df = spark.createDataFrame([("p", k, x) for k, x in enumerate(v)], "path string, k bigint, v bigint")
    d = paths.drawdowns(df, "path", ["k"], "v").collect()[0]
    dd, under, negative = paths.path_numbers(np.array(v, float), 3)
    assert (d["max_drawdown"], d["longest_underwater"], d["total"]) == (dd, under, 7) == (5, 4, 7)
    assert negative == sum(sum(v[k : k + 3]) < 0 for k in range(len(v) - 2))
    s = paths.streaks(df, "path", ["k"], "v").collect()[0]
    assert (s["loss_streak"], s["win_streak"]) == (2, 1)
    assert tuple(paths.worst_sums(df, "path", ["k"], "v", (3, 20)).collect()[0]) == ("p", min(sum(v[k : k + 3]) for k in range(7)), None)
    assert paths.path_numbers(np.empty(0), 3) == (0.0, 0, 0)


@pytest.mark.parametrize("n, block_length", [(0, 3), (1, 1), (1, 5), (2, 2), (7, 1), (50, 3), (400, 5), (3000, 10), (40, 1000)])
def test_block_paths(n, block_length):
    """Indices in range, the same for the same replicate, others for another; blocks go on by one round the end and are as long as stated on average."""
    draws = [paths.block_path(7, "m/c", r, n, block_length) for r in range(60)]
    assert all(len(x) == n and (n == 0 or (0 <= x.min() and x.max() < n)) for x in draws)
    assert draws[3].tolist() == paths.block_path(7, "m/c", 3, n, block_length).tolist()
    if n >= 50 and block_length < n:
        assert len({tuple(x) for x in draws}) == 60 and draws[0].tolist() != paths.block_path(7, "m/d", 0, n, block_length).tolist()
        goes_on = np.mean([np.mean(np.diff(x) % n == 1) for x in draws])
        assert abs(goes_on - (1 - 1 / block_length + 1 / block_length / n)) < 0.03
        starts = np.concatenate(draws)
        assert abs(starts.mean() / n - 0.5) < 0.05


def test_bootstrap_resamples_the_trades_of_each_path(spark, monkeypatch):
    monkeypatch.setattr(paths, "PIECE", 16)
    rnd = random.Random(4)
    v = {p: [rnd.choice([92, -100, 0]) for _ in range(n)] for p, n in (("a/30", 70), ("a/60", 1), ("b/30", 9))}
    rows = [(p, k // 2, k, x) for p, xs in v.items() for k, x in enumerate(xs)]
    rnd.shuffle(rows)
    out = paths.bootstrap_trades(spark.createDataFrame(rows, "path string, t bigint, id bigint, value bigint"), "path", ["t", "id"], "value", 30, 5, 5).collect()
    assert len(out) == 90
    for r in out:
        x = np.array(v[r["path"]], float)
        want = paths.path_numbers(x[paths.block_path(42, r["path"], r["replicate"], len(x), 5)], 5)
        assert (r["n"], r["max_drawdown"], r["longest_underwater"], r["negative_rolling"]) == (len(x), *want[:2], want[2] if len(x) >= 5 else None)


def test_bootstrap_query_has_every_path(spark, data):
    out = research_queries.bootstrap_paths(spark, data).groupBy("path").agg(F.count("*").alias("k"), F.max("n").alias("n"))
    assert {(r["path"], r["n"]) for r in out.where("k = 200").collect()} == {(r["path"], r["n"]) for r in research_queries.path_drawdowns(spark, data).collect()}


def test_csv_daily_and_lines(spark, tmp_path):
    (tmp_path / "t.csv").write_text("time_utc,symbol,price\n2020-01-01T00:00:00.5Z,X,1.25\n2020-01-01T00:00:01Z,Y,1.25\n2020-01-01 00:00:01Z,X,1\n2020-01-01T00:00:02Z,X,1.255\n2020-01-02T00:00:02Z,X,-3\n")
    rows = files.read_tick_csv(spark, str(tmp_path / "t.csv"), "X", 2).collect()
    assert [(r["units"], r["reason"]) for r in rows] == [(125, None), (125, "other_symbol"), (100, "bad_time"), (None, "bad_price"), (-300, None)]
    good = spark.createDataFrame(rows).where("reason is null").selectExpr("timestamp_micros(t) as event_time_micros", "units as price_units")
    files.write_daily(good, str(tmp_path / "d"), "event_time_micros")
    one = files.read_daily(spark, str(tmp_path / "d"), files.TICKS, "2020-01-02", "2020-01-05")
    assert [r["price_units"] for r in one.collect()] == [-300] and files.strays(one, "event_time_micros").count() == 0
    files.write_lines(good, str(tmp_path / "l"))
    assert files.read_lines(spark, str(tmp_path / "l"), files.TICKS).count() == 2
    with pytest.raises(ValueError):
        files.checked_schema(good, "a bigint")
    assert files.checked_schema(good, files.TICKS) is good


def test_streams_agree_with_batches(spark, data):
    stream = jobs.run_to_end(jobs.candle_stream(jobs.tick_stream(spark, f"{data}/ticks.parquet")), "t-candles")
    got = {tuple(r) for r in stream.collect()}
    batch = {tuple(r) for r in jobs.candle_stream(spark.read.parquet(f"{data}/ticks.parquet")).collect()}
    assert got and got <= batch


def test_streamed_retractions_leave_what_the_batch_leaves(spark, data, tmp_path):
    ticks, pages = spark.read.parquet(f"{data}/ticks.parquet"), spark.read.parquet(f"{data}/raw_pages.parquet")
    extra = spark.createDataFrame([(-1, "i", None, "2017-01-10 00:00:00", "2017-01-10 00:04:00", None, None, None), (-2, "i", None, "2017-01-10 00:00:00", "2017-01-10 00:44:00", 5.0, None, None)], "tick_id bigint, instrument string, generation string, e string, k string, price double, acquisition_id string, page_ordinal bigint")
    ticks = extra.selectExpr("tick_id", "instrument", "generation", "timestamp(e) as event_time_micros", "timestamp(k) as known_at_micros", "price", "acquisition_id", "page_ordinal").unionByName(ticks)
    ticks.repartitionByRange(5, "known_at_micros").write.parquet(str(tmp_path / "ticks.parquet"))
    got = jobs.run_to_end(jobs.retractions(jobs.tick_stream(spark, str(tmp_path / "ticks.parquet"), 100), pages), "t-changes")
    got = {tuple(r[:2]): tuple(r[2:]) for r in got.groupBy("generation", "period_start_micros").agg(F.sum(F.col("change") * F.col("n")), F.sum(F.col("change") * F.col("n_values"))).collect()}
    batch = late_events.consolidate(late_events.changelog(late_events.revisions(ticks, pages)))
    assert got == {(r[0], r[1]): (r["n"], r["n_values"]) for r in batch.collect()} and any(k[0] is None for k in got)
