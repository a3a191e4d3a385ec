import random

import pytest

from tickloom.operators import shards, spikes

SCHEMA = "series string, entity string, t bigint, u double, row_id bigint"


def flagged(spark, rows, **kw):
    out = spikes.implausible(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    return {(r["row_id"], r["reason"]) for r in out}


def walk(n, seed=1, entity="e", first=0):
    rnd, u, rows = random.Random(seed), 10_000, []
    for k in range(n):
        u += rnd.choice([-3, -2, -1, 0, 1, 2, 3])
        rows.append(["s", entity, k * 1_000_000, float(u), first + k])
    return rows


def test_spikes_of_any_width_and_their_repeats(spark):
    rows = walk(300)
    for start, width in ((20, 1), (60, 3), (120, 5)):
        for k in range(start, start + width):
            rows[k][3] += 500
    rows.append(["s", "e", 60 * 1_000_000, rows[60][3], 900])  # delivered again
    want = {(k, "spike") for k in (20, 60, 61, 62, *range(120, 125), 900)}
    assert flagged(spark, rows) == want


def test_lasting_change_wide_excursion_and_lively_stretch_are_none(spark):
    rows = walk(300)
    for k in range(100, 300):
        rows[k][3] += 800
    for k in range(200, 206):
        rows[k][3] += 500
    rnd = random.Random(2)
    for k in range(240, 280):
        rows[k][3] += rnd.choice([-15, 0, 15])
    assert flagged(spark, rows) == set()


def test_impossible_values_nulls_and_unknown_times(spark):
    rows = walk(100)
    for k, v in ((5, 0.0), (6, -10_000.0), (7, 99_999_900.0), (8, float("nan")), (9, float("inf")), (10, None), (11, 1_000.0)):
        rows[k][3] = v
    rows.append(["s", "e", None, -1.0, 500])
    rows.append(["s", "e", None, 10_000.0, 501])
    rows.append(["s", None, 5, -1.0, 502])
    assert flagged(spark, rows) == {(k, "impossible") for k in (5, 6, 7, 8, 9, 11, 500, 502)}


def test_standstill_even_around_a_spike(spark):
    rows = walk(300)
    for k in range(100, 150):
        rows[k][3] = rows[100][3]
    rows[120][3] += 900
    rows[200][3] = rows[201][3] = rows[202][3]
    rows[99][3], rows[150][3] = rows[100][3] - 2, rows[100][3] + 2
    assert flagged(spark, rows) == {(k, "spike" if k == 120 else "still") for k in range(100, 150)}


def test_many_entities_and_empty(spark):
    rows = walk(120, 1, "a") + walk(120, 2, None, 200)
    rows[50][3] += 700
    rows[120 + 70][3] -= 700
    assert flagged(spark, rows) == {(50, "spike"), (270, "spike")}
    assert flagged(spark, []) == set()


@pytest.mark.parametrize("gap", [2, 4])
def test_neighbouring_spikes_do_not_pair_across(spark, gap):
    rows = walk(200)
    for k in (100, 100 + gap):
        rows[k][3] += 600
    assert flagged(spark, rows) == {(100, "spike"), (100 + gap, "spike")}


def test_spikes_at_the_ends_of_a_series(spark):
    rows = walk(200)
    for k in (0, 1, 197, 198, 199):
        rows[k][3] += 600
    assert flagged(spark, rows) == {(k, "spike") for k in (0, 1, 197, 198, 199)}
    rows = walk(200)
    for k in (0, 1, 2, 3, 196, 197, 198, 199):  # mirrored, these are away for seven readings
        rows[k][3] += 600
    assert flagged(spark, rows) == set()


def test_wrong_extreme_and_change_of_level_at_the_ends_of_candles(spark):
    schema = "generation string, open_time_micros bigint, candle_id bigint, open_units bigint, high_units bigint, low_units bigint, close_units bigint"

    def candles(entity, first):
        low = [r[3] for r in walk(60, first + 1)]
        return [[entity, k * 60_000_000, first + k, int(x) + 1, int(x) + 4, int(x), int(x) + 3] for k, x in enumerate(low)]

    rows = candles("a", 0) + candles("b", 100) + candles("c", 200)
    rows[0][5] -= 900  # a: a wrong low at the start, two wrong highs of different heights at the end
    rows[58][4] += 300
    rows[59][4] += 2_000
    for k in (60, 119):  # b: levels that change in the first and the last candle, with open and close
        rows[k][3:] = [x + 700 for x in rows[k][3:]]
    rows[179][4] += 10  # c: nothing far out
    ticks = spark.createDataFrame([], "generation string, event_time_micros timestamp, price double, tick_id bigint")
    gens = spark.createDataFrame([], "generation string, price_scale int")
    frame = spark.createDataFrame(rows, schema).selectExpr("generation", "timestamp_micros(open_time_micros) as open_time_micros", "candle_id", "open_units", "high_units", "low_units", "close_units")
    assert sorted(tuple(r) for r in spikes.implausible_rows(ticks, gens, frame).collect()) == [("candles", k, "spike") for k in (0, 58, 59)]


def test_rows_of_both_tables(spark):
    ticks = spark.createDataFrame([], "generation string, event_time_micros timestamp, price double, tick_id bigint")
    gens = spark.createDataFrame([], "generation string, price_scale int")
    candles = spark.createDataFrame([("g", None, 1, 5, 9), ("g", None, 2, 7, 6)], "generation string, open_time_micros timestamp, candle_id bigint, high_units bigint, low_units bigint")
    assert [tuple(r) for r in spikes.implausible_rows(ticks, gens, candles).collect()] == [("candles", 1, "crossed")]


def test_many_series_go_through_the_driver_in_small_tables_only(spark, monkeypatch):
    sent, send = [], shards.F.broadcast
    monkeypatch.setattr(shards.F, "broadcast", lambda df: sent.append(df) or send(df))
    rows = spark.range(20_000).selectExpr("'s' as series", "concat(repeat('e', 500), id div 2) as entity", "id as t", "if(id = 7, -1.0d, 5.0d) as u", "id as row_id")
    assert [tuple(r) for r in spikes.implausible(rows).collect()] == [("s", 7, "impossible")]
    assert all(shards.fits(df, max_bytes=4 << 20) for df in sent)


def test_series_that_are_not_broadcast_give_the_same(spark, monkeypatch):
    rows = walk(400, 1, "a") + walk(150, 2, None, 1_000) + walk(30, 3, "c", 2_000)
    for k in (0, 99, 100, 101, 199, 200, 300, 399, 450, 549, 560):
        rows[k][3] += 700
    for k in range(220, 260):
        rows[k][3] = rows[220][3]
    rows[320][3], rows[321][3] = -1.0, float("nan")
    rows.append(["s", "a", 300 * 1_000_000, rows[300][3], 3_000])
    want = flagged(spark, rows)
    assert {r for _, r in want} == {"spike", "still", "impossible"}
    monkeypatch.setattr(spikes, "fits", lambda *_, **__: False)
    monkeypatch.setattr(shards, "fits", lambda *_, **__: False)
    assert flagged(spark, rows) == want
