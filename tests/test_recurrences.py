import random

from tickloom.operators import features as fe
from tickloom.sources import pages


def test_moving_averages_and_legs(spark):
    """The carried state over rows in segments, against the recurrences written out."""
    rnd, rows, ordinal = random.Random(4), [], 0
    for g in ("a", "b"):
        seg = 1
        for k in range(70):
            new = k == 0 or rnd.random() < 0.05
            seg += k > 0 and new
            ordinal += 1
            rows.append((g, ordinal, seg, 1000 + rnd.randrange(-20, 20), rnd.choice(["up", "down", "flat"]), rnd.choice(["up", "up", "down", "sideways", "unknown"])))
    cols = "generation string, ordinal bigint, clean_segment_index bigint, close_units bigint, candle_direction string, directional_state string"
    df = spark.createDataFrame(rows, cols)
    df = df.selectExpr("*", "row_number() over (partition by generation, clean_segment_index order by ordinal) - 1L as clean_segment_candle_index", "false as breakout_up", "false as breakout_down", "cast(null as bigint) as last_swing_high_units", "cast(null as bigint) as last_swing_low_units", "ordinal as close_micros", "row_number() over (partition by generation order by ordinal) - 1L as _row")
    got = {r["ordinal"]: r for r in fe.carried(df.withColumn("clean_segment_candle_index", df["clean_segment_candle_index"].cast("bigint"))).collect()}
    state = {}
    for g, o, seg, close, d, s in rows:
        e, n, sg, leg, age, still = state.get(g, (None, 0, None, "none", 0, 0))
        e, n = (float(close), 1) if sg != seg else (2 / 21 * close + 19 / 21 * e, n + 1)
        r = got[o]
        assert abs(r["ema20"] - e) < 1e-5 and r["is_ema20_ready"] == (n >= 20)
        assert r["pullback_against_trend"] == (leg in ("up", "down") and age >= 2 and d in ("up", "down") and d != leg)
        if s in ("up", "down"):
            leg, age, still = s, (age + 1 if leg == s else 1), 0
        else:
            still += 1
            if still >= 3:
                leg, age = "none", 0
        assert (r["trend_leg_direction"], r["trend_leg_age_candles"]) == (leg, age)
        state[g] = (e, n, seg, leg, age, still)


def test_overlap_of_pages(spark):
    p = {1: [(1, "a"), (2, "b"), (2, "b")], 2: [(2, "b"), (2, "b"), (3, "c")], 3: [(3, "c"), (3, "c")], 4: [(9, "z")], 5: [(9, "z")]}
    rows = [("q", o, "d", k, t, x) for o, page in p.items() for k, (t, x) in enumerate(page)] + [("q", 5, "e", 0, 9, "z"), ("q", 5, "e", 1, 9, "y"), (None, 1, None, 0, 1, "a")]
    out = pages.without_overlap(spark.createDataFrame(rows, "acquisition string, ordinal bigint, digest string, place int, t_millis bigint, price string")).collect()
    assert sorted((r["ordinal"], r["place"], r["price"]) for r in out if r["acquisition"]) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "b"), (2, 2, "c"), (3, 1, "c"), (4, 0, "z"), (5, 1, "y")]
