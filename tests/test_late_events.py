import random
from datetime import datetime, timedelta, timezone

from tickloom.operators import late_events as le

T0 = datetime(2020, 1, 1, tzinfo=timezone.utc)
TICKS = "tick_id bigint, generation string, event_time_micros timestamp, known_at_micros timestamp, price double, acquisition_id string, page_ordinal bigint, revision int"
PAGES = "acquisition_id string, ordinal bigint, receipt_time_utc timestamp"


def at(seconds):
    return None if seconds is None else T0 + timedelta(seconds=seconds)


def run(spark, ticks, pages=()):
    t = spark.createDataFrame([(i, g, at(e), at(k), p, a, o, 7) for i, (g, e, k, p, a, o) in enumerate(ticks)], TICKS)
    r = spark.createDataFrame([(a, o, at(k)) for a, o, k in pages], PAGES)
    return le.changelog(le.revisions(t, r))


def found(changes):
    base = int(T0.timestamp() * 1e6)
    return {(r[0], (r[1] - base) // 1_000_000) for r in le.corrected_periods(changes).collect()}


def test_late_records_retract_and_replace(spark):
    changes = run(spark, [("g", 10, 20, 2.0, None, None), ("g", 20, 301, 4.0, None, None), ("g", 30, 900, 6.0, None, None), ("g", 40, 3000, 8.0, None, None)])
    rows = [(r["version"], r["change"], r["n"], float(r["total"])) for r in changes.orderBy("version", "change").collect()]
    assert rows == [(0, 1, 1, 2.0), (1, -1, 1, 2.0), (1, 1, 2, 6.0), (10, -1, 2, 6.0), (10, 1, 3, 12.0)]  # the fourth came after the cut-off
    state = le.consolidate(changes).collect()[0]
    assert (state["n"], float(state["total"]), float(state["low"]), float(state["high"]), state["versions"]) == (3, 12.0, 2.0, 6.0, 3)


def test_bounds_of_lateness(spark):
    changes = run(spark, [("a", 0, 300, 1.0, None, None), ("b", 0, 300.000001, 1.0, None, None), ("c", 0, 2100, 1.0, None, None), ("d", 0, 2100.000001, 1.0, None, None)])
    assert found(changes) == {("b", 0), ("c", 0)}


def test_arrival_from_pages_nulls_and_repeats(spark):
    ticks = [("g", 0, None, None, "ACQ-1 ", 3), ("g", 0, None, None, "ACQ-1 ", 3), ("h", 0, None, 1.0, "x", 1), (None, 400, 1000, float("nan"), None, None), ("k", None, 400, 1.0, None, None), ("m", 0, None, 1.0, None, 3), ("n", 0, None, 1.0, "acq-1", None)]
    changes = run(spark, ticks, [("acq-1", 3, 400), (" Acq-1", 3, 350), ("acq-1", 3, None), (None, 3, 1)])
    assert found(changes) == {("g", 0), (None, 300)}
    g = changes.where("generation = 'g'").collect()
    assert [(r["n"], r["n_values"], r["total"]) for r in g] == [(2, 0, None)]


def test_values_of_any_size(spark):
    big = [("g", 10, 20, 2.5e18, None, None), ("g", 20, 400, 1e300, None, None), ("g", 30, 50, 1.5, None, None), ("g", 40, 60, float("inf"), None, None), ("g", 50, 70, -3e18, None, None)]
    s = le.consolidate(run(spark, big)).collect()[0]
    assert (s["n"], s["n_values"], float(s["total"]), s["total_large"], s["low"], s["high"]) == (5, 4, 1.5, 1e300, -3e18, 1e300)
    s = le.consolidate(run(spark, big), grain=3_600_000_000).collect()[0]
    assert (s["n_values"], s["total_large"], s["high"]) == (4, 1e300, 1e300)


def test_empty(spark):
    assert run(spark, []).count() == 0 and le.consolidate(run(spark, []), grain=3_600_000_000).count() == 0


def test_downstream_sums_match_brute_force(spark):
    rnd = random.Random(1)
    ticks = [(rnd.choice("ab"), e := rnd.randrange(7200), e + rnd.choice([0, 10, 400, 1500, 5000]), float(rnd.randrange(100)), None, None) for _ in range(300)]
    got = {(r[0], r[1] - int(T0.timestamp() * 1e6)): (r["n"], float(r["total"])) for r in le.consolidate(run(spark, ticks), grain=3_600_000_000).collect()}
    want = {}
    for g, e, k, p, *_ in ticks:
        if k <= e // 300 * 300 + 2100:
            n, s = want.get((g, e // 3600 * 3_600_000_000), (0, 0.0))
            want[g, e // 3600 * 3_600_000_000] = (n + 1, s + p)
    assert got == want
