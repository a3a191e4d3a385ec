import pytest
from pyspark.sql import functions as F

from tickloom.operators import features, stream
from tickloom.operators.stream import Checks
from tickloom.plans import catalog
from tickloom.sources import table


def test_every_catalogued_output_is_computed(spark, data):
    moved = stream.moves(stream.accepted(table(spark, data, "ticks"), table(spark, data, "generations")))
    x = features.features(stream.candles(moved, moved=moved), features.tick_path(moved))
    names = [o.name for o in catalog.catalog()]
    assert len(names) == len(set(names)) and set(names) <= set(x.columns)
    assert {c for c in x.columns if not c.startswith("_")} - set(names) - {"generation"} == set(stream.FLAGS) - {"complete"} | {"observations", "duplicates", "gap_before_micros", "max_gap_inside_micros", "missing_buckets_before", "frozen_observations", "frozen_micros", "max_jump_bps", "max_delayed_jump_bps", "max_reopen_jump_bps", "max_abs_move_bps", "max_true_move_bps", "max_reopen_move_bps"}
    assert catalog.resolve().apply(x).columns == ["generation", *catalog.resolve().outputs]


def test_resolving():
    bars = catalog.resolve(ticks=False)
    assert "tick_volume" not in bars.outputs and dict(bars.excluded)["complete"] == "needs ticks"
    assert dict(catalog.resolve(checks=Checks(jump_bps=None)).excluded)["has_true_tick_jump"] == "needs jump"
    with pytest.raises(ValueError, match="no_such: unknown output"):
        catalog.resolve(["body_bps", "no_such"])
    plan = catalog.resolve(["ema20", "body_bps"])
    assert plan.outputs == ("body_bps", "ema20") and catalog.load(plan.document()) == plan and plan.identity() != bars.identity()


def test_conditions(spark):
    df = spark.createDataFrame([("up", 1.0, True), ("unknown", -1.0, None), (None, None, False)], "s string, x double, b boolean")
    got = lambda c: [r[0] for r in df.select(c).collect()]
    assert got(catalog.holds("s", "eq", "up")) == [True, False, False] and got(catalog.holds("s", "ne", "up")) == [False, False, False]
    assert got(catalog.holds("x", "lt", 0.0)) == [False, True, False] and got(catalog.holds("b", "ne", True)) == [False, False, True]
    assert df.select(F.lit(1)).count() == 3
