import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.operators.redelivery import SeenRanges, deliveries

SCHEMA = "delivery_id bigint, acquisition_id string, ordinal bigint, payload_sha256 string, digest string, copy int"


def copies(spark, rows, **kw):
    return {r["delivery_id"] for r in deliveries(spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA), **kw).where("copy").collect()}


def brute(rows):
    canon = lambda a, o, d: (None if a is None else a.strip().lower(), o, None if d is None else d.strip().lower().removeprefix("sha256:"))
    first = {}
    for i, *k in sorted(rows):
        first.setdefault(canon(*k), i)
    return {i for i, *k in rows if first[canon(*k)] != i}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-20, 60), min_size=1, max_size=15), max_size=8))
def test_ranges_are_sets(batches):
    seen, plain = SeenRanges(), set()
    for b in batches:
        fresh = np.unique(np.array(b, np.int64))
        covered = seen.covers(fresh)
        assert covered.tolist() == [x in plain for x in fresh.tolist()]
        if (~covered).any():
            seen.add(fresh[~covered])
        plain |= set(b)
        assert {x for a, z in zip(seen.starts, seen.stops) for x in range(a, z)} == plain
        assert (seen.starts[1:] > seen.stops[:-1]).all()


def test_against_brute_force(spark):
    rnd = random.Random(8)
    spell = lambda a: rnd.choice([a, a.upper(), f" {a}\t"])
    ids = rnd.sample(range(5000), 900)
    rows = [(i, rnd.choice([None, "", spell("acq-hot"), spell("acq-hot"), spell(f"p{rnd.randrange(5)}")]), rnd.choice([None, -1, *range(30)]), rnd.choice([None, "aa", "AA", "sha256:aa", "bb"])) for i in ids]
    for block in (4096, 8):
        assert copies(spark, rows, block=block) == brute(rows)


def test_same_number_other_digest_is_no_copy(spark):
    rows = [(1, "p", 5, "a"), (2, "p", 5, "b"), (3, "P", 5, "SHA256:A"), (4, "p", 5, "B"), (5, "p", 6, "a")]
    assert copies(spark, rows) == {3, 4}


def test_a_group_of_copies_over_many_splits(spark):
    rows = [(i, "p", 1, "a") for i in range(2000)] + [(5000 + i, "p", i + 2, "a") for i in range(200)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA).repartition(8)
    out = deliveries(df)
    assert out.count() == len(rows) and {r[0] for r in out.where("not copy").select("delivery_id").collect()} == {0, *range(5000, 5200)}


def test_null_delivery_ids_come_first(spark):
    rows = [(5, "p", 1, "a"), (None, "p", 1, "a"), (7, "p", None, "b"), (None, "q", 2, None), (3, "q", 2, None)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA)
    for parts in (1, 5):
        got = sorted(((r["delivery_id"] or 0, r["producer"], r["copy"]) for r in deliveries(df.repartition(parts)).collect()))
        assert got == [(0, "p", False), (0, "q", False), (3, "q", True), (5, "p", True), (7, "p", False)]


def test_small_batches_and_blocks_change_nothing(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["hot", "HOT ", "p"]), rnd.choice([None, rnd.randrange(40)]), rnd.choice([None, "a", "b"])) for i in rnd.sample(range(900), 500)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert copies(spark, rows, block=5) == copies(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_empty(spark):
    assert copies(spark, []) == set()
