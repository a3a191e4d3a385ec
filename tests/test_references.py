import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tickloom.operators.references import Parents, References, orphan_report, orphans

T0 = datetime(2020, 1, 1, tzinfo=timezone.utc)


def at(d):
    return None if d is None else T0 + timedelta(days=d)


def check(spark, parents, refs, **kw):
    p = spark.createDataFrame([(k, at(s), at(u), "x") for k, s, u in parents], "id bigint, since timestamp, until timestamp, ref_key string")
    r = spark.createDataFrame([(i, at(w), k) for i, w, k in refs], "rid bigint, at timestamp, to bigint")
    return orphans([Parents("p", p, "id", F.col("since"), F.col("until"))], [References("r", r, "rid", "at", (("to", "p"),))], **kw)


def test_reasons(spark):
    rows = check(spark, [(1, 0, None), (2, 5, None), (3, 0, 3), (4, None, None), (1, 9, None)], [(10, 1, 1), (11, 1, 2), (12, 3, 3), (13, 1, 4), (14, 1, 99), (15, 1, None), (16, None, 2), (17, None, 98), (18, 2, 3), (18, 2, 3)])
    assert {(r["ref_id"], r["ref_key"], r["reason"]) for r in rows.collect()} == {(11, "2", "later"), (12, "3", "retired"), (14, "99", "missing"), (17, "98", "missing")}


@pytest.mark.parametrize("spread", [500_000, 3])
def test_against_brute_force(spark, spread):
    rnd = random.Random(5)
    parents = [(rnd.randrange(-300, 300), rnd.choice([None, *range(9)]), rnd.choice([None, *range(9)])) for _ in range(200)]
    refs = [(i, rnd.choice([None, *range(9)]), rnd.choice([7, 7, 7, None, rnd.randrange(-320, 320)])) for i in range(400)]
    got = check(spark, parents, refs, range_width=64, spread_rows=spread).collect()
    want = {(i, str(k)) for i, w, k in refs if k is not None and not any(p == k and (w is None or ((s is None or s <= w) and (u is None or u > w))) for p, s, u in parents)}
    assert {(r["ref_id"], r["ref_key"]) for r in got} == want and len(got) == len(want)


def test_many_versions_of_one_parent(spark):
    parents = [(7, k % 40, None if k % 3 else 50) for k in range(600)] + [(8, 5, 6)] * 300
    assert {(r["ref_id"], r["reason"]) for r in check(spark, parents, [(1, 0, 7), (2, 39, 7), (3, 5, 8), (4, 6, 8), (5, 4, 8)]).collect()} == {(4, "retired"), (5, "later")}


def test_text_keys_in_arrays_and_report(spark):
    p = spark.createDataFrame([(f"k{i}", at(0)) for i in range(50)], "k string, since timestamp")
    r = spark.createDataFrame([(1, at(1), ["k1", "zz", "zz", None, ""]), (2, at(1), None), (3, at(1), [])], "rid bigint, at timestamp, tos array<string>")
    rows = orphans([Parents("p", p, "k", F.col("since"))], [References("r", r, "rid", "at", (("tos", "p"),))], range_width=4)
    assert {(x["ref_id"], x["ref_key"]) for x in rows.collect()} == {(1, "zz"), (1, "")}
    assert [(x["n_references"], x["n_rows"]) for x in orphan_report(rows).collect()] == [(2, 1)]


def test_empty_tables(spark):
    assert check(spark, [], []).count() == 0 and check(spark, [(1, 0, None)], []).count() == 0
    assert [r["reason"] for r in check(spark, [], [(1, 1, 5)]).collect()] == ["missing"]
