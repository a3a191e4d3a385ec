import itertools
import random

from tickloom.functions import combinatorics as cb
from tickloom.operators import capacity
from tickloom.operators import stream as st
from tickloom.operators.search import upper_tail
from tickloom.sources import verify


def test_numbering():
    members = [(list(c), k) for n in (1, 2, 3) for c in itertools.combinations(range(6), n) for k in range(2)]
    assert cb.family_size(6, 1, 3, 2) == len(members)
    for i, (chosen, k) in enumerate(members):
        assert cb.member_rank(6, 1, chosen, k, 2) == i and cb.member_at(6, 1, 3, i, 2) == (chosen, k)
    assert cb.logic_identity(["b", "a", "b"]) == cb.logic_identity(["a", "b"]) != cb.logic_identity(["a"])


def test_required_wins():
    for n, p, limit in ((10, 0.5, 0.05), (40, 0.52, 0.01), (3, 0.9, 0.01)):
        w = cb.required_wins(n, p, limit)
        assert (w == n + 1 or upper_tail(w, n - w, p) <= limit) and (w == 1 or upper_tail(w - 1, n - w + 1, p) > limit)
    assert cb.break_even(92, 100) == 100 / 192


def test_capacity(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice("ab"), k, e := rnd.randrange(60), e + rnd.randrange(25), rnd.choice([None, "x", "y"])) for k in range(150)] + [(None, 900, 1, 2, "x"), ("a", 901, None, 2, "x")]
    got = {r["row"]: r["kept"] for r in capacity.admitted(spark.createDataFrame(rows, "portfolio string, row bigint, entry bigint, due bigint, kind string"), 4, 2).collect()}
    for p in "ab":
        open_ = []
        for _, k, e, due, kind in sorted((r for r in rows if r[0] == p and r[2] is not None), key=lambda r: (r[2], r[1])):
            open_ = [x for x in open_ if x[0] > e]
            take = len(open_) < 4 and sum(x[1] == (kind or "") for x in open_) < 2 and due > e
            assert got[k] == take
            if take:
                open_.append((due, kind or ""))
    assert not {900, 901} & set(got)


def test_scores_and_differences(spark):
    t = spark.createDataFrame([("c", 1, 0, 10, 5), ("c", 2, 5, 15, -7), ("c", 3, 10, 20, -3), ("c", 4, 20, 30, 0)], "candidate string, row bigint, entry bigint, release bigint, value bigint")
    s = capacity.scores(t).collect()[0]
    assert (s["wins"], s["losses"], s["ties"], s["n"], s["max_drawdown"], s["loss_streak"]) == (1, 1, 1, 3, 3, 1)
    a, b = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "i int, s string"), spark.createDataFrame([("x", 1), (None, 2), ("z", 3)], "s string, i int")
    assert sorted((r["i"], r["side"]) for r in verify.differences(a, b).collect()) == [(1, "left"), (3, "right")]
    assert verify.digest(a).collect() == verify.digest(a.orderBy("s")).collect() and verify.digest(a.limit(0)).collect()[0]["n_rows"] == 0


def test_divisors_of_any_size(spark):
    """Long chains of Euclid's steps, many rows, a null generation and no moves."""
    a, b = 4660046610375530309, 2880067194370816120  # consecutive members of Fibonacci's sequence, the longest chain 64 bits hold
    rows = [("g", 0, a), ("g", 0, b)] + [("h", 5, 5 + 6 * k) for k in range(1, 3000)] + [(None, 1, 4), ("n", None, 3), ("n", 3, 3)]
    df = spark.createDataFrame(rows, "generation string, before bigint, units bigint").repartition(6)
    got = {r["generation"]: (r["n_moves"], r["step_units"]) for r in st.price_facts(df).collect()}
    assert got == {"g": (2, 1), "h": (2999, 6), None: (1, 3), "n": (0, None)}


def test_written_tables_are_dropped(spark, tmp_path):
    from pathlib import Path

    from tickloom import session

    written = session.written(spark.range(3), "dropped")
    at = session._WRITTEN[-1]
    assert written.count() == 3 and Path(at.removeprefix("file://")).exists()
    keep, session._WRITTEN[:] = session._WRITTEN[:-1], [at]
    session.drop_written(spark)
    assert not Path(at.removeprefix("file://")).exists() and session._WRITTEN == []
    session._WRITTEN.extend(keep)
