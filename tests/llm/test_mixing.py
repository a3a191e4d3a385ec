import collections
import math

import pytest

from tickloom.llm import mixing, tokens


@pytest.fixture(scope="module")
def vocabulary(tmp_path_factory):
    """A vocabulary of single bytes: as many tokens as bytes."""
    import base64

    p = tmp_path_factory.mktemp("v") / "bytes.tiktoken"
    p.write_text("".join(f"{base64.b64encode(bytes([b])).decode()} {b}\n" for b in range(256)))
    return str(p)


def frames(spark, docs, targets):
    return spark.createDataFrame([(*d, "z") for d in docs], "doc_id bigint, source string, text string, copy string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def mixed(spark, docs, targets, vocabulary, **kw):
    d, t = frames(spark, docs, targets)
    tok = mixing.counted(d, t, vocabulary)
    plans = mixing.planned(tok, t)
    return mixing.mixture(tok, plans, **kw), plans


def test_counting(spark, vocabulary):
    assert tokens.count("héllo wörld", vocabulary) == 13
    long = "ab cd " * 60_000 + "x" * 150_000
    assert tokens.count(long, vocabulary) == len(long)


def test_plan_spreads_what_is_missing_and_respects_repeats():
    plans = {p.source: p for p in mixing.plan([("a", 0.5, 1), ("b", 0.3, 4), ("gone", 0.2, 3), ("zero", 0.0, 1)], {"a": (10, 1000), "b": (2, 100)})}
    assert (plans["a"].share, plans["b"].share) == (pytest.approx(0.6), pytest.approx(0.4)) and plans["gone"].quota == plans["zero"].quota == 0
    assert plans["b"].quota == 400 and plans["a"].quota == 600  # b runs out first, at four times its tokens
    assert mixing.plan([("a", 1.0, 2)], {}) [0].quota == 0 and mixing.plan([], {}) == []


def test_shares_repeats_and_prefixes(spark, vocabulary):
    docs = [(k, "big" if k % 3 else "small", "x" * (20 + k % 31)) for k in range(900)] + [(2000, None, "xx"), (2001, "other", "xx"), (2002, "big", ""), (2003, "small", None), (None, "big", "yy")]
    m, plans = mixed(spark, docs, [("big", 0.4, 1), ("small", 0.6, 3), ("none", 0.0, 2)], vocabulary, block_tokens=256)
    rows = m.collect()
    uses = collections.Counter((r["source"], r["doc_id"]) for r in rows if r["from_token"] == 0)
    assert max(n for (s, _), n in uses.items() if s == "big") == 1 and max(n for (s, _), n in uses.items() if s == "small") <= 3
    small = [n for (s, _), n in uses.items() if s == "small"]
    assert max(small) - min(small) <= 1 and {k for _, k in uses} <= {None, *range(900)}
    total = sum(r["n_tokens"] for r in rows)
    for p in plans:
        got = sum(r["n_tokens"] for r in rows if r["source"] == p.source)
        assert abs(got - p.quota) <= 51 and abs(got / total - p.share) < 0.004
    ordered = sorted(rows, key=lambda r: r["slot"])
    half = [r for r in ordered if r["slot"] <= ordered[len(ordered) // 4]["slot"]]
    assert abs(sum(r["n_tokens"] for r in half if r["source"] == "small") / sum(r["n_tokens"] for r in half) - 0.6) < 0.1
    s = {r["source"]: r for r in mixing.shares(m, plans).collect()}
    assert s["small"]["n_documents"] == len(small) and s["small"]["most_uses"] == max(small) and s["none"]["n_tokens"] == 0
    assert math.isclose(sum(r["actual_share"] for r in s.values()), 1.0, abs_tol=1e-6)
    assert {tuple(r) for r in mixed(spark, docs, [("big", 0.4, 1), ("small", 0.6, 3), ("none", 0.0, 2)], vocabulary, block_tokens=256)[0].collect()} == {tuple(r) for r in rows}


def test_every_block_has_its_own_slot(spark, vocabulary):
    m, _ = mixed(spark, [(k, "ab"[k % 2], "x" * 50) for k in range(400)], [("a", 0.9, 2), ("b", 0.1, 2)], vocabulary, block_tokens=100)
    at = collections.defaultdict(set)
    for r in m.collect():
        at[r["slot"]].add((r["source"], r["block"]))
    assert all(len(x) == 1 for x in at.values()) and len(at) == len({y for x in at.values() for y in x})


def test_blocks_hold_equally_many_tokens_and_uses_are_whole(spark, vocabulary):
    docs = [(k, "ab"[k % 3 > 0], "x" * (1 + 7 * k % 400)) for k in range(500)]
    m, plans = mixed(spark, docs, [("a", 0.5, 3), ("b", 0.5, 2)], vocabulary, block_tokens=256, shuffled=40)
    rows = m.collect()
    size, use = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        size[r["source"], r["block"]] += r["n_tokens"]
        use[r["doc_id"], r["copy"]].append((r["block"], r["from_token"], r["n_tokens"]))
    for p in plans:
        blocks = sorted(b for s, b in size if s == p.source)
        assert blocks == list(range(len(blocks))) and all(size[p.source, b] == 256 for b in blocks[:-1]) and 0 < size[p.source, blocks[-1]] <= 256
    texts = {k: len(t) for k, _, t in docs}
    for (k, _), parts in use.items():
        at = 0
        for _, since, n in sorted(parts):
            assert since == at
            at += n
        assert at == texts[k]


def test_golden_points_stay_exact(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0,), (1,), (10**6 + 7,), (10**12 + 39,)], "slot bigint").select("slot", mixing.golden_point(F.col("slot")).alias("p")).collect()
    from decimal import Decimal, getcontext

    getcontext().prec = 50
    g = Decimal("0.61803398874989484820458683436563811772030917980576")
    assert all(abs(float((g * r["slot"]) % 1) - r["p"]) < 1e-9 for r in rows)


def test_empty(spark, vocabulary):
    m, plans = mixed(spark, [], [("a", 1.0, 1)], vocabulary)
    assert m.count() == 0 and mixing.shares(m, plans).count() == 1
    assert mixed(spark, [(1, "a", "x")], [], vocabulary)[0].count() == 0
