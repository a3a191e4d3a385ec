"""Sources mixed to target weights by a low-discrepancy schedule.

Shares can be met exactly as long as no source runs out, so the mixture's size is the largest at which every source stays
within its tokens times its repeats. Where a target source has no tokens, its share is spread evenly over the others: of all
shares that sum to one these have the least squared and the least maximal distance to the targets.

Each source's documents are shuffled anew for every repeat, laid end to end and cut into blocks of equally many tokens (the last one of a
source aside), so a document that crosses a border has a piece in each block. Slot i of the schedule goes to the source in whose stretch of
the cumulative weights frac(i * golden ratio) falls, so every prefix of the schedule is close to the weights; the k-th slot of a source takes its k-th block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shards import lookup_join, running
from ..session import written
from .tokens import VOCABULARY, n_tokens

#: Fixed value: the golden ratio's fraction, and what 2^20 steps of it leave of a turn.
_GOLDEN = Decimal("0.618033988749894848204586834365638117720309")
GOLDEN, TURN = float(_GOLDEN), float(_GOLDEN * (1 << 20) % 1)
#: Tokens in a block.
BLOCK_TOKENS = 8_192
#: Documents of a source that are shuffled together, and slots that are ranked together.
SHUFFLED, SLOTS = 65_536, 65_536
#: Parts of the unit interval in which a slot looks for its source.
CELLS = 4_096


@dataclass(frozen=True)
class Plan:
    """What each source gives: target, share aimed at, tokens there are, tokens aimed at, repeats allowed."""

    source: str
    target: float
    share: float
    documents: int
    tokens: int
    quota: int
    repeats: int


def plan(targets: list[tuple[str, float, int]], stocks: dict[str, tuple[int, int]]) -> list[Plan]:
    """targets: (source, share, most repeats); stocks: documents and tokens by source. A target of 0, or without tokens or repeats, gives nothing."""
    live = [t for t in targets if t[1] > 0 and t[2] > 0 and stocks.get(t[0], (0, 0))[1] > 0]
    missing = 1.0 - sum(t[1] for t in live)
    share = {t[0]: t[1] + missing / len(live) for t in live}
    while live and min(share.values()) < 0:  # targets that sum to more than one: the least go to zero
        live = [t for t in live if share[t[0]] > 0]
        missing = 1.0 - sum(t[1] for t in live)
        share = {t[0]: t[1] + missing / len(live) for t in live}
    size = min((stocks[s][1] * r / share[s] for s, _, r in live), default=0)
    return [Plan(s, w, share.get(s, 0.0), *stocks.get(s, (0, 0)), round(share.get(s, 0.0) * size), r) for s, w, r in targets]


def counted(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens of the documents of target sources, written once. Null sources belong to no target; a null id is an id."""
    wanted = lookup_join(documents.select("doc_id", "source", "text"), targets.select("source").dropna().distinct(), "source", "left_semi")
    return written(wanted.select("doc_id", "source", n_tokens(F.col("text"), vocabulary).alias("n_tokens")), "tokens")


def planned(tokens: DataFrame, targets: DataFrame) -> list[Plan]:
    """The plan of all targets, made on the driver: a row of configuration each, with the documents and tokens there are."""
    stocks = {r[0]: (r[1], r[2] or 0) for r in tokens.groupBy("source").agg(F.count(F.lit(1)), F.sum("n_tokens")).collect()}  # a row a target at most
    return plan([tuple(r) for r in targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).dropna().collect()], stocks)


def quotas(spark: SparkSession, plans: list[Plan]) -> DataFrame:
    """The plan as a table: source, target_share, share (aimed at), n_documents, stock, quota, max_repeats."""
    return spark.createDataFrame([(p.source, p.target, p.share, p.documents, p.tokens, p.quota, p.repeats) for p in plans], "source string, target_share double, share double, n_documents bigint, stock bigint, quota bigint, max_repeats int")


def golden_point(slot: Column) -> Column:
    """frac(slot * golden ratio), exact to nine digits up to 2^40 slots: the slot's upper and lower 20 bits are turned apart."""
    high, low = F.shiftright(slot, 20).cast("double"), F.pmod(slot, F.lit(1 << 20)).cast("double")
    return F.pmod(F.pmod(high * TURN, F.lit(1.0)) + F.pmod(low * GOLDEN, F.lit(1.0)), F.lit(1.0))


def mixture(tokens: DataFrame, plans: list[Plan], block_tokens: int = BLOCK_TOKENS, seed: int = 42, shuffled: int = SHUFFLED) -> DataFrame:
    """The mixture: slot (place in the schedule), source, block, doc_id, copy (from 0), from_token, n_tokens, one row per piece of a use of a document.

    No document is used more than its source's repeats, and uses differ by one at most within a source; a use is always whole. The last use of a source is the one that
    brings it nearest to its quota, so it misses the quota by half a document at most. Documents without tokens are never used.
    """
    spark = tokens.sparkSession
    live = [p for p in plans if p.quota > 0]
    wanted = spark.createDataFrame([(p.source, p.tokens, p.quota, min(p.repeats, math.ceil(p.quota / p.tokens)), max(0, math.ceil(math.log2(p.documents / shuffled)))) for p in live], "source string, _all bigint, _quota bigint, _copies int, _bits int")
    rows = lookup_join(tokens.where("n_tokens > 0"), wanted, "source", "inner").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    rows = rows.withColumn("_order", F.xxhash64(F.lit(seed), "doc_id", "copy"))
    rows = rows.withColumn("_bucket", F.when(F.col("_bits") > 0, F.expr("shiftright(_order, 64 - _bits)")).otherwise(0))
    rows = running(rows, ["source", "copy"], "_bucket", ["_order", "doc_id"], {"_start": F.col("n_tokens")})
    rows = rows.withColumn("_at", F.col("copy") * F.col("_all") + F.col("_start")).where(2 * F.col("_at") + F.col("n_tokens") <= 2 * F.col("_quota"))
    size, n = F.lit(block_tokens).cast("bigint"), F.col("n_tokens")
    cut = lambda c: F.floor(c / size).cast("bigint")
    rows = rows.withColumn("block", F.explode(F.sequence(cut(F.col("_at")), cut(F.col("_at") + n - 1))))
    since, until = F.greatest(F.lit(0), F.col("block") * size - F.col("_at")), F.least(n, (F.col("block") + 1) * size - F.col("_at"))
    rows = rows.select("source", "block", "doc_id", "copy", since.cast("bigint").alias("from_token"), (until - since).cast("bigint").alias("n_tokens"))

    total = sum(p.quota for p in live)
    slots = math.ceil(total / block_tokens) + len(live)
    slots += int(8 * len(live) * (1 + math.log2(slots + 1)))  # more than the schedule's discrepancy, so that every block finds a slot
    cells, edge = [], 0.0
    for k, p in enumerate(live):
        low, edge = edge, edge + p.quota / max(total, 1)
        high = edge if k + 1 < len(live) else 2.0
        cells += [(c, p.source, low, high) for c in range(int(low * CELLS), min(int(high * CELLS), CELLS - 1) + 1)]
    found = spark.createDataFrame(cells, "_cell bigint, source string, _low double, _high double")
    schedule = spark.range(slots if live else 0).withColumnRenamed("id", "slot").withColumn("_point", golden_point(F.col("slot")))
    schedule = lookup_join(schedule.withColumn("_cell", F.floor(F.col("_point") * CELLS)), found, "_cell", "inner").where("_point >= _low and _point < _high")
    schedule = schedule.select("slot", "source", F.floor(F.col("slot") / SLOTS).alias("_shard"))
    schedule = running(schedule, ["source"], "_shard", ["slot"], {"block": F.lit(1)}).select("source", "block", "slot")
    # Should a block find no slot all the same, it comes after the schedule.
    return rows.join(schedule, ["source", "block"], "left").withColumn("slot", F.coalesce("slot", F.lit(slots) + F.col("block"))).select("slot", "source", "block", "doc_id", "copy", "from_token", "n_tokens")


def shares(mixed: DataFrame, plans: list[Plan]) -> DataFrame:
    """Per target: source, target_share, actual_share (of the mixture's tokens), n_tokens, n_uses, n_documents used, most_uses of one document, available_tokens, max_repeats."""
    spark = mixed.sparkSession
    targets = spark.createDataFrame([(p.source, p.target, p.tokens, p.repeats) for p in plans], "source string, target_share double, available_tokens bigint, max_repeats int")
    per = mixed.groupBy("source", "copy").agg(F.sum("n_tokens").alias("t"), F.count_if(F.col("from_token") == 0).alias("u"))
    # Every copy but the last uses all documents, so the first copy counts the documents used.
    used = per.groupBy("source").agg(F.sum("t").alias("n_tokens"), F.sum("u").alias("n_uses"), F.max("u").alias("n_documents"), (F.max("copy") + 1).cast("int").alias("most_uses"))
    whole = used.agg(F.sum("n_tokens").alias("_whole"))
    out = targets.join(used, "source", "left").join(F.broadcast(whole))  # a row a target, and one row
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tokens", "n_uses", "n_documents", "most_uses")]
    return out.select("source", "target_share", F.round(F.coalesce(F.col("n_tokens") / F.col("_whole"), F.lit(0.0)), 9).alias("actual_share"), *zero, "available_tokens", "max_repeats")
