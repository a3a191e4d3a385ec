"""Messages delivered more than once: exactly one delivery of each is kept.

A producer numbers its messages, so what has been seen of it is a set of disjoint number ranges. A delivery whose number
no range covers is the first of its message and is accepted at once, the range grows and merges with its neighbours. Along the ranges lie the
digests that came first, so a covered number is looked up by its place in its range; other digests under one number, and deliveries
without a number, are held by their exact key.

The pass runs first within each Arrow batch (which shrinks a group of copies to one row a batch before the shuffle), then once per
producer and block of numbers over what is left. State is bounded by the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import digest, identifier

#: Numbers in a block; a producer's blocks are worked on in parallel.
BLOCK = 4_096

_FIELDS = "delivery_id bigint, producer string, number bigint, block bigint, digest string, copy boolean"


class SeenRanges:
    """Disjoint, sorted, non-touching ranges [start, stop) of the numbers seen of one producer."""

    def __init__(self) -> None:
        self.starts, self.stops = np.empty(0, np.int64), np.empty(0, np.int64)

    def covers(self, numbers: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.starts, numbers, "right") - 1
        return (at >= 0) & (numbers < self.stops[np.maximum(at, 0)]) if len(self.starts) else np.zeros(len(numbers), bool)

    def places(self, numbers: np.ndarray) -> np.ndarray:
        """How many seen numbers are less than each of these, which are covered."""
        before = np.concatenate([[0], np.cumsum(self.stops - self.starts)])
        at = np.searchsorted(self.starts, numbers, "right") - 1
        return before[at] + numbers - self.starts[at]

    def numbers(self) -> np.ndarray:
        width = self.stops - self.starts
        return np.repeat(self.starts - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))

    def add(self, numbers: np.ndarray) -> None:
        """Adds sorted distinct numbers that aren't covered, merging what touches."""
        cut = np.flatnonzero(np.diff(numbers) != 1) + 1
        starts = np.concatenate([self.starts, numbers[np.concatenate([[0], cut])]])
        stops = np.concatenate([self.stops, numbers[np.concatenate([cut - 1, [len(numbers) - 1]])] + 1])
        order = np.argsort(starts, kind="stable")
        starts, stops = starts[order], stops[order]
        first = np.concatenate([[True], starts[1:] != stops[:-1]])
        self.starts, self.stops = starts[first], stops[np.concatenate([first[1:], [True]])]


class _Group:
    """What has been seen of one producer and block: ranges with the digest that came first under each number, and all other keys (number or None, digest)."""

    def __init__(self) -> None:
        self.seen, self.first, self.others = SeenRanges(), np.empty(0, object), set()

    def copies(self, number: np.ndarray, known: np.ndarray, digests: np.ndarray) -> np.ndarray:
        """For deliveries in order: is each a copy of an earlier one? `known`: has a number."""
        out = np.zeros(len(number), bool)
        at = np.flatnonzero(known)
        left = np.flatnonzero(~known)
        if len(at):
            fresh, first = np.unique(number[at], return_index=True)
            new = ~self.seen.covers(fresh)
            plain = np.zeros(len(number), bool)
            plain[at[first[new]]] = True
            if new.any():
                old, held = self.seen.numbers(), self.first
                self.seen.add(fresh[new])
                self.first = np.empty(len(old) + int(new.sum()), object)
                self.first[self.seen.places(old)] = held
                self.first[self.seen.places(fresh[new])] = digests[at[first[new]]]
            again = at[~plain[at]]
            same = np.asarray(self.first[self.seen.places(number[again])] == digests[again], bool)
            out[again[same]] = True
            left = np.sort(np.concatenate([left, again[~same]]))
        for i in left.tolist():  # without a number, or another digest than the first under it
            key = (int(number[i]) if known[i] else None, digests[i])
            out[i] = key in self.others
            self.others.add(key)
        return out


def _classified(b: pa.RecordBatch, groups: dict, ordered: bool) -> pa.RecordBatch:
    """`b` with `copy` told by what `groups` have seen. `ordered`: a group that has ended won't come again."""
    at = {c: b.schema.get_field_index(c) for c in b.schema.names}
    number, known = b.column(at["number"]).fill_null(0).to_numpy(zero_copy_only=False), b.column(at["number"]).is_valid().to_numpy(zero_copy_only=False)
    copy = b.column(at["copy"]).to_numpy(zero_copy_only=False).copy()
    digests = b.column(at["digest"]).to_numpy(zero_copy_only=False)
    names = b.column(at["producer"]).dictionary_encode()
    code, names = names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False), [*names.dictionary.to_pylist(), None]
    block = b.column(at["block"]).to_numpy(zero_copy_only=False)
    open_ = np.flatnonzero(~copy)
    order = open_ if ordered else open_[np.lexsort((block[open_], code[open_]))]
    cuts = np.flatnonzero((np.diff(code[order]) != 0) | (np.diff(block[order]) != 0)) + 1
    for rows in np.split(order, cuts) if len(order) else ():
        key = (names[code[rows[0]]], int(block[rows[0]]))
        if key not in groups:
            groups.clear()
            groups[key] = _Group()
        copy[rows] = groups[key].copies(number[rows], known[rows], digests[rows])
    return b.set_column(at["copy"], b.schema.field(at["copy"]), pa.array(copy))


def _within_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies of earlier deliveries of the same batch, whatever its order."""
    for b in batches:
        order = pc.sort_indices(b, sort_keys=[("delivery_id", "ascending")], null_placement="at_start")
        yield _classified(b.take(order), {}, False)


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies of earlier deliveries in rows ordered by producer, block and delivery."""
    groups: dict = {}
    for b in batches:
        yield _classified(b, groups, True)


def deliveries(pages: DataFrame, *, delivery: str = "delivery_id", producer: str = "acquisition_id", number: str = "ordinal", declared: str = "payload_sha256", block: int = BLOCK) -> DataFrame:
    """Every delivery with `copy`: false for the one of smallest id among those of the same message, true for all others.

    Result: delivery_id, producer, number, digest (canonical), copy. Producer and digest are compared without regard to
    case, outer blanks and an algorithm prefix. A null producer, number or digest is a value of its own: such deliveries are
    copies of each other if all three agree. Delivery ids are unique; null ones count as one id before all others.
    """
    rows = pages.select(F.col(delivery).cast("bigint").alias("delivery_id"), identifier(F.col(producer)).alias("producer"), F.col(number).cast("bigint").alias("number"), digest(F.col(declared)).alias("digest"))
    # Without a number there is no range: such deliveries are spread by digest.
    at = F.coalesce(F.floor(F.col("number") / F.lit(block)).cast("bigint"), -1 - F.pmod(F.xxhash64("digest"), F.lit(1 << 40)))
    rows = rows.select("delivery_id", "producer", "number", at.alias("block"), "digest", F.lit(False).alias("copy"))
    local = rows.mapInArrow(_within_batches, _FIELDS)
    # Copies found already only pass through; they are spread over all tasks.
    spread = F.when(F.col("copy"), F.xxhash64("delivery_id"))
    local = local.withColumn("_pass", spread).repartition("producer", "block", "_pass").drop("_pass").sortWithinPartitions("producer", "block", F.col("delivery_id").asc_nulls_first())
    return local.mapInArrow(_ordered, _FIELDS).drop("block")
