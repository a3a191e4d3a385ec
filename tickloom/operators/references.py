"""References to rows that are missing, retired or came later.

Keys are cut into ranges. Each range's parents form one row of sorted arrays; references of the range follow in Arrow
batches and are looked up by binary search, a batch at a time. A range holds at most RANGE_WIDTH integer keys; text keys
are ranged by their 64-bit hash and compared as text on a hit. Ranges with very many references are spread over several
tasks, each with a copy of the range's parents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .shards import lookup_join

#: Integer keys in a range, and about as many text keys.
RANGE_WIDTH = 65_536
#: References of one range that a task takes; a range with more is spread.
SPREAD_ROWS = 500_000

MISSES = "ref_table string, ref_id bigint, ref_field string, ref_key string, reason string, day_micros bigint"


@dataclass(frozen=True)
class Parents:
    """Rows that can be pointed to: `key` (integer or text), the instants (micros) since when and until when they exist, null: always."""

    name: str
    rows: DataFrame
    key: str
    since: Column | None = None
    until: Column | None = None


@dataclass(frozen=True)
class References:
    """Rows of `table` that point into `parents` by each of `fields` (an array column points by each element)."""

    table: str
    rows: DataFrame
    id: str
    at: str
    fields: tuple[tuple[str, str], ...]


def _is_text(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("string", "varchar", "char")


def _micros(c: Column | None) -> Column:
    return F.lit(None).cast("bigint") if c is None else F.unix_micros(c)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("ref_table", pa.string()), ("ref_id", pa.int64()), ("ref_field", pa.string()), ("ref_key", pa.string()), ("reason", pa.string()), ("day_micros", pa.int64())])
    at, keys, since, until, texts = None, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), None
    lowest, highest = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    for b in batches:
        space, rng, salt = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("_space", "_range", "_salt"))
        kind = b.column(b.schema.get_field_index("_kind")).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(space) != 0) | (np.diff(rng) != 0) | (np.diff(salt) != 0) | (np.diff(kind) != 0) | (kind[1:] == 0)) + 1
        ends = [0, *cuts.tolist(), len(kind)]
        for lo, hi in zip(ends, ends[1:]):
            here = (space[lo], rng[lo], salt[lo]) if hi > lo else None
            if here is None:
                continue
            if kind[lo] == 0:
                p = b.column(b.schema.get_field_index("_parents"))[lo].values
                at, keys = here, p.field("key").to_numpy(zero_copy_only=False)
                since = p.field("since").fill_null(lowest).to_numpy(zero_copy_only=False)
                until = p.field("until").fill_null(highest).to_numpy(zero_copy_only=False)
                texts = p.field("text").to_numpy(zero_copy_only=False) if p.field("text").null_count < len(p) else None
                continue
            part = b.slice(lo, hi - lo)
            want = part.column(part.schema.get_field_index("_key")).to_numpy(zero_copy_only=False)
            when = part.column(part.schema.get_field_index("_at"))
            when = (when.fill_null(lowest).to_numpy(zero_copy_only=False), when.is_null().to_numpy(zero_copy_only=False))
            n = len(keys) if at == here else 0
            first = np.searchsorted(keys, want, "left") if n else np.zeros(len(want), np.int64)
            last = np.searchsorted(keys, want, "right") if n else first
            found, live, came = np.zeros(len(want), bool), np.zeros(len(want), bool), np.zeros(len(want), bool)
            names = part.column(part.schema.get_field_index("ref_key")).to_numpy(zero_copy_only=False) if texts is not None else None
            width = int((last - first).max()) if len(want) else 0
            for step in range(width):  # equal keys: versions of one parent, or texts of one hash
                i = np.minimum(first + step, max(n - 1, 0))
                hit = first + step < last
                if names is not None:
                    hit = hit & (texts[i] == names)
                known = when[1]
                here_now = known | (since[i] <= when[0])
                found |= hit
                came |= hit & here_now
                live |= hit & here_now & (known | (until[i] > when[0]))
            miss = ~live
            if miss.any():
                reason = np.where(~found, "missing", np.where(~came, "later", "retired"))[miss]
                got = part.filter(pa.array(miss))
                yield pa.RecordBatch.from_arrays([*(got.column(got.schema.get_field_index(c)).cast(schema.field(c).type) for c in ("ref_table", "ref_id", "ref_field", "ref_key")), pa.array(reason.tolist(), pa.string()), got.column(got.schema.get_field_index("_at"))], schema=schema)


def orphans(parents: list[Parents], references: list[References], range_width: int = RANGE_WIDTH, spread_rows: int = SPREAD_ROWS) -> DataFrame:
    """Distinct references without a live target: ref_table, ref_id, ref_field, ref_key (as text), reason, day (of the pointing row, null if unknown).

    reason: `missing` (no such row), `later` (it came after the pointing row was written) or `retired` (it was retired at or before).
    Null references point nowhere and aren't looked at; with an unknown instant on either side only existence counts; a
    repeated parent is live if any of its rows is. Empty tables work: without parents every reference is missing.
    """
    spaces = {p.name: k for k, p in enumerate(parents)}
    kinds = {p.name: _is_text(p.rows, p.key) for p in parents}
    ranges = {p.name: max(1, 1 << max(0, (p.rows.count() // range_width).bit_length())) if kinds[p.name] else 0 for p in parents}

    def ranged(name: str, key: Column) -> tuple[Column, Column]:
        if kinds[name]:
            h = F.xxhash64(key.cast("string"))
            return h, F.pmod(F.shiftright(h, 20), F.lit(ranges[name]))
        k = key.cast("bigint")
        return k, F.floor(k / F.lit(range_width)).cast("bigint") if range_width & (range_width - 1) else F.shiftright(k, range_width.bit_length() - 1)

    def parent(p: Parents) -> DataFrame:
        k, r = ranged(p.name, F.col("_k"))
        rows = p.rows.select(F.col(p.key).alias("_k"), _micros(p.since).alias("since"), _micros(p.until).alias("until")).where("_k is not null")
        if p.since is not None or p.until is not None:
            # Of the versions of a key only the earliest counts among those that end together, however many there are.
            rows = rows.groupBy("_k", "until").agg(F.min(F.coalesce("since", F.lit(-(1 << 63)))).alias("since"))
        text = F.col("_k").cast("string") if kinds[p.name] else F.lit(None).cast("string")
        return rows.select(F.lit(spaces[p.name]).alias("_space"), r.alias("_range"), F.struct(k.alias("key"), "since", "until", text.alias("text")).alias("_p"))

    def reference(r: References) -> DataFrame:
        out = []
        base = r.rows.select(F.col(r.id).cast("bigint").alias("ref_id"), F.unix_micros(r.at).alias("_at"), *[f for f, _ in r.fields])
        pointers = []
        for field, name in r.fields:
            many = r.rows.schema[field].dataType.typeName() == "array"
            if many or kinds[name]:
                key = F.explode(field) if many else F.col(field)
                rows = base.select("ref_id", "_at", key.alias("_v")).where("_v is not null")
                k, g = ranged(name, F.col("_v"))
                out.append(rows.select(F.lit(spaces[name]).alias("_space"), g.alias("_range"), k.alias("_key"), F.lit(r.table).alias("ref_table"), "ref_id", F.lit(field).alias("ref_field"), F.col("_v").cast("string").alias("ref_key"), "_at"))
            else:  # all integer fields in one scan
                k, g = ranged(name, F.col(field))
                pointers.append(F.struct(F.lit(spaces[name]).alias("s"), g.alias("g"), k.alias("k"), F.lit(field).alias("f")))
        if pointers:
            rows = base.select("ref_id", "_at", F.explode(F.array(*pointers)).alias("_x")).where("_x.k is not null")
            out.append(rows.select(F.col("_x.s").alias("_space"), F.col("_x.g").alias("_range"), F.col("_x.k").alias("_key"), F.lit(r.table).alias("ref_table"), "ref_id", F.col("_x.f").alias("ref_field"), F.col("_x.k").cast("string").alias("ref_key"), "_at"))
        return reduce(DataFrame.unionByName, out)

    refs = reduce(DataFrame.unionByName, [reference(r) for r in references])
    busy = refs.groupBy("_space", "_range").count().where(F.col("count") > spread_rows).select("_space", "_range", F.ceil(F.col("count") / spread_rows).cast("int").alias("_tasks"))
    busy = written(busy, "busy")
    held = reduce(DataFrame.unionByName, [parent(p) for p in parents]).groupBy("_space", "_range").agg(F.sort_array(F.collect_set("_p")).alias("_parents"))
    held = lookup_join(held, busy, ["_space", "_range"]).select("_space", "_range", F.explode(F.sequence(F.lit(0), F.coalesce("_tasks", F.lit(1)) - 1)).alias("_salt"), F.lit(0).alias("_kind"), "_parents")
    refs = lookup_join(refs, busy, ["_space", "_range"]).withColumn("_salt", F.pmod(F.xxhash64("ref_id", "ref_field"), F.coalesce("_tasks", F.lit(1))).cast("int")).drop("_tasks").withColumn("_kind", F.lit(1))
    both = held.unionByName(refs, allowMissingColumns=True).repartition("_space", "_range", "_salt").sortWithinPartitions("_space", "_range", "_salt", "_kind")
    missed = both.mapInArrow(_probe, MISSES).distinct()
    return missed.select("ref_table", "ref_id", "ref_field", "ref_key", "reason", F.to_date(F.timestamp_micros("day_micros")).alias("day"))


def orphan_report(missed: DataFrame) -> DataFrame:
    """Orphans per table, day and reason: ref_table, day, reason, n_references, n_rows (pointing rows)."""
    return missed.groupBy("ref_table", "day", "reason").agg(F.count(F.lit(1)).alias("n_references"), F.count_distinct("ref_id").alias("n_rows"))
