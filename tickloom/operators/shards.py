"""Ordered work on entities of any size: shards, neighbours across shard borders, checked broadcasts.

An entity (a source, a generation) may hold a third of all rows, so no operator orders a whole entity in one task. Rows are
cut into ordered shards, each shard is worked on alone, and only its border rows meet those of the neighbouring shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_width

#: Rows and bytes of a lookup table up to which it is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Copies of each lookup row beyond that; rows of one hot key are spread over as many tasks.
LOOKUP_SALTS = 16


def fits(small: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether `small` has at most so many rows and bytes (fixed columns as 8 bytes each, texts and nested columns by their length)."""
    kinds = {c: t for c, t in small.dtypes}
    nested = [c for c, t in kinds.items() if t.startswith(("array", "map", "struct"))]
    size = F.lit(8 * len(kinds))
    for c in (F.col(f"`{c}`") for c, t in kinds.items() if t in ("string", "binary")):
        size = size + F.coalesce(F.octet_length(c), F.lit(0))
    if nested:
        size = size + F.octet_length(F.to_json(F.struct(*[f"`{c}`" for c in nested])))
    n, width = small.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(size)).first()
    return n <= max_rows and (width or 0) <= max_bytes


def lookup_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "left", max_rows: int = BROADCAST_ROWS, salts: int = LOOKUP_SALTS, small_fits: bool | None = None, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join (left, inner, left_semi or left_anti) of `big` with `small`. `small` is measured (see `fits`, or told by `small_fits`): if it is small it is
    broadcast, else both sides are shuffled with the hot keys of `big` spread over `salts` copies of each row of `small`. A null key finds nothing."""
    if fits(small, max_rows, max_bytes) if small_fits is None else small_fits:
        return big.join(F.broadcast(small), on, how)
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*([on] if isinstance(on, str) else on), "_salt"], how).drop("_salt")


def ordered_shards(df: DataFrame, keys: Sequence[str], order: Sequence[str], shard: str = "_shard", shards: int | None = None) -> DataFrame:
    """`df` with a shard number: shards are ranges of (keys, order) of about equal row counts, so an entity with a third of
    the rows spans a third of the shards, and rows tied in `order` up to its last column can still be parted. The ranges are
    sampled anew by every plan, so the result may be read once only in a plan (write it to read it twice)."""
    n = shards or shuffle_width(df.sparkSession)
    return df.repartitionByRange(n, *keys, *order).withColumn(shard, F.spark_partition_id())


def sharded_neighbours(df: DataFrame, keys: Sequence[str], shard: str, order: Sequence[str], value: Column, before: int, after: int, prefix: str = "_n") -> DataFrame:
    """Adds `value` of the 1..`before` rows before and 1..`after` rows after each row of its entity, in columns prefix-1, prefix+1, ...

    `shard` grows with `order`. Neighbours are looked up within the shard; rows too near its border look among the border
    rows of all shards of the entity, which are a few per shard. `value` must not be null in itself.
    """
    k = max(before, after)
    inner = Window.partitionBy(*keys, shard).orderBy(*order)
    names = [(f"{prefix}{i:+d}", i) for i in [*range(-before, 0), *range(1, after + 1)]]
    df = df.withColumn("_value", value)
    df = df.withColumns({c: F.lag("_value", -i).over(inner) for c, i in names} | {"_border": F.lag(F.lit(1), k).over(inner).isNull() | F.lead(F.lit(1), k).over(inner).isNull()})
    outer = Window.partitionBy(*keys, F.when(~F.col("_border"), F.col(shard))).orderBy(*order)
    return df.withColumns({c: F.coalesce(F.col(c), F.lag("_value", -i).over(outer)) for c, i in names}).drop("_value", "_border")


def running(df: DataFrame, keys: Sequence[str], shard: str, order: Sequence[str], amounts: dict[str, Column], how: str = "sum") -> DataFrame:
    """Adds for each name in `amounts` the `sum` or `max` of its column over the rows before each row of its entity (`keys`; null is a key of its own).

    `shard` grows with `order` and must be the same whenever it is computed (a function of the row, not a sampled range), for the
    rows are read twice. It runs within shards; what lies before a shard comes from the totals per shard, of which an
    entity has few. Before the first row a sum is 0 and a maximum null.
    """
    f = {"sum": F.sum, "max": F.max}[how]
    zero = lambda c: F.coalesce(c, F.lit(0)) if how == "sum" else c
    both = lambda a, b: zero(a) + zero(b) if how == "sum" else F.greatest(a, b)
    at = {name: f"_{k}" for k, name in enumerate(amounts)}
    by = Window.partitionBy(*keys, shard).orderBy(*order)
    df = df.withColumns({f"_amount{i}": amounts[n] for n, i in at.items()})
    df = df.withColumns({f"_here{i}": f(f"_amount{i}").over(by.rowsBetween(Window.unboundedPreceding, -1)) for i in at.values()} | {"_tail": F.lead(F.lit(1)).over(by).isNull()})
    # The last row of each shard knows the shard's totals; those rows alone meet per entity.
    totals = df.where("_tail").select(*keys, shard, *[both(F.col(f"_here{i}"), F.col(f"_amount{i}")).alias(f"_all{i}") for i in at.values()])
    before = Window.partitionBy(*keys).orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(shard).alias("_of"), *[F.col(k).alias(f"_of_{k}") for k in keys], *[f(f"_all{i}").over(before).alias(f"_before{i}") for i in at.values()])
    on = F.col(shard) == F.col("_of")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    joined = df.drop("_tail", *[f"_amount{i}" for i in at.values()]).join(totals, on, "left").drop("_of", *[f"_of_{k}" for k in keys])
    return joined.withColumns({n: both(F.col(f"_before{i}"), F.col(f"_here{i}")) for n, i in at.items()}).drop(*[f"{p}{i}" for i in at.values() for p in ("_before", "_here")])
