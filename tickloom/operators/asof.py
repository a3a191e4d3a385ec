"""As-of joins: each row meets the nearest row of another table before or after it in time.

Both tables are laid in one ordered stream and the nearest row is a running maximum over it (of (time, tie, payload), or of their
negatives looking forward). It runs in fixed time shards whose totals meet per entity, so a hot entity is no single task and no pair
of rows is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shards import running

SHARD_MICROS = 900_000_000


def asof(left: DataFrame, right: DataFrame, key: str, at: str, time: str, payload: list[str], name: str, forward: bool = False, tie: str | None = None, shard_micros: int = SHARD_MICROS) -> DataFrame:
    """`left` with the struct `name` (time, payload) of the nearest row of `right` with equal `key`: the last at or before `at`, or looking `forward` the first at or after it.

    Times are bigints. Of rows at one time the last in `tie` is taken (the first looking forward); rows with a null time are never
    found, and left rows with a null time find nothing. A null key meets null keys. Left columns named like internals (_...) must not exist.
    """
    sign = -1 if forward else 1
    own = [c for c in left.columns]
    row = F.struct(*[F.col(c) for c in own])
    order = F.lit(0).cast("bigint") if tie is None else (F.col(tie) * sign).cast("bigint")
    found = F.struct((F.col(time) * sign).alias("_o"), order.alias("_i"), *[F.col(c) for c in payload])
    r = right.where(F.col(time).isNotNull()).select(F.col(key).alias("_key"), (F.col(time) * sign).alias("_t"), F.lit(0).alias("_side"), order.alias("_i"), found.alias("_found"), F.lit(None).cast(left.select(row.alias("x")).schema["x"].dataType).alias("_row"))
    l = left.select(F.col(key).alias("_key"), (F.col(at) * sign).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_i"), F.lit(None).cast(r.schema["_found"].dataType).alias("_found"), row.alias("_row"))
    both = r.unionByName(l).withColumn("_shard", F.floor(F.coalesce("_t", F.lit(-(1 << 62))) / F.lit(shard_micros)))
    both = running(both, ["_key"], "_shard", ["_t", "_side", "_i"], {"_near": F.col("_found")}, "max").where("_side = 1")
    near = F.when(F.col("_row").getField(at).isNotNull() & F.col("_near").isNotNull(), F.struct((F.col("_near._o") * sign).alias(time), *[F.col(f"_near.{c}").alias(c) for c in payload]))
    return both.select("_row.*", near.alias(name))


def latest_known(base: DataFrame, other: DataFrame, key: str, known: str, other_known: str, base_close: str, other_close: str, payload: list[str], name: str) -> DataFrame:
    """The row of `other` that was latest known when each base row was known, kept only if it closes at or before the base row.

    An older row that would qualify is never looked for: the newest known one decides.
    """
    x = asof(base, other, key, known, other_known, [other_close, *payload] if other_close not in payload else payload, name)
    return x.withColumn(name, F.when(F.col(f"{name}.{other_close}") <= F.col(base_close), F.col(name)))


def at_most(amount: Column, age: Column, limit: int) -> Column:
    """`amount` where its age is at most `limit`, else null."""
    return F.when(age <= limit, amount)
