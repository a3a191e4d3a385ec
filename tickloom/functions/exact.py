"""Exact arithmetic and checksums: basis points as text, decimals of a stated scale, compensated sums, CRC-32C."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the reversed polynomial of CRC-32C.
CASTAGNOLI = 0x82F63B78


def half_even(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator (integers, the denominator positive, 38 digits at most) rounded to the nearest integer, ties to the even one; null without denominator."""
    n, d = numerator.cast("decimal(38,0)"), F.when(denominator != 0, denominator).cast("decimal(38,0)")
    rest = F.pmod(n, d)
    floor = ((n - rest) / d).cast("decimal(38,0)")
    return F.when(rest * 2 > d, floor + 1).when((rest * 2 == d) & (F.pmod(floor, F.lit(2)) == 1), floor + 1).otherwise(floor).cast("decimal(38,0)")


def basis_points_text(move: Column, entry: Column) -> Column:
    """move / |entry| x 10000 with ten digits, ties to even; null at a zero entry."""
    size = half_even(F.abs(move).cast("decimal(19,0)") * F.lit(10**14).cast("decimal(15,0)"), F.abs(entry))
    digits = F.lpad(size.cast("string"), F.greatest(F.length(size.cast("string")), F.lit(11)), F.lit("0"))
    text = F.regexp_replace(digits, r"(\d{10})$", ".$1")
    return F.when(size.isNotNull(), F.concat(F.when((move < 0) & (size > 0), "-").otherwise(""), text))


def rescaled(value: Column, scale: int) -> Column:
    """A decimal (of 18 digits at most on either side of the point) at `scale` digits if that drops none that count, else null."""
    at = value.try_cast(f"decimal(38,{scale})")
    return F.when(at.try_cast("decimal(38,18)") == value.try_cast("decimal(38,18)"), at)


def compensated_sum(values: np.ndarray) -> float:
    """The sum of doubles, rounded once."""
    return math.fsum(values)


def exact_sums(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key the sum of a double column as if it were added exactly and rounded once: keys, total.

    Each batch is folded to the partial sums that a lossless sum keeps (a few doubles, whose sum is exact), and these are folded again per key. Nulls don't count.
    """
    parts_of = lambda xs: _partials(xs)

    def fold(frames):
        for f in frames:
            rows = [(*k, p) for k, g in f.groupby(keys, dropna=False, sort=False) for k in [k if isinstance(k, tuple) else (k,)] for p in parts_of(g[value].dropna().tolist())]
            yield pd.DataFrame(rows, columns=[*keys, value])

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + f", {value} double"
    partial = df.select(*keys, F.col(value).cast("double").alias(value)).mapInPandas(fold, schema)
    return partial.groupBy(*keys).applyInPandas(lambda key, f: pd.DataFrame([(*key, math.fsum(f[value]))], columns=[*keys, "total"]), schema.rsplit(",", 1)[0] + ", total double")


def _partials(values: list[float]) -> list[float]:
    """Doubles that don't overlap and whose exact sum is that of the values."""
    out: list[float] = []
    for x in values:
        kept = []
        for y in out:
            if abs(x) < abs(y):
                x, y = y, x
            high = x + y
            low = y - (high - x)
            if low:
                kept.append(low)
            x = high
        out = [*kept, x]
    return out


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(CASTAGNOLI), t >> 1)
    return t


def crc32c_all(payloads: list[bytes | None]) -> list[int | None]:
    """CRC-32C of each payload, all of them a byte at a time; null for null."""
    table = _table()
    known = sorted((k for k, p in enumerate(payloads) if p is not None), key=lambda k: -len(payloads[k]))
    out: list[int | None] = [None] * len(payloads)
    lengths = np.array([len(payloads[k]) for k in known], np.int64)
    flat = np.frombuffer(b"".join(payloads[k] for k in known), np.uint8)
    starts = np.cumsum(lengths) - lengths
    crc = np.full(len(known), 0xFFFFFFFF, np.uint32)
    live = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), "left")  # how many are longer than each place
    for place, n in enumerate(live.tolist()):
        crc[:n] = table[(crc[:n] ^ flat[starts[:n] + place]) & 0xFF] ^ (crc[:n] >> 8)
    for k, c in zip(known, (crc ^ np.uint32(0xFFFFFFFF)).tolist()):
        out[k] = c
    return out


def crc32c(payload: Column) -> Column:
    """CRC-32C of a binary column."""

    @F.pandas_udf("bigint")
    def checked(parts: pd.Series) -> pd.Series:
        return pd.Series(crc32c_all(parts.tolist()), dtype="Int64")

    return checked(payload)
