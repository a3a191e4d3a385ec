"""Exact prices, relative moves and bucket ladders as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper ends of the gap classes in micros (the last class is open), and their names.
GAP_ENDS = (0, 2_000_000, 15_000_000, 60_000_000, 300_000_000, 1_800_000_000)
GAP_CLASSES = ("duplicate_or_backwards", "normal_small_tick_delay", "medium_feed_delay", "large_feed_delay", "short_data_gap", "session_or_collection_gap", "major_data_outage_or_session_break")


def interval_open(t: Column, duration: int, offset: int = 0) -> Column:
    """Start of the epoch-aligned bucket (shifted by `offset`) that holds t; all in micros."""
    return t - F.pmod(t - F.lit(offset), F.lit(duration))


def float_units(price: Column, scale: Column) -> tuple[Column, Column]:
    """Units of a double at `scale` digits, and whether they are exact: no digits beyond the scale, and finite."""
    x = price * F.pow(F.lit(10.0), scale.cast("double"))
    near = F.round(x)
    exact = F.coalesce((F.abs(x) < 9e15) & (F.abs(x - near) <= F.lit(1e-6)), F.lit(False))
    return F.when(exact, near).cast("bigint"), exact


def price_units(price: Column, scale: Column) -> Column:
    """`price` counted in units of 10^-scale, rounded; without a scale the price as it is."""
    return F.when(scale.isNull(), price).otherwise(F.round(price * F.pow(F.lit(10.0), scale.cast("double"))))


def decimal_units(text: Column, scale: int) -> Column:
    """Units of a decimal text; null if it isn't one or has more digits than `scale` (never rounded)."""
    ok = text.rlike(rf"^-?\d{{1,18}}(\.\d{{1,{scale}}})?$" if scale else r"^-?\d{1,18}$")
    return F.when(ok, (text.try_cast(f"decimal(38,{scale})") * F.lit(10**scale)).try_cast("bigint"))


def decimal_text(units: Column, scale: int) -> Column:
    """Units as a decimal text with `scale` digits."""
    return (units.cast(f"decimal(38,{scale})") / F.lit(10**scale)).cast(f"decimal(38,{scale})").cast("string")


def event_micros(text: Column) -> Column:
    """Micros of `YYYY-MM-DDTHH:MM:SS[.f{1,6}]Z`, null for any other text."""
    ok = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$")
    return F.when(ok, F.unix_micros(text.try_cast("timestamp")))


def event_text(micros: Column) -> Column:
    """The text of an instant with six fraction digits."""
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def relative_move(before: Column, after: Column) -> Column:
    """floor(10000 * |after - before| / |before|), null after zero."""
    return F.when(before != 0, F.floor(F.abs(after - before).cast("decimal(38,0)") * 10_000 / F.abs(before).cast("decimal(38,0)"))).cast("bigint")


def bps_change(value: Column, reference: Column) -> Column:
    """Signed relative change in basis points, null at a zero reference."""
    return (value - reference).cast("double") / F.abs(F.when(reference != 0, reference)).cast("double") * 10_000


def six(value: Column) -> Column:
    return F.round(value, 6)


def ladder(value: Column, ends: Sequence[float], names: Sequence[str], otherwise_null: str | None = None) -> Column:
    """names[i] for the first i with value <= ends[i], else the last name; for null `otherwise_null`."""
    out = F.lit(names[-1])
    for end, name in reversed(list(zip(ends, names))):
        out = F.when(value <= end, F.lit(name)).otherwise(out)
    return F.when(value.isNull(), F.lit(otherwise_null)).otherwise(out)


def gap_class(micros: Column) -> Column:
    return ladder(micros, GAP_ENDS, GAP_CLASSES)
