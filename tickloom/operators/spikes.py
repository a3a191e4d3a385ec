"""Implausible readings: impossible values, spikes and standstills, against each source's own behaviour.

Each series of a source is taken through the undecimated Haar transform at the widths 1, 2 and 4: the detail at a reading is the mean of
so many readings from it on less the mean of as many before. At each width details are scaled by the upper quartile of the
sizes of the series' own non-zero details. A spike is a stretch of a few readings between two outlying details of opposite
sign at one of the widths, all of it far from the level before, to which the series is back after it; a lasting change of level has
no second detail, livelier stretches have none that is outlying. At the ends of a series, where the other detail is missing, a reading's
own level (a candle's open and close) tells a spike from a change of level, and where it has none the series is mirrored about its
end. Runs of zero details, spikes aside, are standstills if they are far longer than the other runs of the series, than runs that its
share of zero details explains, and than runs usual in sources of its kind. Bounds around the series' median find what can be no price.

Readings repeated at one instant count as one. What says whether a reading is within a spike are the readings at most HALO places
away, so the series, written once in ordered shards, are worked on in Arrow batches as whole arrays, and only the readings near the
borders of shards meet those of the neighbouring shards. No result depends on where the borders lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prices import price_units
from ..session import shuffle_width, written
from .shards import fits, lookup_join, ordered_shards

#: A value beyond this factor of the series' median, either way, is no price.
FACTOR = 5.0
#: Outlying: a detail of more than so many upper quartiles of the series' non-zero details.
OUTLYING = 11.0
#: A spike's return comes within this share of its least height.
RETURN = 0.3
#: Readings in a spike at most.
WIDTH = 5
#: A standstill is so many times longer than what is usual.
STILL_RATIO = 2.5
#: Of the sources of a kind, the share whose ordinary runs a standstill must outlast.
USUAL = 0.9
#: Widths of the Haar details.
WIDTHS = (1, 2, 4)
#: Bins an octave in which sizes of details, and values for the median, are counted.
BINS = 64
#: Measured bytes up to which a table of series is broadcast. There are many of them, all of which pass through the driver, and a hash table is three times as large.
SERIES_BYTES = 4 << 20


def haar(u: np.ndarray, width: int) -> np.ndarray:
    """Details at the places width..n-width: mean of `width` readings from there on less the mean of as many before."""
    b, k = u, 1
    while k < width:
        b, k = b[k:] + b[:-k], 2 * k
    return (b[width:] - b[:-width]) / width if len(u) >= 2 * width else np.empty(0)


def size_bin(sizes: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(sizes) * BINS).astype(np.int64)


def bin_size(b: int) -> float:
    """Upper edge of a bin."""
    return 2.0 ** ((b + 1) / BINS)


def _quartile(bins: np.ndarray, counts: np.ndarray) -> float:
    """Upper edge of the bin of the upper quartile (nearest rank); 0 if there is none."""
    if not len(bins):
        return 0.0
    order = np.argsort(bins)
    below = np.cumsum(counts[order])
    return bin_size(int(bins[order][np.searchsorted(below, -(-3 * below[-1] // 4))]))


def spike_mask(u: np.ndarray, own: np.ndarray, scale: np.ndarray, outlying: float, back: float, width: int, ends: bool) -> np.ndarray:
    """Which of a series' distinct readings are within spikes. `ends`: the first and last readings are those of the series.

    Whether a reading is one depends on nothing more than 3 * width + 1 places away.
    """
    n, mask = len(u), np.zeros(len(u), bool)
    for w, s in zip(WIDTHS, scale):
        d = haar(u, w)
        far = np.abs(d) > outlying * s
        if s <= 0 or not far.any():
            continue
        for m in range(w, width + 1):
            i = np.flatnonzero(far[: len(d) - m] & far[m:] & (d[: len(d) - m] * d[m:] < 0)) + w if len(d) > m else np.empty(0, np.int64)
            if not len(i):
                continue
            mean = lambda at, k: sum(u[at + j] for j in range(k)) / k
            base, after = mean(i - w, w), mean(i + m, w)
            x = np.stack([u[i + j] for j in range(m)], 1)
            sign = np.sign(x[:, 0] - base)
            height = ((x - base[:, None]) * sign[:, None]).min(1)
            good = (height > outlying * s) & (np.abs(after - base) <= back * height)
            for j in [*range(-w, 0), *range(m, m + w)]:  # at the wider widths no reading of the stretch may hide in the means
                good &= np.abs(u[i + j] - base) <= 0.5 * height
            for k in np.flatnonzero(good):
                # The stretch between two spikes looks like a spike seen from within them; the level around tells which is which.
                around = np.median(u[max(0, i[k] - 2 * width) : i[k] + m + 2 * width])
                if abs(base[k] - around) < abs(x[k].mean() - around):
                    mask[i[k] : i[k] + m] = True
    if ends and n > 1 and scale[0] > 0:
        for flip in (False, True):
            v, o = (u[::-1], own[::-1]) if flip else (u, own)
            hit = _end(v[: 3 * width + 1], o[:width], n, outlying * scale[0], back, width)
            mask |= hit[::-1] if flip else hit
    return mask


def _end(u: np.ndarray, own: np.ndarray, n: int, far: float, back: float, width: int) -> np.ndarray:
    """Readings at the start of a series that are far from what follows and have a level of their own that they are far from, or none."""
    mask = np.zeros(n, bool)
    for h in range(1, min(width, len(u) - 1) + 1):
        x = u[:h] - u[h]
        sign = np.sign(x[0])
        least = (x * sign).min()
        rest = np.abs(u[h : h + width + 1] - u[h])
        if least <= far or rest.max() > 0.5 * least:
            continue
        known = ~np.isnan(own[:h])
        told = np.abs(u[:h] - np.where(known, own[:h], 0.0)) > max(far, least * (1 - back))
        mask[:h] |= np.where(known, told, 2 * h - 1 <= width and h < n - h)
    return mask


def _halo(width: int) -> int:
    return 3 * width + 1


def _chunks(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Stretches of consecutive rows of one key as (key, arrays of `names`). `no` grows by one from row to row of a shard, so a shard that a scan has cut gives several stretches."""
    held: list[dict[str, np.ndarray]] = []
    last: tuple[int, int] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = {c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in {"key", "no", *names}}
        key, no = cols["key"], cols["no"]
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (no[1:] != no[:-1] + 1)) + 1
        bounds = [0, *cuts.tolist(), len(key)]
        for lo, hi in zip(bounds, bounds[1:]):
            if held and last != (int(key[lo]), int(no[lo]) - 1):
                yield int(held[0]["key"][0]), {c: np.concatenate([h[c] for h in held]) for c in names}
                held = []
            held.append({c: v[lo:hi] for c, v in cols.items()})
            last = (int(key[hi - 1]), int(no[hi - 1]))
    if held:
        yield int(held[0]["key"][0]), {c: np.concatenate([h[c] for h in held]) for c in names}


class _Sheet:
    """Rows gathered from many series as arrays and given out as few Arrow batches. What a row doesn't state is null, an array it doesn't state is empty."""

    def __init__(self, **kinds: pa.DataType) -> None:
        self.kinds, self.parts, self.sizes = kinds, {c: [] for c in kinds}, []

    def add(self, size: int, **columns) -> None:
        """`size` rows; a number stands for as many, an array column states the array of the first row alone."""
        self.sizes.append(size)
        for c, parts in self.parts.items():
            parts.append(columns.get(c))

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        sizes = np.array(self.sizes, np.int64)
        if sizes.sum() < least or not sizes.sum():
            return
        columns = []
        for c, kind in self.kinds.items():
            parts = self.parts[c]
            stated = np.array([p is not None for p in parts])
            if pa.types.is_list(kind):
                first, lengths = np.cumsum(sizes) - sizes, np.zeros(int(sizes.sum()), np.int32)
                lengths[first[stated]] = [len(p) for p in parts if p is not None]
                values = np.concatenate([p for p in parts if p is not None] or [np.empty(0)])
                columns.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.array(values, kind.value_type)))
                continue
            flat = np.concatenate([np.full(n, 0 if p is None else p) if p is None or np.ndim(p) == 0 else p for n, p in zip(self.sizes, parts)])
            columns.append(pa.array(flat.astype(bool) if pa.types.is_boolean(kind) else flat, kind, mask=np.repeat(~stated, sizes)))
        yield pa.RecordBatch.from_arrays(columns, names=list(self.kinds))
        self.sizes, self.parts = [], {c: [] for c in self.kinds}


#: Rows that are given out together.
_ROWS = 20_000


def _distinct(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows begin a distinct reading, and each row's reading."""
    new = np.ones(len(x["t"]), bool)
    new[1:] = (x["t"][1:] != x["t"][:-1]) | (x["u"][1:] != x["u"][:-1])
    return new, np.cumsum(new) - 1


def _own(own: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Greatest level of its own that a row of each reading tells."""
    out = np.full(n, -np.inf)
    np.maximum.at(out, row, np.where(np.isnan(own), -np.inf, own))
    return np.where(np.isinf(out), np.nan, out)


def _detail_counts(u: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Details at the places `inside` as (code, count): code is 4 * bin + number of the width, or -(number + 1) << 40 for zeros."""
    codes = []
    for k, w in enumerate(WIDTHS):
        d = haar(u, w)
        a = np.abs(d[inside[w : len(u) - w + 1]]) if len(d) else d
        codes.append(size_bin(a[a > 0]) * 4 + k)
        codes.append(np.full(int((a == 0).sum()), -(k + 1) << 40))
    return np.unique(np.concatenate(codes), return_counts=True)


_BORDER = "key bigint, kind int, t bigint, u double, own double, decided boolean, codes array<bigint>, counts array<bigint>"
_LISTS = pa.list_(pa.int64())


def _borders(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each stretch: how its inner details are distributed (kind 0), and the readings near its ends (kind 1), of which those that are not `decided` need the neighbours."""
    halo = _halo(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Sheet(key=pa.int64(), kind=pa.int32(), t=pa.int64(), u=pa.float64(), own=pa.float64(), decided=pa.bool_(), codes=_LISTS, counts=_LISTS)
        for key, x in _chunks(batches, "t", "u", "own"):
            new, row = _distinct(x)
            t, u = x["t"][new], x["u"][new]
            n = len(t)
            own = _own(x["own"], row, n)
            inner = np.zeros(n, bool)
            inner[halo : max(n - halo, 0)] = True
            if n > 2 * halo:
                codes, counts = _detail_counts(u, inner)
                out.add(1, key=key, kind=0, codes=codes, counts=counts)
            at = np.arange(n) if n <= 4 * halo else np.concatenate([np.arange(2 * halo), np.arange(n - 2 * halo, n)])
            out.add(len(at), key=key, kind=1, t=t[at], u=u[at], own=own[at], decided=inner[at])
            yield from out.batches(_ROWS)
        yield from out.batches()

    return run


def _by_key(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], lists: tuple[str, ...] = ()) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Rows ordered by key as (key, arrays of `names`, and of `lists` what their rows hold, end to end), one a key."""
    held: list[dict[str, np.ndarray]] = []
    last: int | None = None
    whole = lambda: {c: np.concatenate([h[c] for h in held]) for c in (*names, *lists)}
    for b in batches:
        column = lambda c: b.column(b.schema.get_field_index(c))
        key = column("key").to_numpy(zero_copy_only=False)
        cols = {c: column(c).to_numpy(zero_copy_only=False) for c in names}
        flat = {c: (column(c).offsets.to_numpy(), column(c).values.to_numpy(zero_copy_only=False)) for c in lists}
        bounds = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for lo, hi in zip(bounds, bounds[1:]):
            if hi == lo:
                continue
            if held and last != int(key[lo]):
                yield last, whole()
                held.clear()
            last = int(key[lo])
            held.append({c: v[lo:hi] for c, v in cols.items()} | {c: v[o[lo] : o[hi]] for c, (o, v) in flat.items()})
    if held:
        yield last, whole()


_STITCHED = "key bigint, kind int, t bigint, u double, n bigint, zeros bigint, scales array<double>"


def _stitched(outlying: float, back: float, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From what _borders gives, ordered by key, kind and reading: a series' number of readings, zero details and scales (kind 0), and the readings near borders that are spikes (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Sheet(key=pa.int64(), kind=pa.int32(), t=pa.int64(), u=pa.float64(), n=pa.int64(), zeros=pa.int64(), scales=pa.list_(pa.float64()))
        for key, x in _by_key(batches, ("kind", "t", "u", "own", "decided"), ("codes", "counts")):
            codes, counts, here = x["codes"], x["counts"], x["kind"] == 1
            t, u, own, decided = (x[c][here] for c in ("t", "u", "own", "decided"))
            new, row = _distinct({"t": t, "u": u})
            n = int(new.sum())
            own, t, u = _own(own, row, n), t[new], u[new]
            # A reading that two stretches share is at a border of both.
            open_ = np.zeros(n, bool)
            open_[row[~decided.astype(bool)]] = True
            more, times = _detail_counts(u, open_)
            codes, counts = np.concatenate([codes, more]), np.concatenate([counts, times])
            known = codes >= -(1 << 39)
            of = [known & (codes % 4 == k) for k in range(len(WIDTHS))]
            scale = np.array([_quartile(codes[f] // 4, counts[f]) for f in of])
            zeros = int(counts[codes == -1 << 40].sum())
            out.add(1, key=key, kind=0, n=int(counts[of[0]].sum()) + zeros + 1, zeros=zeros, scales=scale)
            at = np.flatnonzero(spike_mask(u, own, scale, outlying, back, width, True) & open_)
            if len(at):
                out.add(len(at), key=key, kind=1, t=t[at], u=u[at])
            yield from out.batches(_ROWS)
        yield from out.batches()

    return run


def usual_run(n: Column, zeros: Column) -> Column:
    """The longest run of equal readings that n readings with so many zero details show if these come independently; infinite if there are no others."""
    details = F.greatest(n - 1, F.lit(1)).cast("double")
    more = F.log(F.greatest(details - zeros, F.lit(2.0))) / F.log(details / zeros)
    return F.when(zeros <= 0, 1.0).when(zeros >= details, float("inf")).otherwise(1.0 + more)


#: Kinds of rows of _found.
SPIKE, LENGTHS, RUN, EDGE = range(4)
_FOUND = "key bigint, kind int, row_id bigint, u double, first bigint, last bigint, n bigint, head boolean, tail boolean, lengths array<bigint>"


def _found(outlying: float, back: float, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each stretch: the rows of spikes (kind SPIKE), runs at its ends (EDGE) and long ones within (RUN), and the lengths of the runs within (LENGTHS)."""
    halo = _halo(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Sheet(key=pa.int64(), kind=pa.int32(), row_id=pa.int64(), u=pa.float64(), first=pa.int64(), last=pa.int64(), n=pa.int64(), head=pa.bool_(), tail=pa.bool_(), lengths=_LISTS)
        for key, x in _chunks(batches, "t", "u", "row_id", "border", "s0", "s1", "s2", "least"):
            new, row = _distinct(x)
            t, u = x["t"][new], x["u"][new]
            n = len(t)
            least = max(2.0, x["least"][0])
            spiked = np.zeros(n, bool)
            if n > 2 * halo:
                scale = np.array([x[f"s{k}"][0] for k in range(len(WIDTHS))])
                spiked[halo : n - halo] = spike_mask(u, np.empty(0), scale, outlying, back, width, False)[halo : n - halo]
            border = x["border"].astype(bool)
            if border.any():
                spiked[row[border]] = True
            if spiked.any():
                hit = spiked[row]
                out.add(int(hit.sum()), key=key, kind=SPIKE, row_id=x["row_id"][hit])
                t, u = t[~spiked], u[~spiked]
            if len(t):
                cut = np.flatnonzero(u[1:] != u[:-1]) + 1
                first, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(u)]])
                length = stop - first
                if len(first) > 2:
                    out.add(1, key=key, kind=LENGTHS, lengths=np.unique(length[1:-1]))
                inner = np.flatnonzero(length[1:-1] >= least) + 1
                for kind, at in ((RUN, inner), (EDGE, np.unique([0, len(first) - 1]))):
                    if len(at):
                        out.add(len(at), key=key, kind=kind, u=u[first[at]], first=t[first[at]], last=t[stop[at] - 1], n=length[at], head=at == 0, tail=at == len(first) - 1)
            yield from out.batches(_ROWS)
        yield from out.batches()

    return run


_LONG = "key bigint, u double, first bigint, last bigint, n bigint, ordinary bigint, breaks array<bigint>"


def _standstills(ratio: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From runs ordered by key and time: per series its ordinary longest run (u null), and its runs that may be standstills, with the lengths from which they are if nothing else forbids it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Sheet(key=pa.int64(), u=pa.float64(), first=pa.int64(), last=pa.int64(), n=pa.int64(), ordinary=pa.int64(), breaks=_LISTS)
        for key, d in _by_key(batches, ("kind", "u", "first", "last", "n", "head", "tail", "least"), ("lengths",)):
            sizes = set(d["lengths"].tolist())
            runs: list[list] = []
            open_: list | None = None  # a run at the end of a stretch, which may go on in the next
            least = max(2.0, float(d["least"][0]))
            rows = np.flatnonzero(d["kind"] != LENGTHS)
            for kind, head, tail, *here in zip(*(d[c][rows].tolist() for c in ("kind", "head", "tail", "u", "first", "last", "n"))):
                if kind == RUN:
                    runs.append(here)
                    continue
                if open_ is not None and head and open_[0] == here[0]:
                    here = [here[0], open_[1], here[2], open_[3] + here[3] - (open_[2] == here[1])]
                elif open_ is not None:
                    runs.append(open_)
                open_ = here
                if not tail:
                    runs.append(open_)
                    open_ = None
            if open_ is not None:
                runs.append(open_)
            sizes = sorted(sizes | {int(r[3]) for r in runs})
            breaks = [n for k, n in enumerate(sizes) if n >= ratio * (sizes[k - 1] if k else 0) and n >= least]
            out.add(1, key=key, ordinary=max((n for n in sizes if not breaks or n < breaks[0]), default=0))
            for r in runs:
                if breaks and r[3] >= breaks[0]:
                    out.add(1, key=key, u=r[0], first=int(r[1]), last=int(r[2]), n=int(r[3]), breaks=np.array(breaks))
            yield from out.batches(_ROWS)
        yield from out.batches()

    return run


def _same_entity(df: DataFrame) -> DataFrame:
    """The entity as a join key under which null equals null."""
    return df.withColumn("_entity", F.coalesce(F.concat(F.lit("="), F.col("entity").cast("string")), F.lit("")))


def _series_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    return lookup_join(big, small, on, how, max_bytes=SERIES_BYTES)


def _told(shards: DataFrame, series: DataFrame, border: DataFrame, wide: int) -> DataFrame:
    """The readings in the order of their shards with what is known of their series, and whether they are border readings that are spikes."""
    shards = shards.select("key", "no", "t", "u", "row_id")
    if fits(series, max_bytes=SERIES_BYTES) and fits(border, max_bytes=SERIES_BYTES):  # both joins leave the rows in their order
        told = lookup_join(lookup_join(shards, series, "key", "inner", small_fits=True), border, ["key", "t", "u"], small_fits=True)
        return told.withColumn("border", F.coalesce("border", F.lit(False)))
    # What one shard has of one series meets what is known of it. The number of partitions is stated, so none of them is parted.
    shards = shards.withColumn("shard", F.shiftright("no", 33))
    parts = shards.groupBy("shard", "key").agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
    marks = parts.join(border.hint("shuffle_merge"), "key").where("t between _first and _last").groupBy("shard", "key").agg(F.collect_set(F.struct("t", "u")).alias("_marks"))
    known = parts.select("shard", "key").join(series.hint("shuffle_merge"), "key").join(marks.hint("shuffle_merge"), ["shard", "key"], "left")
    told = shards.repartition(wide, "shard", "key").join(known.hint("shuffle_merge"), ["shard", "key"])
    spiked = F.when(F.col("_marks").isNotNull(), F.array_contains("_marks", F.struct("t", "u"))).otherwise(False)
    return told.withColumn("border", spiked).drop("_marks", "shard").sortWithinPartitions("no")


def implausible(readings: DataFrame, *, factor: float = FACTOR, outlying: float = OUTLYING, back: float = RETURN, width: int = WIDTH, still_ratio: float = STILL_RATIO, usual: float = USUAL) -> DataFrame:
    """Readings (series, entity, t, u, row_id) that are implausible: series, row_id, reason (`impossible`, `spike`, `still`).

    t: micros, u: double. Null values are no cases; non-finite ones are impossible. Readings without t are only held against the
    bounds. A null entity is an entity of its own. Repeats of a reading share its flag, repeated rows give one row. Empty input gives an
    empty result; a series that never moves stands still no longer than it does otherwise. A column `own` (double), if there
    is one, is a level that the reading itself tells, null where it tells none; it decides at the ends of a series.
    """
    readings = readings.where("u is not null")
    if "own" not in readings.columns:
        readings = readings.withColumn("own", F.lit(None).cast("double"))
    readings = readings.select("series", "entity", "t", "u", "own", "row_id")
    u = F.col("u")
    # Each series of an entity gets a number, which stands for both from here on.
    bin_ = F.when((u > 0) & ~F.isnan(u) & (u < float("inf")), F.floor(F.log2(u) * BINS))
    counts = readings.groupBy("series", "entity", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    levels = counts.groupBy("series", "entity").agg(F.pow(F.lit(2.0), (F.percentile("bin", F.lit(0.5), F.col("n")) + 0.5) / BINS).alias("level"))
    levels = written(levels.withColumn("key", F.monotonically_increasing_id()), "levels")
    held = _series_join(_same_entity(readings).drop("entity"), _same_entity(levels).drop("entity"), ["series", "_entity"], "left").drop("_entity")
    level = F.col("level")
    wrong = F.isnan(u) | (u <= 0) | (F.abs(u) == float("inf")) | F.coalesce((u > level * factor) | (u < level / factor), F.lit(False))

    order, wide = ("key", "t", "u", "row_id"), shuffle_width(readings.sparkSession)  # a stated number, for little data that costs much isn't to be put together
    # Impossible readings lie before all series, without a key, so that the tables are joined with their series once.
    held = held.withColumn("wrong", wrong).where("wrong or t is not null")
    held = held.select(F.when(~F.col("wrong"), F.col("key")).alias("key"), "t", "u", "row_id", "own", F.when(F.col("wrong"), F.col("series")).alias("series"))
    shards = ordered_shards(held, ["key"], ["t", "u", "row_id"])
    shards = written(shards.drop("_shard").sortWithinPartitions(*order).withColumn("no", F.monotonically_increasing_id()), "readings")
    impossible = shards.where("key is null").select("series", "row_id", F.lit("impossible").alias("reason"))
    shards = shards.where("key is not null").drop("series")
    edges = shards.select("key", "no", "t", "u", F.coalesce("own", F.lit(float("nan"))).alias("own")).mapInArrow(_borders(width), _BORDER)
    stitched = written(edges.repartition(wide, "key").sortWithinPartitions("key", "kind", "t", "u").mapInArrow(_stitched(outlying, back, width), _STITCHED), "stitched")
    series = stitched.where("kind = 0").select("key", *[F.col("scales")[k].alias(f"s{k}") for k in range(len(WIDTHS))], (usual_run(F.col("n"), F.col("zeros")) * still_ratio).alias("least"))
    border = stitched.where("kind = 1").select("key", "t", "u", F.lit(True).alias("border"))

    found = written(_told(shards, series, border, wide).mapInArrow(_found(outlying, back, width), _FOUND), "found")
    runs = _series_join(found.where(F.col("kind") != SPIKE).drop("row_id"), series.select("key", "least"), "key")
    runs = runs.repartition(wide, "key").sortWithinPartitions("key", F.col("first").asc_nulls_first(), "u", "last", "head", F.col("tail").desc())
    long = written(runs.select("key", "kind", "u", "first", "last", "n", "head", "tail", "lengths", F.col("least")).mapInArrow(_standstills(still_ratio), _LONG), "runs")
    kinds = levels.select("key", "series")
    ordinary = _series_join(long.where("u is null").select("key", "ordinary"), kinds, "key").groupBy("series").agg((F.percentile("ordinary", F.lit(usual)) * still_ratio).alias("_usual"))
    still = _series_join(_series_join(long.where("u is not null"), kinds, "key"), ordinary, "series")
    still = still.where(F.col("n") >= F.array_min(F.filter("breaks", lambda b: b >= F.col("_usual")))).select("key", "u", "first", "last")
    still_rows = _series_join(shards.select("key", "t", "u", "row_id"), written(still, "still"), ["key", "u"]).where("t between first and last").select("key", "row_id", F.lit("still").alias("reason"))
    moving = found.where(F.col("kind") == SPIKE).select("key", "row_id", F.lit("spike").alias("reason")).unionByName(still_rows)
    return impossible.unionByName(_series_join(moving, kinds, "key").select("series", "row_id", "reason")).distinct()


def market_readings(ticks: DataFrame, generations: DataFrame, candles: DataFrame) -> DataFrame:
    """The series of ticks (prices at price_scale) and candles (high and low, with the nearer of open and close as their own level) of each generation."""
    scales = generations.groupBy("generation").agg(F.max("price_scale").alias("_scale"))
    t = lookup_join(ticks.select("generation", "event_time_micros", "price", "tick_id"), scales, "generation")
    t = t.select(F.lit("ticks").alias("series"), F.col("generation").alias("entity"), F.unix_micros("event_time_micros").alias("t"), price_units(F.col("price"), F.col("_scale")).alias("u"), F.col("tick_id").alias("row_id"))
    own = lambda f: (f("open_units", "close_units") if {"open_units", "close_units"} <= set(candles.columns) else F.lit(None)).cast("double")
    both = F.explode(F.array(*[F.struct(F.lit(f"candles.{k}").alias("s"), F.col(f"{k}_units").cast("double").alias("u"), own(f).alias("own")) for k, f in (("high", F.greatest), ("low", F.least))]))
    c = candles.select("generation", "open_time_micros", "candle_id", both.alias("x")).select(F.col("x.s").alias("series"), F.col("generation").alias("entity"), F.unix_micros("open_time_micros").alias("t"), F.col("x.u").alias("u"), F.col("candle_id").alias("row_id"), F.col("x.own").alias("own"))
    return t.withColumn("own", F.lit(None).cast("double")).unionByName(c)


def implausible_rows(ticks: DataFrame, generations: DataFrame, candles: DataFrame) -> DataFrame:
    """Rows of ticks and candles with an implausible price, and candles whose high is below their low: row_table, row_id, reason."""
    found = implausible(market_readings(ticks, generations, candles))
    crossed = candles.where("high_units < low_units").select(F.lit("candles").alias("row_table"), F.col("candle_id").alias("row_id"), F.lit("crossed").alias("reason"))
    return found.select(F.substring_index("series", ".", 1).alias("row_table"), "row_id", "reason").unionByName(crossed).distinct()
