"""Held-out evaluation passages that stand in a corpus, whole, in part or in other words.

Latent semantic retrieval: every document is cut into overlapping passages of TF-IDF weighted words, and both passages and the
items' passages are projected on the leading right singular vectors of the corpus' passage matrix, found by a distributed randomised
SVD. The items' passages are clustered, and a document's passage is compared with those of the nearest clusters only. Pairs whose best
cosine passes a threshold are aligned: a longest common subsequence with limited gaps marks the stretches of the item that the document
repeats. A pair of a high cosine without such stretches is a paraphrase if the item's answer stands in the document.

Only words of the items count (any other word has no weight in a cosine with an item), so the matrix has as many columns as the
items have distinct words. Document frequencies cover all documents. The singular vectors, which are the index, are fitted on
FIT_PASSAGES passages at most, taken by a hash of the document's id; every document is then projected and searched.

Passes over the corpus: one over the texts, which writes word numbers to the shared folder, and three over those numbers. Nothing is shuffled
but per-task sums whose size depends on the items alone. Items of more than ITEM_WORDS words together are searched in groups of that size.
"""

from __future__ import annotations

import html
import re
import sys
import types
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_width, written
from .quality import AT_ONCE, _Hashed as text_hashes

#: Words in a block; a passage is two neighbouring blocks.
BLOCK = 12
#: Singular vectors kept, and how many more the randomised range has.
RANK, MORE = 192, 24
#: Passages on which the singular vectors are fitted, at most.
FIT_PASSAGES = 50_000
#: Cosine from which a document is aligned with an item, and from which it may be a paraphrase.
COSINE, PARAPHRASE = 0.55, 0.8
#: Clusters of the items' passages that a passage is compared with.
PROBES = 6
#: Words a stretch may skip in a row on either side, share of the words on either side that must agree, and its least length and matches.
GAP, AGREE, STRETCH, MATCHES = 3, 0.8, 10, 5
#: Share of an item's words in stretches that makes a leak.
LEAKED = 0.5
#: Words of the items that are searched for at once; each task holds them and their latent vectors.
ITEM_WORDS = 50_000
#: Rows of a matrix that are summed in one group.
PIECE = 1_024

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"<[a-zA-Z/!][^<>\n]{0,300}>")
_HYPHEN = re.compile(r"(?<=\w)-[ \t]*\n\s*(?:[>|*#]\s*)?(?=[a-z])")
_SENTENCE = re.compile(r"(?<=[.!?…;:])\s+")
#: Accents and invisible characters, which are dropped after decomposition, and the curly apostrophe.
_DROPPED = dict.fromkeys((*(c for c in range(0x30000) if unicodedata.category(chr(c)) in ("Mn", "Cf")), ord("’")))


def plain(text: str) -> str:
    """Lower-case text without accents, mark-up, invisible characters, apostrophes and hyphenation at line ends."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_DROPPED)
    if "-" in text:
        text = _HYPHEN.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return text.replace("'", "").lower()


def words(text: str) -> list[str]:
    """The words of `plain`: letters and digits in a row."""
    return _WORD.findall(plain(text))


def _alnum() -> np.ndarray:
    """Which code points are letters or digits, told once in each process."""
    held = vars(sys.modules.setdefault("_tickloom_alnum", types.ModuleType("_tickloom_alnum")))
    if "table" not in held:
        held["table"] = np.array([chr(c).isalnum() for c in range(0x110000)])
    return held["table"]


def _lookup(vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the vocabulary's words in order, and their numbers."""
    held = list(vocabulary)
    lengths = np.array([len(w) for w in held])
    ends = np.cumsum(lengths)
    h = text_hashes(np.frombuffer("".join(held).encode("utf-32-le"), "<u4")).of(ends - lengths, ends)
    order = np.argsort(h)
    return h[order], np.array(list(vocabulary.values()), np.int32)[order]


@dataclass
class Items:
    """The evaluation items as word numbers."""

    ids: list
    words: list[np.ndarray]
    sentences: list[list[tuple[int, int]]]
    vocabulary: dict[str, int]
    answers: list[np.ndarray] = field(default_factory=list)

    @property
    def size(self) -> int:
        return len(self.vocabulary)


def read_items(items: DataFrame, id: str = "item_id", text: str = "item_text", answer: str | None = None) -> Items:
    """Items with at least one word; null ids and texts are left out. A row of items that differ in their answer only is an item of its own."""
    out = Items([], [], [], vocabulary := {})
    rows = items.select(F.col(id), F.col(text), F.lit(None).cast("string") if answer is None else F.col(answer).cast("string")).where(F.col(id).isNotNull() & F.col(text).isNotNull()).distinct()
    for i, t, a in sorted(rows.toLocalIterator(), key=lambda r: (r[0], r[1], r[2] or "")):
        w = words(t)
        if not w:
            continue
        numbers = lambda ws: np.array([vocabulary.setdefault(x, len(vocabulary)) for x in ws], np.int32)
        out.ids.append(i)
        out.words.append(numbers(w))
        out.answers.append(numbers(words(a or "")))
        ends, at = [], 0
        for s in _SENTENCE.split(t):
            n = len(words(s))
            if n:
                ends.append((at, at + n))
            at += n
        out.sentences.append(ends)
    return out


def numbers_of(texts: list[str | None], hashes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts, end to end, as their numbers (-1 for words outside the vocabulary), and how many words each text has. Words are told by hashes of 64 bits."""
    made = [plain(t) if t else "" for t in texts]
    codes = np.frombuffer("\n".join([*made, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    inside = np.zeros(len(codes) + 1, bool)
    inside[1:] = _alnum()[codes]  # every text ends with a line's end, which is outside
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turn[::2], turn[1::2]
    if not len(starts) or not len(hashes):
        found = np.full(len(starts), -1, np.int32)
    else:
        h = text_hashes(codes).of(starts, ends)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        found = np.where(hashes[at] == h, numbers[at], -1).astype(np.int32)
    lengths = np.array([len(t) + 1 for t in made], np.int64)
    return found, np.bincount(np.searchsorted(np.cumsum(lengths), starts, "right"), minlength=len(texts)).astype(np.int64)


def _numbered(vocabulary: dict[str, int], id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, numbers = _lookup(vocabulary)
        for b in batches:
            texts, lo = b.column(1).to_pylist(), 0
            while lo < len(texts):
                hi, n = lo, 0
                while hi < len(texts) and (hi == lo or n < AT_ONCE):
                    n, hi = n + len(texts[hi] or ""), hi + 1
                flat, lengths = numbers_of(texts[lo:hi], hashes, numbers)
                ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "numbers"])
                lo = hi

    return run


def blocks(flat: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts' word numbers, laid end to end, as rows of `width` padded with -1; and each row's text."""
    per = -(-lengths // width)
    first = np.concatenate([[0], np.cumsum(per)[:-1]])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    rows = np.full(int(per.sum()) * width, -1, np.int32)
    rows[np.arange(len(flat)) + np.repeat(first * width - starts, lengths)] = flat
    return rows.reshape(-1, width), np.repeat(np.arange(len(lengths)), per)


def _batches(b: pa.RecordBatch, at_most: int = 60_000) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Word numbers and lengths of groups of documents of about `at_most` words (one document at least), and the first's place."""
    lists = b.column(b.schema.get_field_index("numbers"))
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    lo = 0
    while lo < len(lists):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + at_most, "right")) - 1)
        yield flat[offsets[lo] : offsets[hi]], np.diff(offsets[lo : hi + 1]).astype(np.int64), lo
        lo = hi


def _frequencies(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for b in batches:
            for flat, lengths, _ in _batches(b):
                m = np.sort(blocks(flat, lengths, 2 * BLOCK)[0], axis=1)
                first = m >= 0
                first[:, 1:] &= m[:, 1:] != m[:, :-1]
                total += np.bincount(m[first], minlength=size)
                n += len(m)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["word", "n"])

    return run


def _weighted(idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Rows idf * basis, with a row of zeros for what -1 picks."""
    return np.vstack([basis * idf[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)


def _summed(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the table's rows that each row picks, column by column, so that no array of all picked rows is made."""
    out = table[rows[:, 0]]
    for j in range(1, rows.shape[1]):
        out += table[rows[:, j]]
    return out


def _gram_times(idf: np.ndarray, basis: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """This task's part of A' A basis, where A has a row of unit length per passage, in pieces of rows."""
    size, width = len(idf), basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, squares = _weighted(idf, basis), np.append(idf, 0.0).astype(np.float32) ** 2
        out = np.zeros((size, width))
        for b in batches:
            for flat, lengths, _ in _batches(b):
                rows = blocks(flat, lengths, 2 * BLOCK)[0]
                for lo in range(0, len(rows), 500):
                    m = rows[lo : lo + 500]
                    norm = squares[m].sum(1)
                    z = _summed(table, m) / np.maximum(norm, 1e-9)[:, None]
                    ids = m.ravel()
                    order = np.argsort(ids, kind="stable")
                    order = order[np.searchsorted(ids[order], 0) :]
                    if len(order):
                        at = ids[order]
                        cuts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
                        out[at[cuts]] += np.add.reduceat(z[order // m.shape[1]], cuts, axis=0) * idf[at[cuts]][:, None]
        for lo in range(0, size, PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([out[lo : lo + PIECE].astype(np.float32).tobytes()], pa.binary())], names=["at", "part"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the parts at each place."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for at, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = np.frombuffer(part, np.float32).astype(np.float64)
            sums[at] = sums[at] + x if at in sums else x
    for at, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([x.astype(np.float32).tobytes()], pa.binary())], names=["at", "part"])


@dataclass
class Index:
    """The items' passages in the latent space: their vectors, ordered by cluster, whose items they are, and the clusters' centres and bounds."""

    idf: np.ndarray
    basis: np.ndarray
    queries: np.ndarray
    item: np.ndarray
    centres: np.ndarray
    bounds: np.ndarray


def latent_basis(numbers: DataFrame, size: int, rank: int = RANK, fit_passages: int = FIT_PASSAGES, seed: int = 42, powers: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """idf over all passages, and the leading right singular vectors by a randomised SVD (range of (A'A)^powers, then Rayleigh-Ritz)."""
    counts = {r[0]: r[1] for r in numbers.mapInArrow(_frequencies(size), "word bigint, n bigint").groupBy("word").agg(F.sum("n")).collect()}  # a row a word of the items
    n = counts.pop(-1, 0)
    df = np.zeros(size)
    df[list(counts)] = list(counts.values())
    idf = np.log((n + 1) / (df + 1)) + 0.1
    rank = min(rank, size)
    width = min(size, rank + MORE)
    if width == size or n == 0:
        return idf, np.eye(size)[:, :rank] if n == 0 else np.eye(size)
    million = 1_000_000
    share = min(1.0, fit_passages / n)
    fit = written(numbers.where(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < int(share * million)), "fit")
    pieces = -(-size // PIECE)

    def times(basis: np.ndarray) -> np.ndarray:
        """One matrix of words x width, whose words are those of ITEM_WORDS words at most; the tasks' parts are added by executors."""
        parts = fit.mapInArrow(_gram_times(idf, basis), "at bigint, part binary").repartition(min(pieces, shuffle_width(fit.sparkSession)), "at").mapInArrow(_added, "at bigint, part binary").collect()
        return np.concatenate([np.frombuffer(p[1], np.float32).reshape(-1, basis.shape[1]).astype(float) for p in sorted(parts)])

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    for _ in range(powers):
        q = np.linalg.qr(times(q))[0]
    values, vectors = np.linalg.eigh((lambda t: (t + t.T) / 2)(q.T @ times(q)))
    return idf, (q @ vectors[:, ::-1])[:, :rank]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def clusters(x: np.ndarray, count: int, rounds: int = 8, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Centres of unit vectors by spherical k-means, and the cluster of each."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), count, replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centres)
    return centres.astype(np.float32), np.argmax(x @ centres.T, axis=1)


def item_index(items: Items, idf: np.ndarray, basis: np.ndarray) -> Index:
    """Passages of the items at every block, with the last one ending where the item ends, in as many clusters as the root of their number."""
    table = _weighted(idf, basis)
    queries, item = [], []
    for i, w in enumerate(items.words):
        for s in sorted({*range(0, max(1, len(w) - 2 * BLOCK), BLOCK), max(0, len(w) - 2 * BLOCK)}):
            queries.append(table[w[s : s + 2 * BLOCK]].sum(0))
            item.append(i)
    q = _unit(np.array(queries, np.float32))
    count = max(1, int(np.sqrt(len(q))))
    centres, own = clusters(q, count)
    order = np.argsort(own, kind="stable")
    return Index(idf, basis, q[order], np.array(item)[order], centres, np.searchsorted(own[order], np.arange(count + 1)))


def candidates(flat: np.ndarray, lengths: np.ndarray, index: Index, table: np.ndarray, cosine: float, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (document, item) of some passages' cosine of at least `cosine`, with the greatest, ordered by document."""
    rows, own = blocks(flat, lengths, BLOCK)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step, count = 1_024, len(index.centres)
    for lo in range(0, len(rows), step):
        s = _summed(table, rows[lo : lo + step + 1])  # one more, for the passage that begins in the last block
        o = own[lo : lo + step + 1]
        x = s.copy()
        same = o[1:] == o[:-1]
        x[:-1][same] += s[1:][same]
        x = _unit(x[:step])
        near = x @ index.centres.T
        chosen = near >= np.partition(near, count - probes, axis=1)[:, count - probes, None] if probes < count else np.ones_like(near, bool)
        chosen = np.ascontiguousarray(chosen.T)
        for c in range(count):
            a, b = index.bounds[c : c + 2]
            at = np.flatnonzero(chosen[c]) if b > a else ()
            if len(at):
                cos = x[at] @ index.queries[a:b].T
                d, q = np.nonzero(cos >= cosine)
                if len(d):
                    found.append((o[at[d]], index.item[a + q], cos[d, q]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    doc, item, cos = (np.concatenate(v) for v in zip(*found))
    order = np.lexsort((-cos, item, doc))
    doc, item, cos = doc[order], item[order], cos[order]
    best = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
    return doc[best], item[best], cos[best]


def coverage(item: np.ndarray, sentences: list[tuple[int, int]], document: np.ndarray, gap: int = GAP, agree: float = AGREE) -> float:
    """Share of the item's words in stretches that the document repeats; `coverages` of one pair."""
    zero = np.zeros(1, np.int64)
    return float(coverages([item], [sentences], [document], zero, zero, gap, agree)[0])


def coverages(items: list[np.ndarray], sentences: list[list[tuple[int, int]]], documents: list[np.ndarray], item: np.ndarray, document: np.ndarray, gap: int = GAP, agree: float = AGREE, cells: int = 2_000_000) -> np.ndarray:
    """Share of the item's words in stretches that the document repeats, for each pair of an `item` and a `document`, given by their numbers.

    A stretch is a common subsequence that skips fewer than `gap` words in a row on either side, in which at least the share
    `agree` of the words agrees on either side, and which is STRETCH words of the item long or holds a whole sentence of it. Of the
    subsequences that end in a pair of places the longest counts, of these the one that begins first in the item, then last in the document.
    Pairs are worked on in groups of `cells` words of documents, which move along their items at once.
    """
    out = np.zeros(len(item))
    if not len(item):
        return out
    # The places of each known word in each document.
    lengths = np.array([len(d) for d in documents])
    flat = np.concatenate(documents).astype(np.int64)
    ends = np.cumsum(lengths)
    own = np.repeat(np.arange(len(documents)), lengths)
    known = np.flatnonzero(flat >= 0)
    size = 1 + max([int(flat.max(initial=0)), *(int(i.max(initial=0)) for i in items)])
    key = own[known] * size + flat[known]
    order = np.argsort(key, kind="stable")
    key, known = key[order], known[order]
    total = np.cumsum(lengths[document] + gap)
    lo = 0
    while lo < len(item):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + cells, "right")))
        out[lo:hi] = _aligned(items, sentences, item[lo:hi], document[lo:hi], lengths, (ends - lengths), key, known, size, gap, agree)
        lo = hi
    return out


def _bits(item: int, document: int) -> tuple[int, int]:
    """Bits in which an alignment keeps its matches and its first place in the item, and that in the document: together they fit one number for texts of any size a task can hold."""
    a, b = item.bit_length() + 1, document.bit_length() + 1
    if 2 * a + b > 63:
        raise ValueError(f"an item of {item} words and a document of {document}")
    return a, b


def _aligned(items: list[np.ndarray], sentences: list[list[tuple[int, int]]], item: np.ndarray, document: np.ndarray, lengths: np.ndarray, starts: np.ndarray, key: np.ndarray, known: np.ndarray, size: int, gap: int, agree: float) -> np.ndarray:
    n = len(item)
    width = np.array([len(items[i]) for i in item])
    length = int(width.max())
    # Every match of a word of the item and one of the document: pair, place in the item, place in the document.
    want = np.concatenate([items[i] for i in item]).astype(np.int64)
    pair = np.repeat(np.arange(n), width)
    place = np.arange(len(want)) - np.repeat(np.cumsum(width) - width, width)
    wanted = document[pair] * size + want
    first, times = np.searchsorted(key, wanted), np.searchsorted(key, wanted, "right")
    times -= first
    which = np.repeat(np.arange(len(want)), times)
    at = known[np.repeat(first - (np.cumsum(times) - times), times) + np.arange(len(which))]
    order = np.argsort(place[which], kind="stable")
    which, at = which[order], at[order]
    row, pair = place[which], pair[which]
    at = at - starts[document[pair]]
    room = lengths[document] + gap
    cell = (np.cumsum(room) - room)[pair] + gap + at
    bounds = np.searchsorted(row, np.arange(length + 1))
    last = np.full((length, n), -1, np.int64)  # first word of the latest sentence that has ended
    for k, i in enumerate(item):
        for a, b in sentences[i]:
            last[b - 1, k] = max(last[b - 1, k], a)
    last = np.maximum.accumulate(last, axis=0)
    item_bits, doc_bits = _bits(length, int(lengths[document].max()))
    top, one = (1 << item_bits) - 1, 1 << (item_bits + doc_bits)
    # Cells of the last `gap` words of the item, with `gap` empty ones before each document; only cells that were set are emptied.
    before = [np.zeros(int(room.sum()), np.int64) for _ in range(gap + 1)]
    set_ = [cell[:0] for _ in range(gap + 1)]
    start = np.full((length, n), length, np.int64)
    for i in range(length):
        lo, hi = bounds[i], bounds[i + 1]
        c, now = cell[lo:hi], before.pop()
        now[set_.pop()] = 0
        if hi > lo:
            best = np.zeros(hi - lo, np.int64)
            for b in before:
                for back in range(1, gap + 1):
                    np.maximum(best, b[c - back], out=best)
            best = np.where(best > 0, best + one, one | ((top - i) << doc_bits) | at[lo:hi])
            now[c] = best
            some = np.flatnonzero(best >= MATCHES * one)
            if len(some):
                best, r, k = best[some], pair[lo:hi][some], at[lo:hi][some]
                matches, first, begin = best >> (item_bits + doc_bits), top - ((best >> doc_bits) & top), best & ((1 << doc_bits) - 1)
                span = i - first + 1
                good = (matches >= agree * span) & (matches >= agree * (k - begin + 1)) & ((span >= STRETCH) | (first <= last[i][r]))
                np.minimum.at(start[i], r[good], first[good])
        before.insert(0, now)
        set_.insert(0, c)
    marks = np.zeros((length + 1, n), np.int64)
    i, k = np.nonzero(start <= np.arange(length)[:, None])
    np.add.at(marks, (start[i, k], k), 1)
    np.add.at(marks, (i + 1, k), -1)
    return (np.cumsum(marks, axis=0)[:-1] > 0).sum(0) / width


def stands_in(part: np.ndarray, document: np.ndarray) -> bool:
    """Whether `part`, which has a word at least, stands word by word in the document."""
    if not len(part) or len(part) > len(document):
        return False
    at = np.flatnonzero(document[: len(document) - len(part) + 1] == part[0])
    for k in range(1, len(part)):
        at = at[document[at + k] == part[k]]
    return len(at) > 0


def _searched(items: Items, index: Index, cosine: float, paraphrase: float, leaked: float, probes: int, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _weighted(index.idf, index.basis)
        for b in batches:
            docs, at, share, cosines, kinds = [], [], [], [], []
            texts: list[np.ndarray] = []
            pairs: list[tuple[int, int, float, int]] = []

            def align() -> None:
                covered = coverages(items.words, items.sentences, texts, np.array([p[1] for p in pairs], np.int64), np.array([p[3] for p in pairs], np.int64)) if pairs else ()
                for (d, i, c, t), v in zip(pairs, covered):
                    told = v < leaked and c >= paraphrase and stands_in(items.answers[i], texts[t])
                    if v >= leaked or told:
                        for column, x in ((docs, d), (at, i), (share, float(v)), (cosines, c), (kinds, "paraphrase" if told else "wording")):
                            column.append(x)
                pairs.clear()
                texts.clear()

            size = 0
            for flat, lengths, lo in _batches(b):
                ends = np.concatenate([[0], np.cumsum(lengths)])
                held = np.zeros(items.size + 1, bool)
                last = -1
                for d, i, c in zip(*(v.tolist() for v in candidates(flat, lengths, index, table, cosine, probes))):
                    text = flat[ends[d] : ends[d + 1]]
                    if d != last:
                        held[:] = False
                        held[text] = True  # the last place takes the words that no item has
                        held[-1] = False
                        last, fresh = d, True
                    # Words that the document lacks are in no match, and stretches, of which two may overlap, need `agree` of theirs: too few leave too little to cover.
                    some = np.count_nonzero(held[items.words[i]]) >= AGREE / (2 - AGREE) * leaked * len(items.words[i])
                    if some or (c >= paraphrase and len(items.answers[i])):
                        if fresh:
                            texts.append(text)
                            size, fresh = size + len(text), False
                        pairs.append((lo + d, i, c, len(texts) - 1))
                if size > 1_000_000:
                    align()
                    size = 0
            align()
            ids = b.column(b.schema.get_field_index("doc_id")).take(pa.array(docs, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([items.ids[i] for i in at], id_type), ids, pa.array(share, pa.float64()), pa.array(cosines, pa.float64()), pa.array(kinds, pa.string())], names=["item_id", "doc_id", "coverage", "cosine", "kind"])

    return run


def leaks(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", answer: str | None = None, rank: int = RANK, fit_passages: int = FIT_PASSAGES, cosine: float = COSINE, paraphrase: float = PARAPHRASE, leaked: float = LEAKED, probes: int = PROBES, item_words: int = ITEM_WORDS) -> DataFrame:
    """Every (item_id, doc_id, coverage, cosine, kind) of a document that repeats at least `leaked` of an item's words (kind `wording`), or that
    has a passage whose cosine with one of the item is at least `paraphrase`, and the item's answer (kind `paraphrase`; only with `answer`, a column of the items).

    Case, punctuation, accents, mark-up, layout and hyphenation don't count. Null or empty texts and items leak nothing, an item with a null or
    empty answer has no paraphrases; a text that is filed again leaks again; without items or documents the result is empty. Ids may be of any
    type; repeated rows of documents give repeated rows.
    """
    spark = documents.sparkSession
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {"item_id": items.schema[item_id].dataType, "doc_id": documents.schema[doc_id].dataType}
    schema = f"item_id {kinds['item_id'].simpleString()}, doc_id {kinds['doc_id'].simpleString()}, coverage double, cosine double, kind string"
    source = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    n_words = items.agg(F.sum(F.size(F.split(F.col(item_text), r"\W+")))).first()[0] or 0
    groups = max(1, -(-n_words // item_words))
    out = spark.createDataFrame([], schema)
    for g in range(groups):
        held = read_items(items.where(F.pmod(F.xxhash64(item_id), F.lit(groups)) == g), item_id, item_text, answer)
        if not held.ids:
            continue
        numbers = written(source.mapInArrow(_numbered(held.vocabulary, to_arrow_type(kinds["doc_id"])), f"doc_id {kinds['doc_id'].simpleString()}, numbers array<int>"), "numbers")
        index = item_index(held, *latent_basis(numbers, held.size, rank, fit_passages))
        out = out.unionByName(numbers.mapInArrow(_searched(held, index, cosine, paraphrase, leaked, probes, to_arrow_type(kinds["item_id"])), schema))
    return out
