"""Per-document text statistics that tell natural prose from lists, tables, boilerplate and junk, in any language.

No words of any language are known here. What counts are letters, digits, marks and spaces as Unicode classes, how they make tokens,
what ends sentences, how short many words of running text are, and what repeats. Texts of an Arrow batch are laid end to end as one array of code points, and
all counting runs over that array; no row needs any other, so nothing is shuffled.

A token is a word if it is letters (with inner apostrophes and hyphens) between punctuation. A line belongs to prose if, together with its neighbours
where it is short (so wrapped, narrow or unpunctuated prose stays prose), words make up most of its characters and there is a sentence: an
end mark, or enough short words. Rows of cells never belong to prose, list items only if they are sentences themselves. The repetition
statistics have the last word: in a document that mostly repeats its lines or paragraphs the repeats are boilerplate, and what one phrase fills is no prose.
"""

from __future__ import annotations

import sys
import types
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the characters that words must make up.
WORD_CHARS = 0.5
#: Words that a line and its neighbours should have together, and the least that make a sentence.
CONTEXT_WORDS, LEAST_WORDS = 30, 4
#: Without an end mark, running text has this many words at least, and this share of words of three letters or fewer, and so many signs a word at most.
OPEN_WORDS, SHORT_SHARE, SIGNS = 8, 0.15, 0.25
#: Letters in a word at most.
LONGEST = 40
#: Lines with so many separators (| or tab; ; in lines of few words), or dots in a row, are rows of cells.
CELLS, LEADER, FEW = 3, 4, 12
#: A list item is a sentence with this many words and an end mark, or this many without.
ITEM_WORDS, LONG_ITEM_WORDS = 8, 20
#: A document with this share of characters in repeated lines or paragraphs repeats itself.
REPEATED_SHARE = 0.85
#: A phrase of three words fills a text if it comes more than twice and covers this share of its words' characters, and a line of so many words if it covers this share of them.
PHRASE_SHARE, PHRASE_LINE = 0.4, 6

#: Characters that are worked on at once; a longer text is worked on alone.
AT_ONCE = 500_000

LAYOUT = ("duplicate_line_share", "duplicate_paragraph_share", "phrase_coverage", "prose_share")

#: Marks that end sentences, marks within words, and bullets; spaces beyond the ASCII ones; signs that, besides punctuation, may stand around a word.
END_MARKS, WIDE_END_MARKS, BULLETS, AROUND = ".!?…؟।", "。！？", "-*•·–+◦▪‣○●", "><~`+="
JOINERS = "'’ʼ-‐‑\u00ad\u200c\u200d"
SPACES = "\t\n\x0b\x0c\r \u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u3000"
#: Code points of scripts written without spaces (kana, Han, Thai to Lao, Myanmar, Khmer).
UNSPACED = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF))

LETTER, DIGIT, SPACE, WIDE, END, JOIN, EDGE = 1, 2, 4, 8, 16, 32, 64


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class flags and lower case of every code point, made once in each process."""
    held = vars(sys.modules.setdefault("_tickloom_text_classes", types.ModuleType("_tickloom_text_classes")))
    if "tables" not in held:
        kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
        for c in range(0x30000):
            x = chr(c)
            k = unicodedata.category(x)[0]
            kind[c] = LETTER if k in "LM" else DIGIT if k == "N" else EDGE if k == "P" else 0
            if k == "L" and len(y := x.lower()) == 1:
                lower[c] = ord(y)
        for text, flag in ((END_MARKS + WIDE_END_MARKS, END), (JOINERS, JOIN), (AROUND, EDGE)):
            kind[[ord(x) for x in text]] |= flag
        kind[[ord(x) for x in SPACES]] = SPACE
        for a, b in UNSPACED:
            kind[a : b + 1] |= np.where(kind[a : b + 1] & LETTER, WIDE, 0).astype(np.uint8)
        held["tables"] = kind, lower
    return held["tables"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, kept in the process up to the longest length asked for."""
    held = vars(sys.modules.setdefault("_tickloom_text_classes", types.ModuleType("_tickloom_text_classes")))
    if len(held.get("powers", ((),))[0]) < n:
        p = 0x9E3779B97F4A7C15
        ones = lambda x: np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 20), x, np.uint64)]))
        held["powers"] = ones(p), ones(pow(p, -1, 1 << 64))
    return held["powers"]


class _Hashed:
    """Hashes of 64 bits of stretches of an array of code points."""

    def __init__(self, codes: np.ndarray) -> None:
        up, self.down = _powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint32(0x100)) * up[: len(codes)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9) + (ends - starts).astype(np.uint64)


def _within(group: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes that also tell the group."""
    return (h ^ (h >> np.uint64(31))) + group.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def _again(key: np.ndarray) -> np.ndarray:
    """Which keys came before."""
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:]] = key[order[1:]] == key[order[:-1]]
    return out


def _phrases(key: np.ndarray, at: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of three tokens that come twice or more, from the key of each occurrence and its first token: the occurrences by phrase, where each phrase's begin in them, how many it has, and how many characters they cover."""
    order = np.argsort(key, kind="stable")
    k, at = key[order], at[order]
    cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    times = np.diff(np.append(cuts, len(k)))
    keep = np.repeat(times > 1, times)
    at, times = at[keep], times[times > 1]
    cuts = np.concatenate([[0], np.cumsum(times)[:-1]]).astype(np.int64)[: len(times)]
    if not len(cuts):
        return at, cuts, times, times
    begin = at.copy()
    begin[1:] = np.maximum(at[1:], at[:-1] + 3)  # what the occurrence before covers doesn't count again
    begin[cuts] = at[cuts]
    return at, cuts, times, np.add.reduceat(chars[at + 3] - chars[begin], cuts)


def layouts(texts: list[str | None]) -> np.ndarray:
    """A row of LAYOUT for each text: shares of characters in repeated lines and in repeated paragraphs (cases aside), share of the
    words' characters that one phrase of three words covers, the one that covers most of those that come twice or more, share of
    characters in prose. Null, empty and blank texts have no prose and no repetition: all are 0."""
    n_docs = len(texts)
    out = np.zeros((n_docs, len(LAYOUT)))
    kinds, lower = _classes()
    raw = [((t or "") + "\n").encode("utf-32-le", "surrogatepass") for t in texts]
    codes = np.frombuffer(b"".join(raw), "<u4")
    kind = kinds[codes]
    doc_ends = np.cumsum([len(r) // 4 for r in raw])

    space = (kind & SPACE) > 0
    turn = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        turn = np.concatenate([[0], turn])
    ts, te = turn[::2], turn[1::2]  # a text ends with a line's end, so every token does
    if not len(ts):
        return out
    count = lambda flags: (lambda at: (lambda a, b: np.searchsorted(at, b) - np.searchsorted(at, a)))(np.flatnonzero(flags))
    odd = (kind & (LETTER | SPACE)) == 0  # neither letter nor space
    places = np.flatnonzero((kind & (LETTER | DIGIT)) > 0)
    low, high = np.searchsorted(places, ts), np.searchsorted(places, te)
    core = high > low
    places = np.append(places, 0)
    first, stop = np.where(core, places[np.where(core, low, -1)], ts), np.where(core, places[high - 1] + 1, ts)
    size = te - ts
    n_letters = stop - first - count(odd)(first, stop)
    good = core & (n_letters > 0)
    ending = count((kind & END) > 0)
    ended = (good & (ending(stop, te) > 0)).astype(np.int64)
    strange = count(odd & ((kind & (DIGIT | EDGE | END)) == 0))
    word = good & (n_letters <= LONGEST) & (count(odd & ((kind & JOIN) == 0))(first, stop) == 0) & (strange(ts, first) == 0) & (strange(stop, te) == 0)
    words, word_chars, short, signs = word.astype(np.int64), n_letters * word, (word & (n_letters <= 3)).astype(np.int64), (size - n_letters) * word
    wide = (kind & WIDE) > 0
    if wide.any():
        # In scripts without spaces a token is many words, with marks between them.
        n_wide = count(wide)(ts, te)
        un = 2 * n_wide > size
        words, word_chars, short, signs = np.where(un, n_wide // 2, words), np.where(un, n_wide, word_chars), np.where(un, n_wide // 2, short), np.where(un, 0, signs)
        ended = np.where(un, count(np.isin(codes, [ord(x) for x in WIDE_END_MARKS]))(ts, te), ended)

    line_ends = np.flatnonzero(codes == 10)
    n_lines = len(line_ends)
    doc_of_line = np.searchsorted(doc_ends, line_ends, "right")
    line = np.searchsorted(line_ends, ts)
    head, after = np.searchsorted(line, np.arange(n_lines)), np.searchsorted(line, np.arange(n_lines), "right")
    n_tokens = after - head
    filled = n_tokens > 0
    total_of = lambda x: (lambda s: s[after] - s[head])(np.concatenate([[0], np.cumsum(x)]))
    head_at, tail_at = np.minimum(head, len(ts) - 1), np.maximum(after - 1, 0)
    begin, finish = np.where(filled, ts[head_at], 0), np.where(filled, te[tail_at], 0)
    length = finish - begin
    ink, w, wc, sh, en, sg = (total_of(x) for x in (size, words, word_chars, short, ended, signs))

    # Rows of cells, and list items.
    in_line = lambda flags: np.where(filled, count(flags)(begin, finish), 0)
    cells = np.maximum(in_line(codes == ord("|")), in_line(codes == 9))
    dots = codes == ord(".")
    leader = dots.copy()
    for k in range(1, LEADER):
        leader[k:] &= dots[:-k]
        leader[:k] = False
    table = (cells >= CELLS) | ((in_line(codes == ord(";")) >= CELLS) & (w < FEW)) | (in_line(leader) > 0)
    c0, size0 = codes[begin], np.where(filled, size[head_at], 0)
    c_last = codes[np.maximum(begin + size0 - 1, 0)]
    closed = (c_last == ord(".")) | (c_last == ord(")"))
    inner = size0 - 1 - (c0 == ord("("))
    digits = count((codes >= 48) & (codes <= 57))(begin, begin + size0)
    label = closed & (((inner >= 1) & (inner <= 3) & (digits == inner)) | ((size0 == 2) & (c0 >= 97) & (c0 <= 122)))
    bullet = (size0 == 1) & np.isin(c0, [ord(x) for x in BULLETS + "["])
    marked = (n_tokens > 1) & (bullet | label | ((size0 == 3) & (c0 == ord("[")) & (c_last == ord("]"))))
    item = marked & ~table & ((w >= LONG_ITEM_WORDS) | ((w >= ITEM_WORDS) & (ended[tail_at] > 0)))

    # Lines of running text see their neighbours in the same block until there are words enough.
    flowing = filled & ~marked & ~table
    block = np.cumsum(np.concatenate([[True], ~(flowing[1:] & flowing[:-1] & (doc_of_line[1:] == doc_of_line[:-1]))]))
    lo, hi = np.searchsorted(block, block), np.searchsorted(block, block, "right") - 1
    sums = {k: np.concatenate([[0], np.cumsum(v)]) for k, v in (("w", w), ("wc", wc), ("sh", sh), ("en", en), ("sg", sg), ("ink", ink))}
    a = b = np.arange(n_lines)
    for _ in range(1, CONTEXT_WORDS):
        more = (sums["w"][b + 1] - sums["w"][a] < CONTEXT_WORDS) & ((a > lo) | (b < hi))
        if not more.any():
            break
        a, b = np.where(more, np.maximum(a - 1, lo), a), np.where(more, np.minimum(b + 1, hi), b)
    cw, cwc, csh, cen, csg, cink = (sums[k][b + 1] - sums[k][a] for k in ("w", "wc", "sh", "en", "sg", "ink"))
    told = (cw >= LEAST_WORDS) & ((cen > 0) | ((cw >= OPEN_WORDS) & (csh >= SHORT_SHARE * cw) & (csg <= SIGNS * cw)))
    prose = (flowing & (w > 0) & told & (cwc >= WORD_CHARS * cink)) | (item & (wc >= WORD_CHARS * ink))

    # Repetition: lines, paragraphs (stretches of lines without a blank one), phrases.
    hashed = _Hashed(lower[codes])
    rows = np.flatnonzero(filled)
    again = np.zeros(n_lines, bool)
    again[rows] = _again(_within(doc_of_line[rows], hashed.of(begin[rows], finish[rows])))
    opens = filled & np.concatenate([[True], ~filled[:-1] | (doc_of_line[1:] != doc_of_line[:-1])])
    closes = filled & np.concatenate([~filled[1:] | (doc_of_line[1:] != doc_of_line[:-1]), [True]])
    p_first, p_last = np.flatnonzero(opens), np.flatnonzero(closes)
    chars = np.concatenate([[0], np.cumsum(length)])
    p_again = _again(_within(doc_of_line[p_first], hashed.of(begin[p_first], finish[p_last])))
    per_doc = lambda at, x: np.bincount(at, x, n_docs)
    total = np.maximum(per_doc(doc_of_line, length), 1)
    out[:, 0] = per_doc(doc_of_line, length * again) / total
    out[:, 1] = per_doc(doc_of_line[p_first], (chars[p_last + 1] - chars[p_first]) * p_again) / total
    # Phrases of words, without the marks around them; scripts without spaces have none.
    said = np.flatnonzero(words if not wide.any() else word & ~un)
    token = hashed.of(first[said], stop[said])
    token ^= token >> np.uint64(32)
    line, size = line[said], (stop - first)[said]
    doc = doc_of_line[line]
    at = np.flatnonzero(doc[:-2] == doc[2:])
    gram = (token[at] * np.uint64(3) + token[at + 1] * np.uint64(0x9FB21C651E98DF25)) * np.uint64(0x94D049BB133111EB) + token[at + 2]
    held, cuts, times, covers = _phrases(_within(doc[at], gram), at, np.concatenate([[0], np.cumsum(size)]))
    hollow = np.zeros(n_lines, bool)
    if len(held):
        best, of_words = np.zeros(n_docs, np.int64), np.maximum(per_doc(doc, size), 1)
        np.maximum.at(best, doc[held[cuts]], covers)
        out[:, 2] = best / of_words
        phrase = np.zeros(len(said), bool)
        for k in np.flatnonzero((times > 2) & (covers >= PHRASE_SHARE * of_words[doc[held[cuts]]])):
            for j in range(3):
                phrase[held[cuts[k] : cuts[k] + times[k]] + j] = True
        filled_by = np.bincount(line, size * phrase, n_lines)
        hollow |= (filled_by > 0) & (2 * filled_by >= np.bincount(line, size, n_lines))
        # A phrase that fills a line comes again in its text too.
        one = held[line[held] == line[held + 2]]
        of_gram = np.zeros(len(said), np.uint64)
        of_gram[at] = gram
        held, cuts, times, covers = _phrases(_within(line[one], of_gram[one]), one, np.arange(len(said) + 1))
        own = np.zeros(n_lines, np.int64)
        np.maximum.at(own, line[held[cuts]], covers)
        in_words = np.bincount(line, minlength=n_lines)
        hollow |= (in_words >= PHRASE_LINE) & (own >= PHRASE_SHARE * in_words)
    repeats = (np.maximum(out[:, 0], out[:, 1]) >= REPEATED_SHARE)[doc_of_line]
    told = again.copy()
    told[rows] |= p_again[np.cumsum(opens)[rows] - 1]
    prose &= ~(told & repeats) & ~hollow
    out[:, 3] = per_doc(doc_of_line, length * prose) / total
    return out


def phrase_coverage(words: list[str]) -> float:
    """The phrase_coverage of `layouts` for a text of these words."""
    return float(layouts([" ".join(words)])[0, 2])


def layout(text: str | None) -> tuple[float, float, float, float]:
    """`layouts` of one text."""
    return tuple(layouts([text])[0].tolist())


def text_layout(documents: DataFrame, text: str = "text") -> DataFrame:
    """`documents` with the columns of LAYOUT; see `layouts`. All other columns are kept (a clashing one is replaced)."""
    kept = [c for c in documents.columns if c not in LAYOUT]

    @F.pandas_udf(", ".join(f"{c} double" for c in LAYOUT))
    def shares(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            done, held, n = [], [], 0
            for t in texts.tolist():
                n += len(t) if t else 0
                held.append(t)
                if n >= AT_ONCE:
                    done.append(layouts(held))
                    held, n = [], 0
            done.append(layouts(held))
            yield pd.DataFrame(np.concatenate(done), columns=list(LAYOUT))

    return documents.select(*kept, shares(F.col(text)).alias("_layout")).select(*kept, "_layout.*")


def not_prose(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of documents less than half of whose characters are prose; empty and null texts aren't among them."""
    return text_layout(documents.select(id, text), text).where(F.col(text).rlike(r"\S")).where("prose_share < 0.5").select(id)


#: Share of the texts in which a common word stands.
COMMON_SHARE = 0.05
_WORDS = r"(\p{L}+)"


def common_words(documents: DataFrame, text: str = "text", share: float = COMMON_SHARE) -> list[str]:
    """The words that stand in at least `share` of all texts, in order. A text of n distinct words can have n of them, so there are at most mean(n) / share."""
    words = documents.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(_WORDS), F.lit(1)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    least = documents.agg((F.count(F.lit(1)) * share).alias("least"))
    return sorted(r[0] for r in words.join(F.broadcast(least)).where("n >= least").select("word").collect())


def text_statistics(documents: DataFrame, id: str = "doc_id", text: str = "text", common: list[str] | None = None) -> DataFrame:
    """id, n_words, mean_word_length, symbol_ratio, end_mark_share, common_word_share, line_count.

    Words are runs of letters; common ones are those of `common`, by default `common_words` of these documents. symbol_ratio: characters that are
    neither letters, digits nor white space, of all. end_mark_share: of the lines that aren't blank, those that end in . ! ? … or :. Where there is
    nothing to share (no words, lines or characters, a null text) the value is null and the counts are 0.
    """
    common = common_words(documents, text) if common is None else common
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"\S"))
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    s = documents.select(id, t.alias("_t"), F.regexp_extract_all(F.lower(t), F.lit(_WORDS), F.lit(1)).alias("_w"), lines.alias("_l"))
    letters = F.length(F.regexp_replace("_t", r"\P{L}+", ""))
    n, c = F.size("_w"), F.length("_t")
    known = F.size(F.filter("_w", lambda x: x.isin(*common))) if common else F.lit(0)
    return s.select(
        id, n.cast("bigint").alias("n_words"), share(letters, n).alias("mean_word_length"), share(F.length(F.regexp_replace("_t", r"[\p{L}\p{Nd}\s]+", "")), c).alias("symbol_ratio"),
        share(F.size(F.filter("_l", lambda x: x.rlike(r"[.!?…:]\s*$"))), F.size("_l")).alias("end_mark_share"), share(known, n).alias("common_word_share"), F.size("_l").cast("bigint").alias("line_count"),
    )
