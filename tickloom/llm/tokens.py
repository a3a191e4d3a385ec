"""Token counts by a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64
import sys
import types
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the vocabulary lies; a parameter of all that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE of this vocabulary cuts a text before merging (a fixed, published pattern).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def encoding(path: str, pattern: str = PATTERN):
    """The byte-level BPE of a file with one `base64 rank` a line, read once in each process."""
    import tiktoken

    held = vars(sys.modules.setdefault("_tickloom_encodings", types.ModuleType("_tickloom_encodings")))
    if (path, pattern) not in held:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        held[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return held[path, pattern]


#: Texts are cut at white space into pieces of about so many characters before they are encoded, for even work per call.
PIECE = 100_000


def count(text: str, path: str = VOCABULARY) -> int:
    """Tokens of a whole text. Very long texts are encoded in pieces cut before a blank that follows a letter, where the pattern cuts anyway."""
    e = encoding(path)
    if len(text) <= PIECE:
        return len(e.encode_ordinary(text))
    total, start = 0, 0
    while start < len(text):
        end = min(len(text), start + PIECE)
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
            end += 1
        total += len(e.encode_ordinary(text[start:end]))
        start = end
    return total


def n_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of each text; 0 for an empty or null one."""

    @F.pandas_udf("bigint")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([count(t, path) if t else 0 for t in texts], dtype="int64")

    return counted(text)
