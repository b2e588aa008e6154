"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The rank file is read once on the driver (a vocabulary: its size is fixed) and travels with the tasks; every worker
process builds the encoder once. The pre-splitting pattern is that of public_tokenizers.PATTERN: words, numbers and signs
take one blank before them, and of a longer run of white space all but the last character is a match of its own. Long
texts are cut where a match must end in any case: before a space that follows an ASCII letter or digit, and around long
runs of white space, which the library's matcher cannot walk and which are encoded apart as the one match that they are.
So a text of any length and kind has the ids of the whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from loomtext.llm.batches import map_texts

PIECE = 1 << 16
#: White space as the pattern's matcher knows it, in runs too long to be left to it.
LONG_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{4096,}")


def load_ranks(path: str) -> bytes:
    """The compressed bytes of a rank file (lines of base64 token and rank)."""
    with open(path, "rb") as f:
        return zlib.compress(f.read())


@lru_cache(maxsize=2)
def _encoder(ranks: bytes, pattern: str):
    import tiktoken

    lines = (x.split() for x in zlib.decompress(ranks).splitlines() if x)
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})


def pieces(text: str, size: int = PIECE):
    """The text in parts of about `size` characters, cut only before a space after an ASCII letter or digit."""
    start, n = 0, len(text)
    while n - start > size:
        cut = text.find(" ", start + size)
        while cut > 0 and not (text[cut - 1].isascii() and text[cut - 1].isalnum()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def stretches(text: str) -> Iterator[tuple[str, bool]]:
    """The text in order as (part, whether it is white space that makes up one match)."""
    start = 0
    for run in LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))  # the last blank goes with what follows
        yield text[start : run.start()], False
        yield text[run.start() : end], True
        start = end
    yield text[start:], False


def encode(text: str | None, ranks: bytes, pattern: str) -> np.ndarray:
    """The ids of a whole text; a null or empty text has none."""
    enc = _encoder(ranks, pattern)
    parts = []
    for stretch, lone in stretches(text or ""):
        parts += [enc._encode_single_piece(stretch)] if lone else [enc.encode_ordinary(p) for p in pieces(stretch)]
    return np.array(parts[0] if len(parts) == 1 else [i for p in parts for i in p], "<u4")


def decode(ids, ranks: bytes, pattern: str) -> bytes:
    """The raw bytes of the ids; they need not be valid UTF-8."""
    return _encoder(ranks, pattern).decode_bytes([int(i) for i in ids])


def encode_column(docs: DataFrame, ranks: bytes, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with `ids` (array<int>), `n_tokens` and `decoded_sha256` (of the bytes that the ids decode to).

    A null or empty text has no ids; texts may be of any length and kind; repeated rows each get a row; an empty table
    gives none. Input columns of the three names are replaced, all others stay.
    """
    fields = {"ids": "array<int>", "n_tokens": "long", "decoded_sha256": "string"}

    def make(texts):
        ids = [encode(t, ranks, pattern) for t in texts]
        return [i.astype(np.int32) for i in ids], [len(i) for i in ids], [hashlib.sha256(decode(i.tolist(), ranks, pattern)).hexdigest() for i in ids]

    keep = {c: F.col(c) for c in docs.columns if c not in fields}
    return map_texts(docs, keep, F.col(text_col).cast("string"), fields, make)


def decode_column(df: DataFrame, ranks: bytes, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with a binary column `out` of the decoded bytes; null ids give null."""

    @F.pandas_udf("binary")
    def raw(ids: pd.Series) -> pd.Series:
        return pd.Series([None if i is None else decode(i, ranks, pattern) for i in ids])

    return df.withColumn(out, raw(F.col(ids_col)))


def token_digests(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each text, decodes the ids again and keeps digests.

    Returns one row per input row: id_col, n_tokens (long), ids_sha256 (of the ids as little-endian unsigned 32-bit
    integers) and decoded_sha256 (of the decoded bytes). A null text is as the empty one; texts may be of any length and
    kind; repeated rows each get a row; an empty table gives none; other input columns are ignored.
    """

    def make(texts):
        ids = [encode(t, ranks, pattern) for t in texts]
        back = [hashlib.sha256(decode(i.tolist(), ranks, pattern)).hexdigest() for i in ids]
        return [len(i) for i in ids], [hashlib.sha256(i.tobytes()).hexdigest() for i in ids], back

    fields = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return map_texts(docs, {id_col: F.col(id_col)}, F.col(text_col).cast("string"), fields, make)
