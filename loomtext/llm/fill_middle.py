"""Fill-in-middle transformation: texts cut at two random unit boundaries and written in another order.

The boundaries of a text's units (a run of blanks with the word after it, or the blanks at its end) are kept in a
compressed set in the manner of Roaring bitmaps: one container for each 2**16 code points, an array of places, a bitmap
or a list of runs, whichever is smallest, and the number of members up to each container. A cut at the k-th boundary is
one search in those numbers for the container and one select inside it.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from loomtext.llm.batches import map_texts

CHUNK = 1 << 16
MARKS = ("<P>", "<S>", "<M>")


class Array:
    """Sorted places."""

    kind = "array"

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    @staticmethod
    def size(low: np.ndarray) -> int:
        return 2 * len(low)

    def select(self, k: int) -> int:
        return int(self.low[k])


class Bitmap:
    """One bit a place, in words of 64, with the number of bits before each word."""

    kind = "bitmap"

    def __init__(self, low: np.ndarray):
        bits = np.zeros(CHUNK, bool)
        bits[low] = True
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    @staticmethod
    def size(low: np.ndarray) -> int:
        return CHUNK // 8

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        inside = np.flatnonzero(np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little"))
        return 64 * word + int(inside[k - self.before[word]])


class Runs:
    """First place and length of every run of neighbouring places, with the number of places before each."""

    kind = "runs"

    def __init__(self, low: np.ndarray):
        first = np.flatnonzero(np.diff(low, prepend=low[0] - 2) != 1)
        self.starts = low[first].astype(np.uint16)
        self.before = np.append(first, len(low))

    @staticmethod
    def size(low: np.ndarray) -> int:
        return 4 * (1 + int(np.count_nonzero(np.diff(low) != 1)))

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


class BoundarySet:
    """A set of places that grows at its end, by chunk; select(k) gives its k-th place from 0."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.containers: list[Array | Bitmap | Runs] = []
        self.upto: list[int] = [0]

    def __len__(self) -> int:
        return self.upto[-1]

    def add(self, key: int, low: np.ndarray) -> None:
        """The sorted distinct places `low` (int64, each under CHUNK) of the chunk `key`, which comes after all chunks before."""
        if len(low):
            self.keys.append(key)
            self.containers.append(min((Array, Bitmap, Runs), key=lambda c: c.size(low))(low))
            self.upto.append(self.upto[-1] + len(low))

    def select(self, k: int) -> int:
        at = bisect_right(self.upto, k) - 1
        return self.keys[at] * CHUNK + self.containers[at].select(k - self.upto[at])


def unit_ends(text: str) -> BoundarySet:
    """The last code point of every unit `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+` of the text, chunk by chunk."""
    found = BoundarySet()
    for lo in range(0, len(text), CHUNK):
        # One code point more shows whether the chunk's last unit ends in it; after the text everything ends.
        cp = np.frombuffer(text[lo : lo + CHUNK + 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = (cp == 32) | ((cp - np.uint32(9)) <= 4)
        last = ~blank[:-1] & blank[1:]
        if lo + CHUNK >= len(text):
            last = np.append(last, True)
        found.add(lo // CHUNK, np.flatnonzero(last))
    return found


def split_points(ends: BoundarySet, a: int, b: int) -> tuple[int, int]:
    """Code-point offsets after the first a and the first b units."""
    return tuple(ends.select(k - 1) + 1 if k else 0 for k in (a, b))


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """Every whole text, `rate` of a hundred of them in fill-in-middle order.

    Four draws h1 to h4 are the first 8-digit groups of the hex SHA-256 of `seed:id`. With n units, the prefix ends after
    the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger, the suffix is the rest. The form is
    plain if the text is empty or holds one of the marks, or if h3 % 100 >= rate; else spm if h4 % 100 < spm, else psm.
    Returns one row per input row: id_col, n (long), form, prefix_chars and middle_chars (long, code points; null if
    plain) and output (plain: the text; psm: prefix mark, prefix, suffix mark, suffix, middle mark, middle; spm: suffix
    part before the prefix part). A null text is as the empty one and a null id draws as an empty one; a text of blanks
    alone is one unit; very long texts take a set of at most 8 kB per 65,536 code points; equal rows give equal rows; an
    empty table gives none; other input columns are ignored.
    """
    p, s, m = marks
    draws = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)

    def one(text: str, digest: str) -> tuple:
        h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
        ends = unit_ends(text)
        n = len(ends)
        if not text or h3 % 100 >= rate or any(x in text for x in marks):
            return n, "plain", None, None, text
        a, b = split_points(ends, *sorted((h1 % (n + 1), h2 % (n + 1))))
        if h4 % 100 < spm:
            return n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
        return n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))

    def make(texts, digests):
        return list(zip(*(one(t, d) for t, d in zip(texts, digests, strict=True))))

    fields = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return map_texts(docs, {id_col: F.col(id_col)}, text, fields, make, more=[draws])


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text of a transformed row, from its form and output alone: no mark stands in a text that is not plain."""
    p, s, m = marks
    part = lambda before, after: F.substring_index(F.substring_index(output, before, -1), after, 1)
    psm, spm = F.concat(part(p, s), F.substring_index(output, m, -1), part(s, m)), F.concat(part(p, m), F.substring_index(output, m, -1), part(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, **options) -> DataFrame:
    """transform() with the SHA-256 (lowercase hex, UTF-8) of the output and of the text restored from it in their places."""
    done = transform(docs, **options)
    marks = options.get("marks", MARKS)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    restored_sha = sha(restored(F.col("form"), F.col("output"), marks))
    return done.withColumns({"output_sha256": sha(F.col("output")), "restored_sha256": restored_sha}).drop("output")


_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SQL = f"""WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_UNIT}') AS w, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT *, len(w) AS n, [('0x' || substr(h, k, 8))::BIGINT for k in [1, 9, 17, 25]] AS r FROM u),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, coalesce(array_to_string(w[:a], ''), '') AS pre, coalesce(array_to_string(w[a + 1:b], ''), '') AS mid, coalesce(array_to_string(w[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
 sha256(pre || mid || suf) AS restored_sha256 FROM p"""
