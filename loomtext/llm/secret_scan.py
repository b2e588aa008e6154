"""Secret scans: keyword prefilter, anchored expressions near the hits, embedded checksums.

All kinds are found on the UTF-8 bytes of the text, one byte a character, with A-Z lower-cased for the keywords: every
expression here is ASCII, so no multi-byte character can take part in a match, and places are turned back into code
points at the end. One Aho-Corasick pass gives the places of all keywords; an expression is only tried, anchored, where
its keyword stands. Runs of 32 hexadecimal digits have no keyword; every 16th byte is looked at, and only runs with two
such neighbours are measured. Tokens with an embedded checksum are reported when the checksum holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from loomtext.llm.batches import map_texts

#: Kinds in the order of ties, their keywords and expressions.
KINDS = ("assign", "access", "hex", "github", "npm")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "api_key", "apikey"), "access": ("akia",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


@lru_cache(maxsize=1)
def _keywords():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def checksum(body: str) -> str:
    """Six base-62 digits of the CRC-32 of the body, as such tokens embed it."""
    value, digits = zlib.crc32(body.encode("ascii")), ""
    for _ in range(6):
        value, rest = divmod(value, 62)
        digits = BASE62[rest] + digits
    return digits


def _hex_runs(raw: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of at least MIN_HEX lower-case hexadecimal digits."""
    step = MIN_HEX // 2
    marks = _HEX[raw[::step]]
    both = np.flatnonzero(marks[:-1] & marks[1:])
    found, end = [], 0
    for at in both.tolist():
        at *= step
        if at < end:
            continue
        lo = at
        while lo > end and _HEX[raw[lo - 1]]:
            lo -= 1
        stop = at
        while True:
            part = _HEX[raw[stop : stop + 4096]]
            cut = np.flatnonzero(~part)
            if len(cut) or not len(part):
                stop += int(cut[0]) if len(cut) else 0
                break
            stop += len(part)
        end = stop
        if stop - lo >= MIN_HEX:
            found.append((lo, stop))
    return found


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    whole, lower = data.decode("latin-1"), data.lower().decode("latin-1")
    spans, past = [], dict.fromkeys(KINDS, 0)
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in _keywords().iter(lower))
    for at, kind in hits:
        if at < past[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(lower, at):
                past[kind] = m.end()
                if len(m[2]) >= MIN_VALUE:
                    spans.append((kind, at, m.end()))
        elif kind == "access":
            if m := ACCESS.match(whole, at):
                past[kind] = m.end()
                if m.end() - at >= MIN_ACCESS:
                    spans.append((kind, at, m.end()))
        elif (m := CHECKED.match(whole, at)) and checksum(m[1]) == m[2]:
            past[kind] = m.end()
            spans.append((kind, at, m.end()))
    raw = np.frombuffer(data, np.uint8)
    spans += [("hex", a, b) for a, b in _hex_runs(raw)]
    if spans and not text.isascii():
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        spans = [(k, int(heads[a]), int(heads[b])) for k, a, b in spans]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every whole text.

    Returns one row per input row: id_col, n_assign, n_access, n_hex, n_checked (long), base_sha256 (of the first three
    kinds' spans, `kind:start:end` joined by commas) and spans (all of them, joined likewise; empty if none). A null text
    is as the empty one; repeated rows each get a row; an empty table gives none; other input columns are ignored.
    """

    def make(texts):
        out = []
        for text in texts:
            spans = find_spans(text)
            base = [s for s in spans if s[0] in KINDS[:3]]
            counts = [sum(s[0] == k for s in base) for k in KINDS[:3]]
            out.append((*counts, len(spans) - len(base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        return list(zip(*out))

    fields = {"n_assign": "long", "n_access": "long", "n_hex": "long", "n_checked": "long", "base_sha256": "string", "spans": "string"}
    return map_texts(docs, {id_col: F.col(id_col)}, F.col(text_col).cast("string"), fields, make)
