"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point alone. A trigram's vector binds (multiplies)
its letters' vectors, the first rotated by two places and the second by one; a document's vector bundles (adds) those of
its trigrams, with each word bounded by a blank. A language's prototype bundles the unit vectors of its training
documents. A document's language is the prototype of greatest cosine.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loomtext.llm.batches import map_texts, parts, small_batches

DIM = 1024
TRAIN_ROWS = 40_000
UNKNOWN = "und"
_BLANK = 32
_BLOCK = 128


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point to lower-case letter, or blank, for the basic plane."""
    table = np.full(1 << 16, _BLANK, np.uint32)
    for c in range(1 << 16):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def letters(text: str | None) -> np.ndarray:
    """Lower-cased letters of the text with one blank between and around words; empty if there is no letter."""
    if not text:
        return np.empty(0, np.uint32)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.where(codes < 1 << 16, _letters()[codes & 0xFFFF], codes)
    for k in np.flatnonzero(codes >= 1 << 16):
        low[k] = codes[k] if chr(codes[k]).isalpha() else _BLANK
    low = np.concatenate([[_BLANK], low, [_BLANK]]).astype(np.uint32)
    low = low[~((low == _BLANK) & (np.concatenate([[0], low[:-1]]) == _BLANK))]
    return low if len(low) > 1 else low[:0]


def letter_vectors(codes: np.ndarray, dim: int) -> np.ndarray:
    """A +1/-1 vector for each code point: signs of mixed counters, the same wherever they are made."""
    words = (dim + 63) // 64
    x = codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(s))) * np.uint64(m)
    bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8).reshape(len(codes), -1), axis=1)[:, :dim]
    return (bits.astype(np.float32) * 2 - 1).astype(np.float32)


def document_vectors(texts, dim: int) -> np.ndarray:
    """Bundled trigram vectors, one row a text (zeros where it has no letter), exact integers below 2**24."""
    low = [letters(t) for t in texts]
    grams = []
    for x in low:
        x = x.astype(np.uint64)
        grams.append((x[:-2] << np.uint64(42)) | (x[1:-1] << np.uint64(21)) | x[2:] if len(x) > 2 else x[:0])
    every = np.concatenate(grams) if grams else np.empty(0, np.uint64)
    if not len(every):
        return np.zeros((len(low), dim), np.float32)
    known, at = np.unique(every, return_inverse=True)
    owner = np.repeat(np.arange(len(low)), [len(g) for g in grams])
    out = np.zeros((len(low), dim), np.float32)
    mask = np.uint64((1 << 21) - 1)
    for k in range(0, len(known), 4096):
        part = known[k : k + 4096]
        alphabet, where = np.unique(np.stack([part >> np.uint64(42), (part >> np.uint64(21)) & mask, part & mask]), return_inverse=True)
        where = where.reshape(3, -1)
        v = letter_vectors(alphabet, dim)
        bound = np.roll(v, 2, axis=1)[where[0]] * np.roll(v, 1, axis=1)[where[1]] * v[where[2]]
        inside = (at >= k) & (at < k + len(part))
        counts = np.bincount(owner[inside] * len(part) + (at[inside] - k), minlength=len(low) * len(part)).reshape(len(low), len(part))
        out += counts.astype(np.float32) @ bound
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dim: int = DIM, rows: int = TRAIN_ROWS) -> dict[str, list[float]]:
    """Prototypes (unit vectors) by language from the labelled rows of docs.

    At most about `rows` of them are used: with more, those whose hashed id falls under the fraction wanted. Rows with a
    null language, a null id or no letter teach nothing. Partial sums are made in the tasks and added up by Spark; what
    comes back is one vector a language.
    """
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and id is not null")
    small_batches(docs.sparkSession)
    total = marked.count()
    if total > rows:
        marked = marked.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(rows / total * (1 << 30)))

    def sums(batches):
        held: dict[str, np.ndarray] = {}
        for part in parts(batches, _BLOCK):
            v = document_vectors(part["text"], dim).astype(np.float64)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            for lang, at in part.groupby("lang").indices.items():
                held[lang] = held.get(lang, 0) + v[at].sum(axis=0)
        if held:
            yield pd.DataFrame({"lang": list(held), "v": list(held.values())})

    summed = marked.select("text", "lang").mapInPandas(sums, "lang string, v array<double>")
    added = summed.select("lang", F.posexplode("v").alias("p", "x")).groupBy("lang", "p").agg(F.sum("x").alias("x"))
    found: dict[str, list[float]] = {}
    for row in added.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("v")).collect():
        v = np.array([x["x"] for x in row["v"]])
        if norm := np.linalg.norm(v):
            found[row["lang"]] = (v / norm).tolist()
    return found


def predict(docs: DataFrame, prototypes: dict[str, list[float]], id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """id_col, the columns of keep, lang_pred and score (cosine with the best prototype, 0 to 1), one row per input row.

    A text that is null or has no letter is `und` with score 0, as is every text if no language was learned; ties go to
    the first language in alphabetical order; repeated rows each get a row; an empty table gives none.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float32)

    def make(texts):
        if not names:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        v = document_vectors(texts, matrix.shape[1])
        norm = np.linalg.norm(v.astype(np.float64), axis=1)
        cos = (v @ matrix.T) / np.maximum(norm, 1e-9)[:, None]
        best = cos.argmax(axis=1)
        langs = [names[b] if n else UNKNOWN for b, n in zip(best, norm, strict=True)]
        return langs, [float(min(max(cos[k, b], 0.0), 1.0)) if norm[k] else 0.0 for k, b in enumerate(best)]

    kept = docs.select(F.col(id_col), *(keep or []))
    exprs = {name: c for name, c in zip(kept.columns, [F.col(id_col), *(keep or [])], strict=True)}
    return map_texts(docs, exprs, F.col(text_col).cast("string"), {"lang_pred": "string", "score": "double"}, make, rows=_BLOCK)
