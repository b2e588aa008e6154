"""Phrase collocations of each language: best-first growth of phrases under admissible bounds from prefix counts.

The score of a phrase is at its lowest cut 2,000,000 * a / (l + r), from its own count a and those of its two parts.
What grows out of a prefix p that begins with the words x occurs at most f(p) times and has a rest at least as frequent as
itself, so none of it can score more than 2,000,000 * f(p) / (f(x) + f(p)): an admissible bound from prefix counts alone.

The best candidates of each language set a cut. The frontier, all prefixes whose bound reaches the cut, is opened by one
count of the corpus a level, in order of the bounds: first all above the cut, and below it only where a language has
fewer surviving phrases above its cut than asked for, with a batch four times as large. When enough survive, every phrase
that reaches the cut, ties included, has been counted, and so has every longer phrase that could suppress one.

Counting: each task hashes words, with their language, to 64 bits with numpy, some million at a time, and adds equal
phrases up before they leave it; Spark adds up the rest. That no two words share a hash is checked on the table of all
words (another seed is taken otherwise), so counts are exact. The first level counts only pairs of frequent words, the others
only phrases in the frontier: such sets go to the tasks as sorted 64-bit keys when they are counted to be small, and are
joined afterwards when they are not. A key that two phrases share lets a phrase too many be counted, and changes none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from loomtext.llm.batches import small_batches, trim
from loomtext.session import materialize, small_side

UNKNOWN = "und"
BLOB, LONG_WORD, HELD = 1 << 20, 1 << 16, 1 << 21
#: Keys that may travel to every task: 16 MB.
MAX_KEYS = 1 << 21
BLANK, BREAK = 0x20, 0x0A
#: Bytes as they are counted: A-Z lower-cased, blanks as one blank, marks and line ends that end a piece as one line end.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else BLANK if b == 9 else BREAK if 0x0A <= b <= 0x0D or b in b".,;:!?" else b for b in range(256))
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)


class Hasher:
    """64-bit hashes of the words of a buffer, eight bytes at a time."""

    def __init__(self, seed: int):
        self.key = str(seed).encode()
        self.start = self.of(b"")

    def of(self, data: bytes) -> np.uint64:
        return _U(int.from_bytes(hashlib.blake2b(data, digest_size=8, key=self.key).digest(), "little"))

    def __call__(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        eight = np.ndarray((len(data),), "<u8", data + bytes(8), strides=(1,))
        left = ends - starts
        out = self.start ^ left.astype(np.uint64)
        words = np.flatnonzero(left <= LONG_WORD)
        at, left = starts[words], left[words]
        while len(words):
            part = eight[at] & _MASKS[np.minimum(left, 8)]
            out[words] = _mix((out[words] ^ part) * _U(0x9E3779B97F4A7C15) + _U(1))
            more = left > 8
            words, at, left = words[more], at[more] + 8, left[more] - 8
        for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            out[k] = self.of(data[starts[k] : ends[k]])
        return out


def phrase_key(words: list[np.ndarray]) -> np.ndarray:
    """One 64-bit key of the words' hashes."""
    key = np.zeros(len(words[0]), np.uint64)
    for w in words:
        key = _mix((key ^ w.view(np.uint64)) * _U(0x9E3779B97F4A7C15) + _U(1))
    return key.view(np.int64)


def _blobs(rows: Iterator[tuple[bytes | None, str]]) -> Iterator[tuple[bytes, list[int], list[str], bool]]:
    """Translated bytes with the offset and language of each text in them, and whether they go on in the last one's text.

    Texts share a blob with a break between them; a longer one is cut behind a blank or break nearest to BLOB bytes.
    """
    held, at, langs, size = [], [], [], 0
    for text, lang in rows:
        data = (text or b"").translate(_TABLE)
        if size and size + len(data) > BLOB:
            yield b"\n".join(held), at, langs, False
            held, at, langs, size = [], [], [], 0
        lo = 0
        while len(data) - lo > BLOB:
            cut = max(data.rfind(b" ", lo, lo + BLOB), data.rfind(b"\n", lo, lo + BLOB))
            if cut < 0:
                ahead = [x for x in (data.find(b" ", lo), data.find(b"\n", lo)) if x >= 0]
                cut = min(ahead, default=len(data) - 1)
            yield data[lo : cut + 1], [0], [lang], lo > 0
            lo = cut + 1
        if lo:
            if lo < len(data):
                yield data[lo:], [0], [lang], True
        elif data:
            held.append(data)
            at.append(size)
            langs.append(lang)
            size += len(data) + 1
    if held:
        yield b"\n".join(held), at, langs, False


class Words:
    """The words of a task's texts, blob by blob: bytes, starts, ends, language codes and running number of the piece."""

    def __init__(self) -> None:
        self.langs: list[str] = []
        self.codes: dict[str, int] = {}
        self.piece = 0

    def read(self, rows) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for data, at, langs, goes_on in _blobs(rows):
            raw = np.frombuffer(data, np.uint8)
            inside = (raw != BLANK) & (raw != BREAK)
            edge = np.diff(inside.view(np.int8), prepend=0, append=0)
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            breaks = np.flatnonzero(raw == BREAK)
            self.piece += not goes_on
            pieces = self.piece + np.searchsorted(breaks, starts)
            self.piece += len(breaks)
            for x in langs:
                if x not in self.codes:
                    self.codes[x] = len(self.langs)
                    self.langs.append(x)
            lang = np.array([self.codes[x] for x in langs], np.int32)[np.searchsorted(at, starts, side="right") - 1]
            if len(starts):
                yield data, starts, ends, lang, pieces

    def hashes(self, hasher: Hasher, data: bytes, starts: np.ndarray, ends: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Hashes of the words with their languages."""
        names = np.array([hasher.of(x.encode()) for x in self.langs], np.uint64)
        return _mix(hasher(data, starts, ends) ^ names[lang]).view(np.int64)


def _sliced(columns: dict[str, pa.Array | np.ndarray], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns.values()], names=list(columns))
    for k in range(0, len(whole), most):
        yield whole.slice(k, most)


def tally(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The place of one row of each group of equal rows, and the groups' sizes; a group whose mixed key another one has may come in parts."""
    key = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = _mix((key ^ c.astype(np.uint64)) * _U(0x9E3779B97F4A7C15) + _U(1))
    order = np.argsort(key)
    new = np.ones(len(order), bool)
    new[1:] = reduce(np.logical_or, (np.diff(c[order]) != 0 for c in columns))
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def _texts(batches) -> Iterator[tuple[bytes | None, str]]:
    for batch in batches:
        yield from zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True)


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, h, word, a): every word of each language with its hash and its count."""
    small_batches(docs.sparkSession)

    def run(batches):
        words, hasher, check = Words(), Hasher(seed), Hasher(seed + 1_000_003)
        held, size = [], 0

        def flush():
            lang, h, h2, blob, starts, ends = (np.concatenate(c) for c in list(zip(*held))[1:])
            # Two words that share a hash stay apart by the second one, to be found out later.
            at, n = tally([h, h2])
            text = pa.array([held[k][0][a:b].decode() for k, a, b in zip(blob[at].tolist(), starts[at].tolist(), ends[at].tolist())], pa.string())
            names = pa.DictionaryArray.from_arrays(pa.array(lang[at], pa.int32()), pa.array(words.langs, pa.string())).dictionary_decode()
            return _sliced({"lang": names, "h": h[at], "word": text, "a": n})

        for data, starts, ends, lang, _ in words.read(_texts(batches)):
            h, h2 = (words.hashes(f, data, starts, ends, lang) for f in (hasher, check))
            held.append((data, lang, h, h2, np.full(len(h), len(held), np.int32), starts.astype(np.int32), ends.astype(np.int32)))
            size += len(h)
            if size >= HELD // 2:
                yield from flush()
                held.clear()
                size = 0
        if held:
            yield from flush()
        trim()

    parts = docs.select("lang", "text").mapInArrow(run, "lang string, h long, word string, a long")
    return parts.groupBy("h", "lang", "word").agg(F.sum("a").alias("a")).select("lang", "h", "word", "a")


def distinct_hashes(words: DataFrame) -> bool:
    """Whether no two words, of one language or of two, share a hash."""
    return words.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()


class Wanted:
    """Phrases of `width` words (w1, w2, ...); as sorted keys in every task if they are few, else for a join."""

    def __init__(self, phrases: DataFrame, width: int):
        self.columns = _w(width)
        self.phrases = phrases.select(*self.columns).distinct()
        self.width = width
        few = phrases.count() <= MAX_KEYS
        self.keys = phrases.sparkSession.sparkContext.broadcast(self._keys()) if few else None

    def release(self) -> None:
        if self.keys is not None:
            self.keys.unpersist()

    def _keys(self) -> np.ndarray:
        columns = self.columns

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(phrase_key([b.column(c).to_numpy() for c in columns]))], names=["key"])

        found = self.phrases.mapInArrow(run, "key long").toArrow().column("key").to_numpy()
        return np.unique(found)

    def among(self, counted: DataFrame, first: int) -> DataFrame:
        """The counted phrases whose words from the `first` on are wanted."""
        here = _w(self.width, first)
        wanted = self.phrases.select(*[F.col(c).alias(h) for c, h in zip(self.columns, here, strict=True)])
        return counted.join(small_side(wanted), here, "left_semi")


def _w(k: int, first: int = 1) -> list[str]:
    return [f"w{x}" for x in range(first, first + k)]


def _within(keys: np.ndarray, key: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(key), bool)
    at = np.searchsorted(keys, key)
    at[at == len(keys)] = 0
    return keys[at] == key


def phrase_counts(docs: DataFrame, seed: int, k: int, wanted: list[tuple[Wanted, int]], every: bool = False, least: int = 30) -> DataFrame:
    """(w1..wk, a): counts of `least` or more of k-word phrases with a wanted part, or with all parts wanted (`every`).

    `wanted` holds sets and the place, from 1, of the phrase's word that their phrases must begin at.
    """
    small_batches(docs.sparkSession)
    sets = [(w.keys, w.width, first - 1) for w, first in wanted]
    local = all(keys is not None for keys, _, _ in sets)

    def emit(piece, h):
        n = len(h) - k + 1
        if n < 1:
            return
        at = np.flatnonzero(piece[:n] == piece[k - 1 :])
        if local:
            parts = [_within(keys.value, phrase_key([h[f + x : f + x + n][at] for x in range(width)])) for keys, width, f in sets]
            at = at[reduce(np.logical_and if every else np.logical_or, parts)]
        if len(at):
            columns = [h[x : x + n][at] for x in range(k)]
            found, counts = tally(columns)
            yield from _sliced({**{c: v[found] for c, v in zip(_w(k), columns, strict=True)}, "a": counts})

    def run(batches):
        words, hasher = Words(), Hasher(seed)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for data, starts, ends, lang, piece in words.read(_texts(batches)):
            held.append((piece, words.hashes(hasher, data, starts, ends, lang)))
            size += len(lang)
            if size >= HELD:
                columns = [np.concatenate(c) for c in zip(*held)]
                yield from emit(*columns)
                # The last k - 1 words have begun no phrase yet.
                held = [tuple(c[len(c) - k + 1 :] for c in columns)] if k > 1 else []
                size = k - 1
        if held:
            yield from emit(*[np.concatenate(c) for c in zip(*held)])
        trim()

    parts = docs.select("lang", "text").mapInArrow(run, ", ".join([*[f"{c} long" for c in _w(k)], "a long"]))
    counted = parts.groupBy(*_w(k)).agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    if not local:
        kept = [w.among(counted, first) for w, first in wanted]
        counted = reduce(lambda x, y: x.join(y.select(*_w(k)), _w(k), "left_semi"), kept) if every else reduce(DataFrame.unionByName, kept).dropDuplicates(_w(k))
    return counted


def score_sql(a: str, parts: str) -> str:
    """floor(2,000,000 * a / parts) in integers, exact beyond 64 bits."""
    return f"((CAST({a} AS DECIMAL(20, 0)) * 2000000BD) div ({parts}))"


def _lowest(*cuts: tuple[str, str]) -> str:
    """(score, k, l, r) of the lowest-scoring cut, of equal ones the first."""
    return "least(" + ", ".join(f"named_struct('score', {score_sql('a', f'{x} + {y}')}, 'k', {k}, 'l', {x}, 'r', {y})" for k, (x, y) in enumerate(cuts, 1)) + ")"


def scored_pairs(counted: DataFrame, words: DataFrame) -> DataFrame:
    """Two-word phrases with l, r, score and bound."""
    both = counted.join(words.select("lang", F.col("h").alias("w1"), F.col("a").alias("l")), "w1").join(words.select(F.col("h").alias("w2"), F.col("a").alias("r")), "w2")
    return both.select("lang", "w1", "w2", "a", "l", "r", F.expr(score_sql("a", "l + r")).alias("score"), F.expr(score_sql("a", "l + a")).alias("bound"))


def scored_triples(counted: DataFrame, pairs: DataFrame) -> DataFrame:
    """Three-word phrases with the counts f1 and f12 of their beginnings, and l, r, score, bound."""
    x = pairs.select("lang", "w1", "w2", F.col("l").alias("f1"), F.col("a").alias("f12"))
    y = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"), F.col("r").alias("f3"))
    both = counted.join(x, ["w1", "w2"]).join(y, ["w2", "w3"])
    both = both.withColumn("x", F.expr(_lowest(("f1", "f23"), ("f12", "f3"))))
    bound = F.expr(f"least({score_sql('a', 'f1 + a')}, {score_sql('a', 'f12 + a')})")
    return both.select("lang", *_w(3), "a", "f1", "f12", "x.l", "x.r", "x.score", bound.alias("bound"))


def _longest_of(longer: DataFrame, k: int) -> DataFrame:
    """(w1..wk, m): the greatest count of the phrases one word longer that begin or end with these words."""
    ends = [longer.select(*[F.col(b).alias(a) for a, b in zip(_w(k), _w(k, first), strict=True)], "a") for first in (1, 2)]
    return ends[0].unionByName(ends[1]).groupBy(*_w(k)).agg(F.max("a").alias("m"))


def _standing(phrases: DataFrame, longer: DataFrame, k: int, share: int) -> DataFrame:
    """The phrases in no longer one that has `share` of a hundred of their count or more. One word more is enough to look at: counts only fall."""
    kept = phrases.join(_longest_of(longer, k), _w(k), "left").where(f"m is null or CAST(m AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {share}")
    none = [F.lit(None).cast("long").alias(c) for c in _w(4)[k:]]
    return kept.select("lang", *_w(k), *none, "a", "l", "r", "score")


def _opened(docs: DataFrame, seed: int, pairs: DataFrame, cuts: DataFrame, least: int, share: int) -> DataFrame:
    """(lang, cut, w1..w4, a, l, r, score): all surviving phrases that reach the cut of their language."""
    cuts = small_side(cuts)
    reach = lambda df, c: df.join(cuts, "lang").where(F.col(c) >= F.col("cut")).drop("cut")
    near_pairs = small_side(pairs)

    def counted(k: int, name: str, *parts: tuple[DataFrame, int, int]) -> DataFrame:
        wanted = [(Wanted(df, width), first) for df, width, first in parts]
        found = materialize(phrase_counts(docs, seed, k, wanted, least=least), name)
        for w, _ in wanted:
            w.release()
        return found

    best2 = reach(pairs, "score")
    triples = counted(3, "triples", (reach(pairs, "bound"), 2, 1), (best2, 2, 2))
    known = materialize(scored_triples(triples, near_pairs), "known")
    front3, best3 = reach(known, "bound"), reach(known, "score")
    fours = counted(4, "fours", (front3, 3, 1), (best3, 3, 2))

    x = front3.select("lang", *_w(3), "f1", "f12", F.col("a").alias("f123"))
    y = near_pairs.select(F.col("w1").alias("w3"), F.col("w2").alias("w4"), F.col("a").alias("f34"), F.col("r").alias("f4"))
    hoped = fours.join(x, _w(3)).join(y, ["w3", "w4"])
    # The first cut's rest may not have been counted yet: it occurs as often as the phrase at least.
    hoped = hoped.withColumn("most", F.expr(f"least({score_sql('a', 'f1 + a')}, {score_sql('a', 'f12 + f34')}, {score_sql('a', 'f123 + f4')})"))
    hoped = materialize(reach(hoped, "most"), "hoped")
    rests = hoped.select(*[F.col(b).alias(a) for a, b in zip(_w(3), _w(3, 2), strict=True)]).distinct()
    open_ = materialize(rests.join(triples, _w(3), "left_anti"), "rests")
    known_rests = triples if open_.isEmpty() else triples.unionByName(counted(3, "more", (open_, 3, 1))).dropDuplicates(_w(3))
    rest = known_rests.select(*[F.col(a).alias(b) for a, b in zip(_w(3), _w(3, 2), strict=True)], F.col("a").alias("f234"))
    best4 = hoped.join(rest, _w(3, 2)).withColumn("x", F.expr(_lowest(("f1", "f234"), ("f12", "f34"), ("f123", "f4"))))
    best4 = reach(best4.select("lang", *_w(4), "a", "x.l", "x.r", "x.score"), "score")

    found = _standing(best2, triples, 2, share).unionByName(_standing(best3, fours, 3, share)).unionByName(best4)
    return materialize(found, "standing")


def _cuts(pairs: DataFrame, size: int, step: int = 1000) -> DataFrame:
    """(lang, cut): a multiple of `step` that at least `size` pairs of the language reach, 0 where there are fewer."""
    steps = pairs.groupBy("lang", F.expr(f"score div {step}").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("b")))
    reached = steps.withColumn("above", above).groupBy("lang").agg(F.max(F.when(F.col("above") >= size, F.col("b") * step)).alias("cut"))
    return materialize(reached.select("lang", F.coalesce("cut", F.lit(0)).cast("long").alias("cut")), "cuts")


def mine(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = 2000, least: int = 30, share: int = 80, batch: int | None = None, seed: int = 1
) -> DataFrame:
    """The `top` collocations of each language.

    Texts (A-Z lower-cased) fall into pieces at `[.,;:!?\\x0A-\\x0D]` and those into words `[^\\x20\\x09]+`. Candidates are
    phrases of 2 to 4 words of one piece that occur `least` times in their language, overlaps included; those are dropped
    whose words lie inside a longer candidate with `share` of a hundred of their count. Returns lang, rank (from 1, by
    score, then count, both falling, then the phrase in byte order), phrase (joined by blanks), the counts a, l and r of
    the phrase and of both parts of its lowest-scoring cut (of equal ones the first), n (all words of the language) and
    score; numbers are long. `batch` is how many of the best pairs open the first frontier (four times `top` if null).
    A null language is `und`, null and empty texts have no words, ties at the last rank are decided by the order above;
    repeated rows count each time; a text of any length is read in parts of 1 MB, only single words longer than that
    whole; languages without candidates and empty tables have no rows; other input columns are ignored.
    """
    base = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    while True:
        words = materialize(word_counts(base, seed), "words")
        if distinct_hashes(words):
            break
        seed += 1
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    words = materialize(words.where(F.col("a") >= least), "frequent")
    frequent = Wanted(words.select(F.col("h").alias("w1")), 1)
    pairs = phrase_counts(base, seed, 2, [(frequent, 1), (frequent, 2)], every=True, least=least)
    pairs = materialize(scored_pairs(pairs, small_side(words)), "pairs")
    frequent.release()

    size, open_, done = batch or 4 * top, pairs, None
    while True:
        cuts = _cuts(open_, size)
        part = base.join(small_side(cuts.select("lang")), "lang", "left_semi")
        found = _opened(part, seed, open_, cuts, least, share)
        enough = cuts.join(found.groupBy("lang").agg(F.count(F.lit(1)).alias("c")), "lang", "left")
        enough = materialize(enough.select("lang", ((F.col("cut") == 0) | (F.coalesce("c", F.lit(0)) >= top)).alias("settled")), "settled")
        here = found.join(small_side(enough.where("settled").select("lang")), "lang", "left_semi")
        done = here if done is None else done.unionByName(here)
        if enough.where("not settled").isEmpty():
            break
        open_ = open_.join(small_side(enough.where("not settled").select("lang")), "lang", "left_semi")
        size *= 4

    named = done
    known = small_side(words.select("h", "word"))
    for c in _w(4):
        named = named.join(known.select(F.col("h").alias(c), F.col("word").alias(f"{c}s")), c, "left")
    named = named.withColumn("phrase", F.concat_ws(" ", *[f"{c}s" for c in _w(4)]))
    # First the best of each part of a language, then the best of those: no task gets all phrases of a language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = named.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(16)))
    some = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "part")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(small_side(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Every phrase counted, every cut scored, every part of every longer candidate compared.
SQL = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?
-
]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^ 	]+') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, w[i:i + k - 1] AS ws, k FROM i, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, ws, any_value(k) AS k, count(*) AS f FROM g GROUP BY lang, ws),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 30),
x AS (SELECT c.lang, c.ws, c.f, j, l.f AS l, r.f AS r, (2000000::HUGEINT * c.f // (l.f + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f l ON l.lang = c.lang AND l.ws = c.ws[:j] JOIN f r ON r.lang = c.lang AND r.ws = c.ws[j + 1:]),
s AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, j) = 1),
b AS (SELECT lang, ws[y:y + z - 1] AS ws, max(f) AS m FROM (SELECT *, unnest(range(1, k + 1)) AS y FROM c), (SELECT unnest([2, 3]) AS z) WHERE y + z - 1 <= k AND z < k GROUP BY ALL),
t AS (SELECT s.lang, array_to_string(s.ws, ' ') AS phrase, s.f AS a, l, r, score FROM s LEFT JOIN b ON b.lang = s.lang AND b.ws = s.ws WHERE m IS NULL OR 100 * m < 80 * s.f),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000"""
