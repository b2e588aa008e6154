"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A text's terms are the beginnings of its words, of five and of seven letters (a shorter word stands whole). Every term
that at least MIN_SHARE of the labelled examples hold counts, whatever their labels; examples and texts are vectors of
term count times log((N + 1) / document frequency), of unit length in double precision. Texts meet all examples many at a
time: the terms that most examples hold by a product of matrices in single precision, the others by posting lists. Every
example whose sum, but for rounding, may be among the k greatest is then scored in double precision, so the neighbours are
exact. Their votes, weighted by squared cosine, with a little of the base rate, give log-odds.

A few words in a long text hardly move its cosine. So the examples also vote word by word: all that hold a beginning of
the word (of three to eight letters, or the word itself; pairs of letters too in scripts without case), down to two
examples. The most toxic beginning speaks for a word, and the log-odds of the three most toxic words, above the base
rate, are added to those of the neighbours. A monotone map fitted on the examples themselves, each scored by the others
without itself, makes the sum a share.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections import Counter
from itertools import repeat
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from loomtext.llm.batches import map_texts, parts
from loomtext.session import materialize

WORD = re.compile(r"[^\W\d_]+")
PLAIN = re.compile(r"\w+")  # quicker; what it finds is a word, unless it has digits or underscores
#: Labelled rows in the index, about; the vocabulary's terms, the rarest going first.
SAMPLE_ROWS = 4096
MAX_TERMS = 1 << 16
#: Least share of the examples that hold a term (two examples at least).
MIN_SHARE = 0.01
KEPT_WORDS = 500_000
NEIGHBOURS = 16
#: Examples that are compared at once (about SAMPLE_ROWS are one block), and texts with them.
BLOCK = 4608
TOGETHER = 256
#: Cells of the matrices of common terms, of four bytes, in each process.
DENSE_CELLS = 1 << 22
PRIOR = 0.2
#: Words whose votes count, votes of the base rate beside theirs, and the longest part of a word that is told apart.
WORDS = 3
PULL = 4.0
LONGEST = 32


#: For each character of Latin-1 its lower case, or a blank where WORD does not match.
LATIN = bytes(ord(c.lower()) if WORD.match(c.lower()) else 32 for c in map(chr, range(256)))


def words_of(text: str | None) -> list[str]:
    """What WORD finds in the lower-cased text."""
    try:
        return (text or "").encode("latin-1").translate(LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        found = PLAIN.findall(text.lower())
    return found if all(map(str.isalpha, found)) else [w for f in found for w in ((f,) if f.isalpha() else WORD.findall(f))]


def terms(text: str | None) -> Counter:
    found: Counter = Counter()
    for word, n in Counter(words_of(text)).items():
        for term in terms_of(word):
            found[term] += n
    return found


def terms_of(word: str) -> tuple[str, ...]:
    return (word[:5], "~" + word[:7]) if len(word) > 5 else (word,)


def stems(word: str) -> list[str]:
    """What the examples vote on for a word: its beginnings, itself, and pairs of letters where the script has no case."""
    found = [word[:LONGEST] + "$", *[word[:k] for k in range(3, min(len(word), 9))]]
    return found + [word[k : k + 2] for k in range(len(word) - 1)] if word == word.upper() else found


def log_odds(p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return math.log(p / (1 - p))


def largest(scores: np.ndarray, k: int, sure: float) -> np.ndarray:
    """Places of the positive scores that may be among the k largest if each can err, `sure` being the least share that two
    equal ones have of one another."""
    least = np.partition(scores, -k)[-k] * sure if len(scores) > k else 0.0
    return np.flatnonzero((scores >= least) & (scores > 0))


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers from each start to before its end, one range after the other."""
    n = end - start
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Met(dict):
    """Numbers of the words met, by which `places` holds their terms' (two a word, -1 for none) and `lean` their leanings."""

    def __init__(self, place: dict[str, int], leaning: dict[str, float]):
        """leaning: of the stems that lean to toxic."""
        super().__init__()
        self.place, self.places, self.lean = place, array("q"), array("d")
        # Beginnings of those stems stand with 0, so that no longer one leans where one is missing.
        self.leaning = {t[:k]: 0.0 for t in leaning if t[-1] != "$" for k in range(3, len(t))} | leaning
        self.longer = {t[1:6] for t in place if t[0] == "~"}
        self.heads: dict[str, tuple[int, float, bool, bool]] = {}

    def head(self, head: str) -> tuple[int, float, bool, bool]:
        """Of the words that go on after these five letters: the place, the leaning, and whether a longer stem or term can hold."""
        most = max(self.leaning.get(head[:k], 0.0) for k in range(3, 6))
        found = self.heads[head] = self.place.get(head, -1), most, head in self.leaning, head in self.longer
        return found

    def __missing__(self, word: str) -> int:
        size, get = len(word), self.leaning.get
        whole = get(word[:LONGEST] + "$", 0.0)
        if size > 5:
            place, most, stem, term = self.heads.get(word[:5]) or self.head(word[:5])
            self.places.append(place)
            self.places.append(self.place.get("~" + word[:7], -1) if term else -1)
            if stem:
                for k in range(6, min(size, 9)):
                    x = get(word[:k])
                    if x is None:
                        break
                    most = max(most, x)
        else:
            self.places.extend((self.place.get(word, -1), -1))
            most = max((get(word[:k], 0.0) for k in range(3, size)), default=0.0)
        if not word.isascii() and word == word.upper():  # a script without case
            most = max(most, *map(get, map(add, word, word[1:]), repeat(0.0)), 0.0)
        self.lean.append(max(most, whole))
        found = self[word] = len(self)
        return found

    def forget(self) -> None:
        self.clear()
        self.heads.clear()
        del self.places[:], self.lean[:]


class NeighbourIndex:
    """Unit TF-IDF vectors of labelled examples.

    The examples' terms and counts travel. A task's process makes of them, a block of examples each, a matrix of the
    counts of the terms that most examples hold, as many as DENSE_CELLS allow, and posting lists of the others' weights.
    """

    def __init__(self, df: dict[str, int], n: int, examples: list[tuple[int, int, dict[int, int]]], base: float, block: int = BLOCK, votes: dict[str, tuple[int, int]] | None = None, cells: int = DENSE_CELLS):
        """df: document frequencies of the vocabulary among n examples, which are (id, label, counts by place in sorted(df)).
        votes: by stem, how many examples hold it and how many of these are toxic. cells: those of the matrices, at most."""
        held = np.array([df[t] for t in sorted(df)], np.float64)
        self.place = {t: k for k, t in enumerate(sorted(df))}
        self.idf = np.log((n + 1) / held)
        self.block, self.blocks, self.base, self.map = block, -(-len(examples) // block), base, (np.zeros(0), np.zeros(0))
        self.votes = votes or {}
        examples = sorted(examples, key=lambda e: e[:2])  # an id may come with several texts
        self.ids = np.array([i for i, _, _ in examples], np.int64)
        self.labels = np.array([y for _, y, _ in examples], np.int64)
        self.ends = np.cumsum([0] + [len(c) for _, _, c in examples])  # example e has the terms from ends[e] to ends[e + 1]
        self.term = np.fromiter((t for _, _, c in examples for t in sorted(c)), np.int32, self.ends[-1])
        self.count = np.fromiter((c[t] for _, _, c in examples for t in sorted(c)), np.int64, self.ends[-1])
        weight = self.count * self.idf[self.term]
        self.norm = np.sqrt(np.bincount(np.repeat(np.arange(len(examples)), np.diff(self.ends)), weight * weight, len(examples)))
        #: The terms of the matrices: those that most examples hold, but for counts that single precision can't tell.
        held[self.term[self.count >= 1 << 24]] = 0
        most = np.argsort(-held, kind="stable")[: cells // max(1, len(examples))]
        self.common = np.sort(most[held[most] > 0])
        self.remember()

    def remember(self) -> None:
        leaning = {t: self.leaning(*held) for t, held in self.votes.items()}
        self.met = Met(self.place, {t: x for t, x in leaning.items() if x > 0})
        self.column, self.tables = np.full(len(self.idf), -1), []
        self.column[self.common] = np.arange(len(self.common))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("met", "column", "tables")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.remember()

    def table(self, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The matrix of block b (a row an example), and the posting lists of its other terms: borders, rows, weights."""
        while len(self.tables) <= b:
            first = len(self.tables) * self.block
            ends = self.ends[first : first + self.block + 1]
            own = slice(ends[0], ends[-1])
            row, term, count = np.repeat(np.arange(len(ends) - 1), np.diff(ends)), self.term[own], self.count[own]
            at = self.column[term]
            matrix = np.zeros((len(ends) - 1, len(self.common)), np.float32)
            matrix[row[at >= 0], at[at >= 0]] = count[at >= 0]
            row, term, count = row[at < 0], term[at < 0], count[at < 0]
            order = np.argsort(term, kind="stable")
            row, term, count = row[order], term[order], count[order]
            self.tables.append((matrix, np.searchsorted(term, np.arange(len(self.idf) + 1)), row, count * self.idf[term] / self.norm[row + first]))
        return self.tables[b]

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray, float]:
        """Sorted places of the vocabulary's terms in a text, their counts, and what its words add to the log-odds."""
        if len(self.met) >= KEPT_WORDS:
            self.met.forget()
        words = words_of(text)
        own = np.fromiter(map(self.met.__getitem__, words), np.int64, len(words))
        # The arrays must not be viewed when they grow with the next text.
        at, n = np.unique(np.frombuffer(self.met.places, np.int64).reshape(-1, 2)[own], return_counts=True)
        lean = np.frombuffer(self.met.lean)[own]
        _, toxic = np.unique(own[lean > 0], return_index=True)
        known = np.searchsorted(at, 0)
        return at[known:], n[known:], self.words_add(lean[lean > 0][toxic].tolist())

    def leaning(self, n: int, ones: int) -> float:
        """Log-odds above the base rate of a stem that n examples hold, of which so many are toxic; at least 0."""
        if n < 2 or not ones:
            return 0.0
        return max(0.0, math.log((ones + PULL * self.base) / (n - ones + PULL * (1 - self.base))) - log_odds(self.base))

    def leaning_without(self, word: str, y: int) -> float:
        """That of a word by its most toxic stem, an example of the label y that has the word not voting."""
        held = [self.votes[t] for t in stems(word) if t in self.votes]
        return max([self.leaning(n - 1, ones - y) for n, ones in held], default=0.0)

    @staticmethod
    def words_add(leanings) -> float:
        return math.fsum(heapq.nlargest(WORDS, leanings))

    def vector(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted places of the terms and their weights, of unit length; a term that all examples hold may weigh nothing."""
        order = np.argsort(at)
        at, x = at[order], n[order] * self.idf[at[order]]
        norm = np.sqrt((x * x).sum())
        return (at, x / norm) if norm > 0 else (at[:0], x[:0])

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[list[tuple[int, float, int]]]:
        """For each vector (id, cosine, label) of the k nearest examples with a positive cosine; of equal ones the smaller id
        is nearer. Cosines in single precision only tell which examples are scored in double."""
        return [f for start in range(0, len(vectors), TOGETHER) for f in self._nearest(vectors[start : start + TOGETHER], k)]

    def _nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[int, float, int]]]:
        # No weight is negative, so a single-precision sum errs by a share of itself: a rounding for each of its terms, and
        # some for the weights and their products.
        sure = 1 - 2 * (len(self.common) + 16) * 2.0**-24
        asked = np.zeros((len(vectors), len(self.common)), np.float32)
        split = []
        for q, (at, x) in enumerate(vectors):
            c = self.column[at]
            held = c >= 0
            split.append((c[held], x[held] * self.idf[at[held]], at[~held], x[~held]))
            asked[q, split[q][0]] = split[q][1]
        with np.errstate(divide="ignore"):
            scale = np.where(self.norm > 0, 1 / self.norm, 0.0)
        near: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in vectors]
        for b in range(self.blocks):
            matrix, borders, rows, weights = self.table(b)
            own_scale = scale[b * self.block : b * self.block + len(matrix)]
            product = asked @ matrix.T
            for q, (c, cx, at, x) in enumerate(split):
                start, end = borders[at], borders[at + 1]
                own = ranges(start, end)
                rest = np.bincount(rows[own], weights[own] * np.repeat(x, end - start), len(matrix))
                e = largest(product[q] * own_scale + rest, k, sure)
                # The same order of summing for every row: equal examples are equally near.
                near[q].append((e + b * self.block, (matrix[e[:, None], c] * cx).sum(axis=1) * own_scale[e] + rest[e]))
        out = []
        for found in near:
            e, s = (np.concatenate(a) for a in zip(*found, strict=True)) if len(found) > 1 else found[0] if found else (np.empty(0, np.int64), np.empty(0))
            order = np.lexsort((self.ids[e], -s))[:k]
            e = e[order]
            out.append(list(zip(self.ids[e].tolist(), s[order].tolist(), self.labels[e].tolist(), strict=True)))
        return out

    def raw(self, neighbours: list[tuple[int, float, int]], added: float = 0.0) -> float:
        """Log-odds of the share of toxic votes, each of the weight of its squared cosine, the base rate having PRIOR votes
        more; `added` is what the words add."""
        total = sum(s * s for _, s, _ in neighbours)
        return log_odds((sum(s * s * y for _, s, y in neighbours) + PRIOR * self.base) / (total + PRIOR)) + added

    def score(self, neighbours: list[tuple[int, float, int]], added: float = 0.0) -> float:
        """The calibrated share; the base rate with neither neighbours nor words that add."""
        if not (neighbours or added) or not len(self.map[0]):
            return self.base
        return float(min(max(np.interp(self.raw(neighbours, added), *self.map), 0.0), 1.0))

    def nbytes(self) -> int:
        """Bytes of the arrays that travel with the tasks; the votes, two numbers a stem, come beside them."""
        return sum(a.nbytes for a in (self.idf, self.ids, self.labels, self.ends, self.term, self.count, self.norm, self.common))


def rising_map(raw: np.ndarray, y: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Points of the monotone map from raw scores to shares of ones: pooled adjacent groups, drawn to the base by one vote."""
    groups: list[list[float]] = []  # raw sum, ones, rows
    share = lambda g: (g[1] + base) / (g[2] + 1)
    for k in np.lexsort((-y, raw)):
        groups.append([raw[k], y[k], 1.0])
        while len(groups) > 1 and share(groups[-2]) >= share(groups[-1]):
            last = groups.pop()
            groups[-1] = [a + b for a, b in zip(groups[-1], last, strict=True)]
    return np.array([g[0] / g[2] for g in groups]), np.array([share(g) for g in groups])


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE_ROWS, k: int = NEIGHBOURS, block: int = BLOCK
) -> NeighbourIndex:
    """The index of the labelled rows of docs: labels (id_col, label_col 0 or 1) joined on the id.

    At most about `sample` rows are used: with more, those whose hashed id falls under the fraction wanted. Term counts
    and votes are summed by Spark. What reaches the driver is the vocabulary, of at most MAX_TERMS terms, the examples'
    counts of them, about 16 bytes for each term of each example, and the stems of two examples or more that lean to
    toxic, at most MAX_TERMS of those that most toxic examples hold. Null ids and labels teach nothing; of several labels for an id
    the greatest holds; rows with equal ids and texts are one example; a labelled row without a term is an example that
    nothing is near; no labelled rows give an index without examples; other columns are ignored.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    known = base.select("id").join(marks, "id").groupBy().agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if known > sample:
        marks = marks.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(sample / known * (1 << 30)))

    def split(batches):
        for pdf in parts(batches):
            found = [terms(t) for t in pdf["text"]]
            words = [list(dict.fromkeys(words_of(t))) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "words": words, "terms": [list(c) for c in found], "tf": [list(c.values()) for c in found]})

    rows = materialize(base.join(marks, "id").mapInPandas(split, "id long, y int, words array<string>, terms array<string>, tf array<int>").dropDuplicates(["id", "words", "terms", "tf"]), "examples")
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n:
        return NeighbourIndex({}, 0, [], 0.0)
    seen = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= max(2, MIN_SHARE * n))
    df = {r["t"]: r["df"] for r in seen.orderBy(F.desc("df"), "t").limit(MAX_TERMS).collect()}
    place = {t: k for k, t in enumerate(sorted(df))}

    def known_terms(batches):
        for pdf in batches:
            pairs = [[(place[t], int(c)) for t, c in zip(ts, cs, strict=True) if t in place] for ts, cs in zip(pdf["terms"], pdf["tf"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "words": pdf["words"], "terms": [[t for t, _ in p] for p in pairs], "tf": [[c for _, c in p] for p in pairs]})

    def all_stems(batches):
        for pdf in batches:
            for y, words in zip(pdf["y"], pdf["words"], strict=True):
                yield pd.DataFrame({"stem": list(set().union(*map(stems, words)))}, dtype=object).assign(y=y)

    kept = materialize(rows.mapInPandas(known_terms, "id long, y int, words array<string>, terms array<int>, tf array<int>"), "counts")
    votes = rows.mapInPandas(all_stems, "stem string, y int").groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"))
    votes = votes.where(f"n >= 2 AND ones * {n} > {ones} * (n - 1)").orderBy(F.desc("ones"), "n", "stem").limit(MAX_TERMS)
    votes = {r["stem"]: (r["n"], r["ones"]) for r in votes.collect()}
    examples = [(r["id"], r["y"], dict(zip(r["terms"], r["tf"], strict=True))) for r in kept.select("id", "y", "terms", "tf").collect()]
    index = NeighbourIndex(df, n, examples, ones / n, block, votes)
    held = docs.sparkSession.sparkContext.broadcast(index)

    def without_itself(batches):
        own = held.value
        for pdf in batches:
            found = own.nearest([own.vector(ts.astype(np.int64), cs) for ts, cs in zip(pdf["terms"], pdf["tf"], strict=True)], k + 1)
            others = [[x for x in f if x[0] != i][:k] for i, f in zip(pdf["id"], found, strict=True)]
            added = [own.words_add(own.leaning_without(w, y) for w in words) for y, words in zip(pdf["y"], pdf["words"], strict=True)]
            yield pd.DataFrame({"y": pdf["y"], "raw": [own.raw(f, a) if f or a else None for f, a in zip(others, added, strict=True)]})

    tried = kept.mapInPandas(without_itself, "y int, raw double").where("raw is not null").collect()
    index.map = rising_map(np.array([r["raw"] for r in tried]), np.array([r["y"] for r in tried], np.float64), index.base)
    return index


def score(docs: DataFrame, index: NeighbourIndex, id_col: str = "doc_id", text_col: str = "text", k: int = NEIGHBOURS) -> DataFrame:
    """Scores of every whole text.

    Returns one row per input row: id_col, score (0 to 1), predicted (1 if score >= 0.5) and evidence (the nearest
    examples as structs of id, cosine and label, nearest first, ties by id). A null or empty text, or one without a
    vocabulary term, has no neighbours and, if no word of it leans to toxic, the base rate as its score; a text of any length is one vector; repeated rows
    each get a row; an empty table gives none; other columns, whatever their names, are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(index)

    def make(texts):
        own = held.value
        read = [own.read(t) for t in texts]
        found = own.nearest([own.vector(at, n) for at, n, _ in read], k)
        return [own.score(f, added) for f, (_, _, added) in zip(found, read, strict=True)], [[{"id": i, "cosine": c, "label": y} for i, c, y in f] for f in found]

    fields = {"score": "double", "evidence": "array<struct<id:long,cosine:double,label:int>>"}
    done = map_texts(docs, {id_col: F.col(id_col)}, F.col(text_col).cast("string"), fields, make)
    return done.select(id_col, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
