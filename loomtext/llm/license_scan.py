"""License scans: ordered signature rules gated by keywords, with containment deciding between overlapping detections.

A text becomes its lower-cased words between single blanks. One Aho-Corasick pass finds the keywords of all rules, each
at the start of a word; a rule's expression is only tried where its keyword stands. A detection that lies within another
one of a better priority, or within a longer or earlier-listed one of the same, is suppressed; base phrases never are.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from loomtext.llm.batches import map_texts
from loomtext.llm.license_rules import CONFIDENCE, RULES, Rule

#: Bytes as they stand in the words: A-Z lower-cased, all that is no letter, digit or part of a longer character a blank.
_TO_WORD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

DETECTIONS = "array<struct<label:string,start:long,end:long,priority:int,base:boolean>>"


class _Compiled:
    def __init__(self, rules: Sequence[Rule]):
        import ahocorasick

        self.rules = rules
        self.expressions = [re.compile(f" (?:{r.expression})(?= )") for r in rules]
        gated: dict[str, list[int]] = {}
        for k, r in enumerate(rules):
            if len(r.keyword) < 3:
                raise ValueError(f"the expression {r.expression!r} does not begin with a keyword")
            gated.setdefault(" " + r.keyword, []).append(k)
        self.keywords = ahocorasick.Automaton()
        for word, which in gated.items():
            self.keywords.add_word(word, (len(word), tuple(which)))
        self.keywords.make_automaton()


@lru_cache(maxsize=4)
def _compiled(rules: tuple[Rule, ...]) -> _Compiled:
    return _Compiled(rules)


def words_of(text: str | None) -> tuple[str, np.ndarray]:
    """The words of the text with a blank before, between and after them (one character a UTF-8 byte), and the place of each word's blank."""
    raw = np.frombuffer(b" " + (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORD) + b" ", np.uint8)
    blank = raw == 0x20
    kept = raw[~blank | np.append(True, ~blank[:-1])]
    return kept.tobytes().decode("latin-1"), np.flatnonzero(kept[:-1] == 0x20)


def unsuppressed(found: list[tuple[int, int, int]], rules: Sequence[Rule]) -> list[tuple[int, int, int]]:
    """Of detections (start, end, rule) those that no other one suppresses, by start, then longest first, then in the order of rules."""
    kept: list[tuple[int, int, int]] = []
    reach: dict[int, int] = {}  # farthest end so far for each priority: all of these start no later
    for start, end, k in sorted(found, key=lambda d: (d[0], -d[1], rules[d[2]].priority, d[2])):
        mine = rules[k].priority
        covered = any(p <= mine and e >= end for p, e in reach.items())
        reach[mine] = max(end, reach.get(mine, 0))
        if rules[k].base or not covered:
            kept.append((start, end, k))
    return kept


def detect(text: str | None, rules: tuple[Rule, ...] = RULES) -> tuple[int, list[tuple[int, int, int]]]:
    """The number of words, and the detections (first word, word after the last, rule) that stand."""
    made = _compiled(rules)
    line, starts = words_of(text)
    if not len(starts):
        return 0, []
    found = []
    for last, (n, which) in made.keywords.iter(line):
        at = last + 1 - n
        for k in which:
            if m := made.expressions[k].match(line, at):
                found.append((at, m.end(), k))
    if not found:
        return len(starts), []
    spans = np.array([(a, b) for a, b, _ in found])
    first, after = np.searchsorted(starts, spans[:, 0]), np.searchsorted(starts, spans[:, 1])
    return len(starts), unsuppressed([(int(a), int(b), d[2]) for a, b, d in zip(first, after, found, strict=True)], rules)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """License signatures in every whole text.

    Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` with A-Z lower-cased. Returns one row per input row: id_col,
    n_words (long) and detections, an array of (label, start, end, priority, base) in words from 0, end exclusive, by
    start and then longest first; overlapping detections of which none holds the other all stay. A null text is as the
    empty one and has no words; a text of marks alone has none; the work on a long text grows with its length and its
    keyword hits; equal rows give equal rows; an empty table gives none; a null id stays; other input columns are ignored.
    """

    def make(texts):
        out = []
        for text in texts:
            n, found = detect(text, rules)
            out.append((n, [{"label": rules[k].label, "start": a, "end": b, "priority": rules[k].priority, "base": rules[k].base} for a, b, k in found]))
        return list(zip(*out))

    return map_texts(docs, {id_col: F.col(id_col)}, F.col(text_col).cast("string"), {"n_words": "long", "detections": DETECTIONS}, make)


def confidence(detections: Column) -> Column:
    """The confidence of the best detection, 0 if there is none."""
    best = F.array_min(F.transform(detections, lambda d: d["priority"]))
    score = F.lit(0.0)
    for priority, value in CONFIDENCE.items():
        score = F.when(best == priority, F.lit(value)).otherwise(score)
    return score


def summary(docs: DataFrame, **options) -> DataFrame:
    """scan() as counts and labels: n_base, first_word and last_word of the base phrases, base_labels, labels, score (0 to 1)."""
    base = F.filter("detections", lambda d: d["base"])
    starts = F.transform(base, lambda d: d["start"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda d: d["label"]))), ",")
    return scan(docs, **options).withColumns({
        "n_base": F.size(base).cast("long"), "first_word": F.array_min(starts), "last_word": F.array_max(starts),
        "base_labels": labels(base), "labels": labels(F.col("detections")), "score": confidence(F.col("detections")),
    }).drop("detections")
