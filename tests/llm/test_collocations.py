"""Collocations against a plain enumeration of all phrases, with small batches so that several frontiers are opened."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from loomtext.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, n int, rank int, phrase string, h long, w1 long, score int"


def table(spark, rows):
    return spark.createDataFrame([(k, t, x, 1, 2, "p", 3, 4, 5) for k, (t, x) in enumerate(rows)], SCHEMA)


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, top, least, share):
    f, n, out = Counter(), Counter(), []
    for text, lang in rows:
        for ws in pieces(text):
            n[lang or "und"] += len(ws)
            f.update((lang or "und", *ws[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(ws) - k + 1))
    cands = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = {(q[0], *q[i:j]) for q, a in cands.items() for i in range(1, len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q) - 1 and 100 * a >= share * f[(q[0], *q[i:j])]}
    kept = {}
    for (lang, *ws), a in cands.items():
        if (lang, *ws) not in gone:
            s, k = min((2_000_000 * a // (f[lang, *ws[:k]] + f[lang, *ws[k:]]), k) for k in range(1, len(ws)))
            kept.setdefault(lang, []).append((-s, -a, " ".join(ws).encode(), f[lang, *ws[:k]], f[lang, *ws[k:]]))
    for lang, found in kept.items():
        for rank, (s, a, p, x, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, x, r, n[lang], -s))
    return sorted(out)


def corpus(seed, words, count, langs):
    rng = random.Random(seed)
    fixed = [[rng.choice(words) for _ in range(rng.randrange(2, 6))] for _ in range(6)]
    rows = []
    for _ in range(count):
        ws = []
        while len(ws) < 30:
            ws += rng.choice(fixed) if rng.random() < 0.4 else [min(rng.choice(words), rng.choice(words))]
        text = "".join(w.title() * (rng.random() < 0.1) or w for w in ws for w in (w, rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\x0b", " (", ") "])))
        rows.append((text, rng.choice(langs)))
    return rows


@pytest.mark.parametrize("top,batch,least", [(3, 4, 5), (10, 1, 3), (500, None, 4)])
def test_equals_brute_force(spark, top, batch, least):
    words = "ab ba a b aa bb ab' é汉 😀 x-y".split()
    rows = corpus(top, words, 60, ["en", "de", None, "und"]) + [(None, "en"), ("", None), ("  \t", "fr"), (".,;", "en"), ("once only", "es")]
    rows += [("tie one tie two tie three", "tt")] * least + [("b a", "bb")] * least  # ties and repeated rows
    got = C.mine(table(spark, rows), top=top, batch=batch, least=least)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", "bigint", "bigint", "bigint", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect())) == brute(rows, top, least, 80)


def test_sets_too_large_for_tasks_are_joined(spark, monkeypatch):
    rows = corpus(8, "p q r s pq qr".split(), 40, ["en", None])
    monkeypatch.setattr(C, "MAX_KEYS", 0)
    assert sorted(map(tuple, C.mine(table(spark, rows), top=8, batch=8, least=4).collect())) == brute(rows, 8, 4, 80)


def test_texts_longer_than_a_part(spark):
    """Phrases across the places where a long text is cut, and words longer than any part."""
    rng = random.Random(2)
    long_text = " ".join(rng.choice(["alpha beta", "beta gamma delta", "x" * 50, "alpha"]) for _ in range(250_000)) + "," + " ".join(["tail words"] * 40)
    giant = "y" * (C.BLOB + 9)
    rows = [(long_text, "en"), (f"{giant} {giant} z {giant}", "en"), (giant + ".a", None), ("q" * 70_000 + " q", "de"), ("short text here", "en")]
    rows += [("q" * 70_000 + " q", "de")] * 3
    assert sorted(map(tuple, C.mine(table(spark, rows), top=50, batch=2, least=2).collect())) == brute(rows, 50, 2, 80)


def test_empty(spark):
    assert C.mine(table(spark, [])).count() == 0 and C.mine(table(spark, [(None, None)])).count() == 0


def test_numbers_past_64_bits(spark):
    df = spark.createDataFrame([(9 * 10**15, 9 * 10**15 + 7, 2 * 10**16), (2**62, 2**62, 2**62 - 1), (30, 31, 10**18)], "a long, l long, r long")
    got = [r[0] for r in df.selectExpr(C.score_sql("a", "l + r")).collect()]
    assert got == [2_000_000 * a // (b + c) for a, b, c in [(9 * 10**15, 9 * 10**15 + 7, 2 * 10**16), (2**62, 2**62, 2**62 - 1), (30, 31, 10**18)]]
    longer = spark.createDataFrame([("x", 1, 2, 3, 2**62)], "lang string, w1 long, w2 long, w3 long, a long").drop("lang")
    short = spark.createDataFrame([("x", 1, 2, 2**62 + 2**60, 1, 1, 1), ("x", 2, 3, 2**62 + 2**60 + 1, 1, 1, 1)], "lang string, w1 long, w2 long, a long, l long, r long, score long")
    assert [r["w1"] for r in C._standing(short, longer, 2, 80).collect()] == [2]


def test_hashes(spark):
    a, b = C.Hasher(1), C.Hasher(2)
    data = b"one two one " + b"z" * 70_000 + b" " + b"y" * 40 + b"a " + b"y" * 40 + b"b"
    starts, ends = (np.array(x) for x in zip(*[m.span() for m in re.finditer(rb"[a-z]+", data)]))
    assert len(set(a(data, starts, ends).tolist())) == 5 and not set(a(data, starts, ends).tolist()) & set(b(data, starts, ends).tolist())
    assert a(data, starts, ends).tolist() == [a(data[x:y], np.array([0]), np.array([y - x]))[0] for x, y in zip(starts, ends)]
    clash = spark.createDataFrame([("en", 5, "x", 1), ("de", 5, "y", 1)], "lang string, h long, word string, a long")
    other = spark.createDataFrame([("en", 5, "x", 1), ("en", 5, "y", 1)], clash.schema)
    assert not C.distinct_hashes(clash) and not C.distinct_hashes(other) and C.distinct_hashes(clash.where("lang = 'en'"))
    cols = [np.array([1, 1, 2, 1]), np.array([7, 7, 7, 8])]
    at, n = C.tally(cols)
    assert sorted(zip(cols[0][at].tolist(), cols[1][at].tolist(), n.tolist())) == [(1, 7, 2), (1, 8, 1), (2, 7, 1)]
