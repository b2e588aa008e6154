"""MinHash, line dedup, decontamination and embeddings against brute force, with nulls, ties, empty tables and clashing columns."""

import math
import random
import re

import numpy as np
import pytest

from loomtext.llm import decontam, embed_dedup, line_dedup, minhash

from .conftest import sentence


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def near_rows():
    rng = random.Random(5)
    rows, at = [], 0
    for group in range(12):
        base = sentence(rng, rng.randrange(30, 90)).split()
        for _ in range(rng.randrange(1, 14)):
            w = list(base)
            for _ in range(rng.randrange(0, 9)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            rows.append((at, " ".join(w)))
            at += rng.randrange(1, 4)
    return rows + [(900, None), (901, ""), (902, " \n\t"), (903, "two words"), (904, "Two  WORDS"), (905, "É accent"), (906, "é accent"), (903, "two words"), (None, rows[0][1]), (None, None)]


@pytest.mark.parametrize("block", [minhash.BLOCK, 3])
def test_minhash_against_brute_force(docs, block):
    rows = near_rows()
    got = minhash.near_components(docs(rows), width=4, block=block).collect()
    assert len(got) == len(rows)
    sets = {i: shingle_set(t, 4) for i, t in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (want[r["doc_id"]], len(sets[r["doc_id"]]), want[r["doc_id"]] == r["doc_id"])
    assert want[904] == 903 and want[906] == 906
    (named,) = [r for r in got if r["doc_id"] is None and r["n_shingles"]]
    assert named["component_id"] == want[rows[0][0]] and not named["kept"]


def test_minhash_links_that_no_leader_has(docs):
    """Many different texts around one passage, so that they share bands, some with a near copy beyond their leader."""
    rng = random.Random(11)
    passage, rows = sentence(rng, 60), []
    for k in range(60):
        own = sentence(rng, 30)
        rows.append((k, f"{passage} {own}"))
        if k % 3 == 0:
            rows.append((1000 + k, f"{passage} {own} {sentence(rng, 6)}"))
    sets = {i: shingle_set(t, 1) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    for block in (minhash.BLOCK, 4):
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_components(docs(rows), width=1, block=block).collect()}
        assert got == want


def test_minhash_empty(docs):
    assert minhash.near_components(docs([])).count() == 0
    assert minhash.near_components(docs([(1, None)])).collect()[0]["kept"]


def test_minhash_estimate_is_near():
    rng = random.Random(1)
    base = [sentence(rng, 1) for _ in range(400)]
    a = minhash.shingles(" ".join(base), 1)
    b = minhash.shingles(" ".join(base[100:] + [sentence(rng, 1) + "x" for _ in range(100)]), 1)
    same = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    (_, x), (_, y) = minhash.signature(a), minhash.signature(b)
    lanes = [((int(p) & (2**64 - 1)) >> (4 * k)) & 15 for p in x for k in range(16)], [((int(p) & (2**64 - 1)) >> (4 * k)) & 15 for p in y for k in range(16)]
    share = sum(p == q for p, q in zip(*lanes)) / 192
    assert abs((share - 1 / 16) / (15 / 16) - same) < 0.15


def brute_lines(rows, least=5):
    seen, firsts = [], {}
    for i, t in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, line in enumerate(t.split("\n")):
            w = tuple(x for x in re.split(r"[ \t\r\f\v]+", line.lower()) if x)
            if w and w not in firsts:
                firsts[w] = (i, k)
                seen.append(w)

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < least:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    gone = {w for n, w in enumerate(seen) if any(near(w, v) for v in seen[:n])}
    out = {}
    for i, t in rows:
        if t is not None:
            kept = []
            for k, line in enumerate(t.split("\n")):
                w = tuple(x for x in re.split(r"[ \t\r\f\v]+", line.lower()) if x)
                if not w or (w not in gone and firsts[w] == (i, k)):
                    kept.append(line)
            out[i, t] = "\n".join(kept)
    return out


def test_line_dedup_against_brute_force(docs):
    rng = random.Random(9)
    pool = [sentence(rng, rng.randrange(4, 12)) for _ in range(25)]
    rows = []
    for i in range(30):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            w = rng.choice(pool).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                what, at = rng.randrange(3), rng.randrange(len(w))
                w = w[:at] + (["new"] if what < 2 else []) + w[at + (what != 1) :]
            lines.append("  ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
        rows.append((i, "\n".join(lines)))
    rows += [(54, "short\n}\n\u00e9\n  }"), (55, "Short \n}\n\n \t\nshort line"), (56, "\u65e5\u672c\u8a9e\n\n"), (57, "\u65e5\u672c\u8a9e"), (58, "}\n" * 400 + "tail")]
    rows += [(50, None), (51, ""), (52, "\n\n"), rows[3], (None, pool[0] + " tail"), (53, " ".join(pool[1] for _ in range(300)))]
    want = brute_lines(rows)
    clashing = docs(rows).selectExpr("*", "1 AS __id", "2 AS __th", "3 AS drops", "4 AS n_removed", "5 AS `a.b`")
    got = line_dedup.dedup_lines(clashing).collect()
    assert len(got) == len(rows)
    left = sorted((str(r["doc_id"]), r["text"]) for r in got if r["text"] is not None)
    assert left == sorted((str(i), want[i, t]) for i, t in rows if t is not None)
    assert all(r["n_lines"] == 0 for r in got if r["text"] is None)


def test_line_dedup_empty(docs):
    assert line_dedup.dedup_lines(docs([])).count() == 0


def test_decontamination(spark, docs):
    rng = random.Random(2)
    items = [(k, sentence(rng, n)) for k, n in enumerate([15, 22, 40, 60])] + [(None, sentence(rng, 20)), (8, None), (9, "too short"), (10, sentence(rng, 10)), (11, sentence(rng, 11)), (12, sentence(rng, 6))]
    clean = [(i, sentence(rng, 80)) for i in range(20)]

    def planted(text, changes):
        w = text.split()
        for at in rng.sample(range(len(w)), changes):
            w[at] = "changed" + str(at)
        return sentence(rng, 30) + ". " + ", ".join(w).upper() + "\n" + sentence(rng, 10)

    dirty = [(100 + k, planted(t, c)) for k, (t, c) in enumerate([(items[0][1], 0), (items[1][1], 2), (items[2][1], 6), (items[3][1], 9), (items[4][1], 0)])]
    dirty += [(111, planted(items[7][1], 2)), (112, planted(items[8][1], 0)), (113, planted(items[9][1], 0))]
    dirty += [(110, " ".join(items[3][1].split()[10:32])), dirty[0], (None, dirty[1][1])]
    odd = [(200, None), (201, ""), (202, "too short"), (204, planted(items[9][1], 1)), (205, " ".join(items[7][1].split()[:9])), (203, ("long " + sentence(rng, 5) + " ") * 3000)]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS w", "2 AS it")
    rows = clean + dirty + odd
    found = {r["id"] for r in decontam.contaminated(docs(rows), bench).collect()}
    assert found == {100, 101, 102, 103, 104, 110, 111, 112, 113, None}
    left = decontam.decontaminate(docs(rows).selectExpr("*", "1 AS __id", "3 AS hits", "4 AS `a.b`"), bench).select("doc_id").collect()
    assert sorted(r[0] for r in left) == [i for i, _ in clean] + [200, 201, 202, 203, 204, 205]
    assert decontam.contaminated(docs([]), bench).count() == 0
    assert decontam.contaminated(docs(rows), bench.where("false")).count() == 0


def test_decontamination_recall_at_the_bound(spark, docs):
    """Passages with a fifth of their tokens substituted at random places: nine in ten are found at every length."""
    rng = random.Random(11)
    items, rows = [], []
    for n in (12, 15, 20, 30, 50):
        for _ in range(120):
            item = sentence(rng, n).split()
            copy = list(item)
            for at in rng.sample(range(n), n // 5):
                copy[at] = f"other{rng.randrange(10**6)}"
            items.append((len(items), " ".join(item)))
            rows.append((len(rows), sentence(rng, 25) + " " + " ".join(copy) + " " + sentence(rng, 25)))
    found = {(r["id"], r["item"]) for r in decontam.contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found <= {(k, k) for k in range(len(rows))}
    for n, lo in zip((12, 15, 20, 30, 50), range(0, 600, 120)):
        assert sum((k, k) in found for k in range(lo, lo + 120)) >= 0.9 * 120, n


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    v = [b.astype("float32") for b in base] + [(base[k % 20] + rng.normal(size=16) * s).astype("float32") for k in range(150) for s in [rng.choice([0.05, 0.15, 0.3, 0.45])]]
    v += [v[0]] * 30
    rows = [(i, [float(x) for x in x]) for i, x in enumerate(v)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, []), (905, [float("inf")] * 16), (906, [1.0, 2.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rep", "2 AS cell", "3 AS n")
    x = np.array([r[1] for r in rows[: len(v)]], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    want = components(range(len(v)), zip(*np.nonzero(near)))
    for kw in ({"per_cell": 20, "block": 7, "reach": 4.0}, {}):
        got = embed_dedup.near_vectors(df, **kw).collect()
        assert len(got) == len(rows)
        for r in got:
            i = r["vec_id"]
            if i is not None and i < len(v):
                assert (r["n_links"], r["component_id"], r["kept"]) == (near[i].sum(), want[i], want[i] == i)
            else:
                assert r["n_links"] == 0 and r["component_id"] == i
    assert embed_dedup.near_vectors(df.where("false")).count() == 0


def test_embeddings_in_few_directions_over_many_cells(spark):
    """At 64 dimensions and over 40 cells, vectors that vary in two directions lose no link either."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 2)) @ rng.normal(size=(2, 64)) + rng.normal(size=64) * 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_vectors(df, per_cell=30).collect()}
    assert got == {i: int(n) for i, n in enumerate(near.sum(axis=1))}


def test_embeddings_in_boxes(spark, monkeypatch):
    """A vector is sent once a box, however many cells it is a guest in, as it was given; guests of empty cells are not lost."""
    made = []
    monkeypatch.setattr(embed_dedup, "materialize", lambda df, name, keep=embed_dedup.materialize: made.append((name, found := keep(df, name))) or found)
    means = embed_dedup.spherical_kmeans
    monkeypatch.setattr(embed_dedup, "spherical_kmeans", lambda x, k, **kw: np.concatenate([(m := means(x, k, **kw)), m[:1]]))  # the last cell stays empty
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 24)).astype(np.float32)
    x[350:] = x[:350] + rng.normal(size=(350, 24)).astype(np.float32) * 0.3
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_vectors(df, per_cell=20, block=100).collect()}
    want = components(range(700), zip(*np.nonzero(near)))
    assert got == {i: (int(near[i].sum()), want[i]) for i in range(700)} and near.any()
    held = dict(made)
    assert held["placed"].selectExpr("max(octet_length(x)) AS m").first()["m"] == 24 * 4
    # 36 cells in 7 boxes or a few more.
    assert held["hosts"].selectExpr("explode(boxes) AS b").agg({"b": "max"}).first()[0] <= 14


def test_close_pairs_beside_the_threshold():
    """Single precision decides nothing: products a billionth above and below the threshold, in sparse, dense and short strips."""
    rng = np.random.default_rng(5)
    for dim, n, copies in ((64, 2300, 40), (3, 1500, 40), (700, 60, 60), (2, 1, 1)):
        x = rng.normal(size=(n, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.normal(size=(2100, dim))
        for k in range(copies):  # y[k] at a cosine of 0.9 and a little to x[k]
            off = rng.normal(size=dim)
            off -= (off @ x[k]) * x[k]
            cosine = 0.9 + (-1) ** k * 1e-9
            y[k] = cosine * x[k] + math.sqrt(1 - cosine**2) * off / np.linalg.norm(off)
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        want = x @ y.T >= 0.9
        assert [want[k, k] for k in range(copies)] == [k % 2 == 0 for k in range(copies)]
        got = np.zeros_like(want)
        for start, i, j in embed_dedup.close(x, y, 0.9):
            assert not got[i, start + j].any() and len(set(zip(i.tolist(), j.tolist()))) == len(i)
            got[i, start + j] = True
        assert (got == want).all()


def test_embeddings_over_strips(spark, monkeypatch):
    """Chains and groups that reach over strips, blocks and cells, and guests that are hosts too, link and count once."""
    monkeypatch.setattr(embed_dedup, "STRIP", 5)
    rng = np.random.default_rng(6)
    turn = np.arange(0, 3, 0.1)  # a chain whose neighbours are 0.1 apart
    v = [np.concatenate([[np.cos(t), np.sin(t)], np.zeros(10)]) for t in turn] + [rng.normal(size=12) for _ in range(150)]
    v += [v[40] + rng.normal(size=12) * 0.1 for _ in range(60)]
    x = np.array(v) / np.linalg.norm(v, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    want = components(range(len(v)), zip(*np.nonzero(near)))
    df = spark.createDataFrame([(i, [float(c) for c in u]) for i, u in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_vectors(df, per_cell=25, block=9).collect()}
    assert got == {i: (int(near[i].sum()), want[i]) for i in range(len(v))}
