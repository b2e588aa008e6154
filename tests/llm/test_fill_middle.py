"""Fill-in-middle: the boundary set against a plain list, the transformation against a plain regular expression."""

import hashlib
import random
import re

import numpy as np
import pytest

from loomtext.llm import fill_middle as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def test_containers_select_like_a_list():
    rng = np.random.default_rng(5)
    found, places = M.BoundarySet(), []
    lows = [np.array([0, 65535]), np.arange(300, 9000), np.flatnonzero(rng.random(M.CHUNK) < 0.4), np.sort(rng.choice(M.CHUNK, 900, replace=False)), np.array([], int), np.array([7])]
    for key, low in enumerate(lows):
        found.add(2 * key, low)
        places += [2 * key * M.CHUNK + int(x) for x in low]
    assert [c.kind for c in found.containers] == ["array", "runs", "bitmap", "array", "array"]
    assert len(found) == len(places) and [found.select(k) for k in range(len(places))] == places


def test_units_of_random_and_long_texts():
    rng = random.Random(3)
    texts = ["", " ", "a", "\x0b", "a \n", " a", "é 😀\x85b c\x1c"] + ["".join(rng.choice("ab \t\r\x0c😀é\x00") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["x" * (M.CHUNK - 1) + " " + "y" * 5, "x" * M.CHUNK + " y", "x" * M.CHUNK, " " * (2 * M.CHUNK), "ab cd😀 " * 300_000]
    for text in texts:
        ends, at = [], 0
        for u in UNIT.findall(text):
            at += len(u)
            ends.append(at - 1)
        found = M.unit_ends(text)
        some = range(len(ends)) if len(ends) < 1000 else [0, len(ends) - 1, *rng.sample(range(len(ends)), 200)]
        assert len(found) == len(ends) and all(found.select(k) == ends[k] for k in some)


def plain(i, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = UNIT.findall(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    x, y, z = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in M.MARKS) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    return (len(units), *(("spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}") if h4 % 100 < 80 else ("psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}")))


TEXTS = [None, "", "   ", "one", "one two", " lead and trail \n", "a<b> <S", "P> <", "has <P> inside", "<M>", "é 😀 ñ 汉字 😀", "x\x00y z", "<S" * 5 + " <P", "word " * 40_000]


def test_transform_and_restore(spark, docs):
    rows = [(i, t) for i in range(40) for t in TEXTS] + [(None, "no id at all"), (3, "one two"), (3, "one two")]
    got = M.transform(docs(rows)).withColumn("back", M.restored(M.F.col("form"), M.F.col("output"))).toPandas()
    key = lambda v: repr([None if x is None or x != x else int(x) if isinstance(x, float) else x for x in v])
    want = sorted(key((i, *plain(i, t), t or "")) for i, t in rows)
    assert sorted(key(r) for r in got[["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back"]].itertuples(index=False, name=None)) == want
    assert set(got["form"]) == {"plain", "spm", "psm"}


def test_other_marks_rates_and_empty_tables(spark, docs):
    rows = [(i, f"alpha beta gamma {i} <P>") for i in range(60)]
    got = M.transform(docs(rows), rate=100, spm=0, marks=("[p]", "[s]", "[m]")).withColumn("back", M.restored(M.F.col("form"), M.F.col("output"), ("[p]", "[s]", "[m]"))).toPandas()
    assert set(got["form"]) == {"psm"} and dict(zip(got["doc_id"], got["back"])) == dict(rows)
    assert M.digests(docs([])).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_is_its_sql(spark, sf):
    import duckdb

    from loomtext.llm import queries

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.sql(M.SQL).df()
    got = queries.QUERIES["op12_fill_middle"](spark, sf).toPandas()[list(want.columns)]
    clean = lambda df: sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    norm = lambda df: df.assign(**{c: df[c].astype("Int64") for c in ("doc_id", "n", "prefix_chars", "middle_chars")})
    assert clean(norm(got)) == clean(norm(want)) and (got["n"] > 0).any()
