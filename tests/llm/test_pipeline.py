"""The pipeline's stages on small documents: decisions take effect, columns stay, edge rows do not break it."""

import hashlib
import random

import pytest

import corpus_pipeline as P
from loomtext.llm import queries

from .conftest import sentence


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    path = tmp_path_factory.mktemp("tables")
    item = sentence(rng, 40)
    base = [sentence(rng, 120) for _ in range(6)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(base)]
    changed = base[0].split()
    changed[30:32] = ["something", "else"]
    rows += [
        (10, " ".join(changed), "en", "s", 1),  # a near copy
        (11, base[1], "en", "s", 1),  # an exact copy: its only line repeats
        (12, sentence(rng, 10) + "\n" + item + "\n" + sentence(rng, 12), "en", None, 1),  # a benchmark passage
        (13, "12 34 !!", None, "s", 1), (14, None, "en", "s", None), (15, "", None, None, 0),
        (16, base[2] + "\n" + sentence(rng, 15), "en", "s", 1),  # its first line repeats
        (None, sentence(rng, 30), "en", "s", 1),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), dict((r[0], r[1]) for r in rows)


def test_pipeline(spark, folder):
    path, texts = folder
    got = {r["doc_id"]: r for r in P.run(spark, path).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 16, None}
    for i in (0, 1, 2, 3, 4, 5, None):
        assert got[i]["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest()
        assert got[i]["n_tokens"] == len(got[i]["ids"]) > 0
    assert got[16]["decoded_sha256"] == hashlib.sha256(texts[16].split("\n")[1].encode()).hexdigest()


def test_stages_keep_columns_and_empty_tables(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
        assert stage(spark, docs.where("false"), path).count() == 0
    assert P.STAGES[-1][1](spark, docs.where("false"), path).count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
