"""Agreement queries on tables whose copies are altered, so that every category occurs; held against their SQL."""

import random

import duckdb
import pytest

from loomtext.operators import agreement as A
from loomtext.plans import registry

from .test_oracles import rows

NAMES = ["passage_groups", "position_metrics", "position_totals", "passage_context"]


@pytest.fixture(scope="module")
def altered(spark, tmp_path_factory):
    """Benchmark items, and documents with whole, thinned, cut and joined copies of them."""
    rng, where = random.Random(3), tmp_path_factory.mktemp("altered")
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuv") for _ in range(rng.randrange(3, 9)))
    filler = lambda n: " ".join(word() + rng.choice(["", "", ".", "!\n\n"]) for _ in range(n))
    items = [[word() for _ in range(40)] for _ in range(12)]
    items[1][:14] = items[2][:14]  # a passage that a source of either split holds
    docs = [None, "", "one two"]
    for k, item in enumerate(items):
        gaps = list(item)
        for at in range(6, 40, 7):
            gaps[at] = word()
        one = [*item[:20], word(), *item[21:]]
        far = [*item[:9], word(), *item[10:16]]
        docs += [f"{filler(k * 90)} {' '.join(x)}. {filler(40)}" for x in (item, gaps, item[5:15], one, far)]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string").coalesce(1).write.parquet(f"{where}/benchmark.parquet")
    return str(where)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, altered, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{altered}/{t}.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, altered).toPandas()
    assert rows(got) == rows(c.sql(registry.ORACLE_SQL[name]).df())
    if name == "passage_groups":
        assert set(got["category"]) == set("ABCD") and got["passages"].max() >= 1
    if name == "position_totals":
        assert got["leakage"][0] > 0 and got["additional"][0] + got["outside"][0] > 0 and got["micro_recall"][0] < 1


def test_groups_by_hand(spark):
    kind = "m long, s long, lo int, hi int, slo int, shi int"
    ref = [(1, 1, 0, 20, 0, 20), (1, 1, 30, 50, 30, 50), (1, 2, 0, 20, 0, 20), (2, 1, 0, 40, 0, 40), (2, 1, 0, 40, 0, 40)]
    det = [(1, 1, 1, 21, 1, 21), (1, 1, 60, 70, 60, 70), (2, 1, 0, 12, 0, 12), (2, 1, 15, 27, 15, 27), (1, 2, 0, 20, 100, 120)]
    found = A.passage_groups(spark.createDataFrame(ref, kind), spark.createDataFrame(det, kind)).collect()
    got = sorted((r["m"], r["s"], r["first"], r["category"], r["passages"], r["detections"], r["reference_words"], r["detector_words"], r["shared_words"]) for r in found)
    assert got == [
        (1, 1, 0, "A", 1, 1, 20, 20, 19), (1, 1, 30, "B", 1, 0, 20, 0, 0), (1, 1, 60, "C", 0, 1, 0, 10, 0),
        (1, 2, 0, "B", 1, 0, 20, 0, 0), (1, 2, 0, "C", 0, 1, 0, 20, 0), (2, 1, 0, "D", 1, 2, 40, 24, 24),
    ]
    empty = spark.createDataFrame([], kind)
    assert A.passage_groups(empty, empty).count() == 0
