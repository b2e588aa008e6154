"""Queries against their SQL on small tables with rows that the given ones lack or have few of."""

import duckdb
import pytest

from loomtext.operators import ledger as L, structure as R
from loomtext.plans import registry

from .test_oracles import rows

NUMBERED = [(1, "Annt that as is inghe. Rerewh, shwh. 4088495698897153"), (2, "some words 12\nand a second line"), (3, "12"), (4, "plain words only"), (5, "")]


@pytest.fixture
def held(spark, tmp_path):
    """A function that holds a query against its SQL on tables given as (columns, rows)."""

    def check(name, **tables):
        duck = duckdb.connect()
        for t, (columns, values) in tables.items():
            spark.createDataFrame(values, columns).coalesce(1).write.parquet(path := str(tmp_path / f"{t}.parquet"))
            duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'")
        got, want = rows(registry.QUERIES[name](spark, str(tmp_path)).toPandas()), rows(duck.sql(registry.ORACLE_SQL[name]).df())
        assert got == want and got[1]

    return check


@pytest.mark.parametrize("name", ["abstract_front_matter", "word_accounting", "logical_view", "mask_regions"])
def test_first_line_ends_in_a_number(held, name):
    held(name, documents=("doc_id long, text string", NUMBERED))


def test_endings_with_letters_of_two_bytes(held):
    words = "ciónar ciónaró reelle reelleè tionen tioneñ tionens haüserne haüserné enblochesa enblochesä enblochesö überlanges überlangen"
    held("ending_variants", benchmark=("item_id long, text string", [(1, words)]))


def test_runs_of_texts_that_share_an_id(held):
    texts = ["a b a b a b a b a b a b", "x", "", None, "it’s a Straße it's a strasse it's a"]
    held("ngram_counts", documents=("doc_id long, text string", [*enumerate(texts), (0, "b a b a b c"), (0, None), (None, "p q r"), (None, "p q s p q r")]))


def test_runs_are_counted_without_a_shuffle_of_texts(spark):
    """No exchange takes more than ids: neither texts nor their runs."""
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b")], "doc_id long, text string")
    plan = L.gram_counts(docs, (2, 3))._jdf.queryExecution().optimizedPlan().toString()
    own = plan.split("Union")[1].split(":- Aggregate")[0]
    assert "array_distinct" in own and "Aggregate [doc_id#" in own and sorted(map(tuple, L.gram_counts(docs, (2, 3)).collect())) == [(1, 1, 1, 3), (1, 2, 2, 2), (2, 1, 1, 2)]


def test_words_are_marked_in_their_texts_row(spark):
    """The same marks as by sweeps over a token table, of which none is shuffled: texts meet their spans."""
    texts = ["", None, 'x "one two three" y "one two three four" z "open', '""" a "b c d e"', "Intro\nwords\n\nReferences\n[1] One, A. it’s.\n[2] 𝄞 two \"q r s t\" u\n\nAppendix A\nLast. Words", "References\n[1] first\nAbstract\nsix words or more follow here now"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    segs = R.segments(docs)
    want = L.mask(L.offset_ledger(docs), R.bibliography(segs), "bibliography")
    want = L.mask(want, R.long_quotes(want, R.straight_quotes(docs)), "quoted")
    got = R.marked_words(docs, segs)
    ordered = lambda df: sorted(map(tuple, df.select("doc_id", "pos", "w", "start", "end", "stop", "bibliography", "quoted").collect()))
    assert ordered(got) == ordered(want) and {r[6:] for r in ordered(got)} >= {(True, False), (False, True), (True, True)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan[: plan.index("Join")] and "Union" not in plan
    counts = L.regions(got, "bibliography", "quoted").groupBy("doc_id").agg({"region": "max"}).collect()
    assert {tuple(r) for r in R.region_counts(R.marked_texts(docs, segs), "bibliography", "quoted").collect()} == {(d, n + 1) for d, n in counts}
