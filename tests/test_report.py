"""Structure, masks, reports, sources and sinks on small texts with known answers."""

import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import ledger as L, structure as R
from loomtext.operators.components import connected_components
from loomtext.plans import report
from loomtext.sources import documents as D, html as H

PHRASE = "wind turbines along the coast produced more power than planned during that stormy winter"
FILL = " ".join(f"word{k}" for k in range(125))
TEXT = (
    "Some title here\n" + " ".join(f"front{k}" for k in range(17)) + "\n\nAbstract\n" + PHRASE + " " + FILL + ".\n\"" + " ".join(f"quote{k}" for k in range(10)) + '"\n\n'
    "References\n[1] Someone (2001). A work. 10.1234/ABC.5\n[2] Other, A. second work\nand its end\n"
)


@pytest.fixture(scope="module")
def tables(spark):
    ms = spark.createDataFrame([(1, TEXT), (2, "short text only"), (3, None), (4, "")], "doc_id long, text string")
    near = PHRASE.replace("power", "energy") + " other words follow here"
    src = spark.createDataFrame([(10, "Intro line. " + PHRASE + " and so on."), (11, near), (12, "short, TEXT only!"), (13, None), (14, "nothing in common")], "doc_id long, text string")
    return ms, src


def test_denominator(spark, tables):
    row = report.S.accounting(R.ledger_with_masks(tables[0])).where("doc_id = 1").first().asDict()
    assert row["front_matter_words"] == 20 and row["excluded_quotation_words"] == 10 and row["violations"] == 0
    assert row["eligible_words"] == 1 + 14 + 125 and row["scoped_words"] == row["total_words"] - 20
    assert row["total_words"] == row["eligible_words"] + 20 + 10 + row["excluded_bibliography_words"]


def test_references(tables):
    docs = tables[0]
    refs = {r["ref_no"]: (r["doi"], r["raw"]) for r in R.references(docs, R.segments(docs)).collect()}
    assert refs[1][0] == "10.1234/ABC.5" and refs[2] == (None, "[2] Other, A. second work\nand its end")


def test_offsets_are_code_points(spark):
    text = "😀 Über-all, don't! 漢字 x"
    rows = L.offset_ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("pos").collect()
    assert [(r["w"], text[r["start"] : r["end"]]) for r in rows] == [(w.lower(), w) for w in ["Über", "all", "don't", "漢字", "x"]]


@pytest.mark.parametrize(("model", "similar"), [("exact", 0), ("standard", 13), ("improved", 13), ("classified", 13), ("ordered", 13)])
def test_reports(tables, model, similar):
    r = report.compare(*tables, model=model)
    scores = {x["m"]: x for x in r.scores.collect()}
    assert scores[1]["overlap_words"] == 14 and scores[1]["denominator"] == 140 and scores[1]["percent"] == 10.0
    assert scores[4]["percent"] is None and set(scores) == {1, 2, 3, 4}
    assert (scores[3]["status"], scores[3]["denominator"], scores[4]["status"]) == ("unavailable", 0, "compared")
    status = {x["s"]: x["status"] for x in r.coverage.collect()}
    assert status == {10: "compared", 11: "compared", 12: "excluded-identical", 13: "unavailable", 14: "compared"}
    per = {x["s"]: x["overlap_words"] for x in r.per_source.collect()}
    assert per[10] == 14 and per[14] == 0 and (per[11] > 0) == bool(similar)
    states = [(x["state"], x["hi"] - x["lo"]) for x in r.intervals.where("m = 1").orderBy("lo").collect()]
    assert states[0] == ("front-matter", 20) and ("not-fully-checked", 125) in states


def test_excluded_sources(spark, tables):
    ms, src = tables
    r = report.compare(ms, src, "exact", excluded=src.where("doc_id = 10"))
    status = {x["s"]: x["status"] for x in r.coverage.collect()}
    assert status[10] == "excluded-by-user" and status[11] == "compared" and r.matches.where("s = 10").count() == 0


def test_sinks(spark, tables, tmp_path):
    r = report.compare(*tables, model="exact")
    report.write_report(r, str(tmp_path / "r"))
    report.write_html(r, str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "r/matches.json")).count() == r.matches.count() == 1
    assert "<td>exact</td>" in "".join(x[0] for x in spark.read.text(str(tmp_path / "h")).collect())


def test_components_against_union_find(spark):
    import random

    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 700)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {y for a, b in edges if a != b for y in (a, b)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfone\r\ntwo\rthree")
    (tmp_path / "b.txt").write_bytes("wide é".encode("utf-16"))
    (tmp_path / "c.txt").write_bytes(b"nul\x00l")
    (tmp_path / "d.txt").write_bytes(b"  \n")
    (tmp_path / "e.txt").write_bytes(b"\xff\xfa\xfb")
    got = {r["path"][-5:]: (r["text"], r["status"]) for r in D.text_files(spark, str(tmp_path / "*.txt")).collect()}
    assert got["a.txt"] == ("one\ntwo\nthree", "ok") and got["b.txt"] == ("wide é", "ok")
    assert got["c.txt"][1] == "not-text" and got["d.txt"][1] == "empty" and got["e.txt"][1] == "not-text"
    pages = spark.createDataFrame([(1, 2, "second"), (1, 1, "first"), (2, 1, None)], "doc_id long, page int, text string")
    docs = {r["doc_id"]: r for r in D.pages_to_documents(pages).collect()}
    assert docs[1]["text"] == "first\n\nsecond" and [tuple(p) for p in docs[1]["pages"]] == [(1, 0), (2, 7)] and docs[2]["text"] == ""
    titles = spark.createDataFrame([("\n\n  The title \nrest",)], "t string").select(D.title_of("t")).first()[0]
    assert titles == "The title"


def test_corpus_checks(spark):
    texts = spark.createDataFrame([("body",)], "text string")
    sha = texts.select(F.sha2("text", 256)).first()[0]
    entries = spark.createDataFrame([(sha, "CC0-1.0", "https://a.test/x"), ("f" * 64, "closed", "http://a.test"), (sha, "CC0-1.0", "https://a.test/y")], "sha256 string, licence string, url string")
    assert {tuple(r) for r in D.corpus_violations(entries, texts).collect()} == {(sha, "duplicate"), ("f" * 64, "no-text"), ("f" * 64, "licence"), ("f" * 64, "address")}
    cache = spark.createDataFrame([(sha, "p1", 3)], "sha256 string, parser string, structure int")
    assert D.stale(cache, texts, "p1").count() == 0 and D.stale(cache, texts, "p2").count() == 1


def test_web(spark):
    xml = "<article><body><sec><title>T</title><p>" + "some words " * 120 + "</p></sec></body></article>"
    rows = spark.createDataFrame([(1, xml), (2, "<article>no body</article>"), (3, xml.replace("<body>", "<!ENTITY x><body>"))], "id long, xml string")
    assert [r["ok"] for r in H.jats_text(rows).orderBy("id").collect()] == [True, False, False]
    urls = ["https://a.test/p?type=pdf&token=1&id=10.1234/x#f", "https://u:p@a.test/", "https://a.test/q?x=1"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(H.public_url(F.col("u"))).collect()]
    assert got == ["https://a.test/p?type=pdf&id=10.1234/x", "(invalid source URL)", "https://a.test/q"]


def test_every_manuscript_has_word_states(spark):
    from loomtext.plans import registry

    sf = "/root/testdata/sf0.001"
    got = registry.QUERIES["word_states_all_intervals"](spark, sf).groupBy("m").agg(F.sum(F.col("hi") - F.col("lo")).alias("n"))
    have = {r["doc_id"]: r["n"] for r in L.ledger(spark.read.parquet(f"{sf}/documents.parquet")).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert {r["m"]: r["n"] for r in got.collect()} == have


def test_numeric_prefix_and_ledger_hash(spark):
    import hashlib
    import json

    rows = [("12.345", "12.349", 5), ("12.3", "12.3", 0), ("1234", "1239", 0), ("1,2", "1,9", 2), ("9.1", "8.1", 0)]
    got = spark.createDataFrame(rows, "a string, b string, n int").select(T.numeric_prefix(F.col("a"), F.col("b")).alias("p"), "n").collect()
    assert all(r["p"] == r["n"] for r in got)
    text = "Größe don’t ΟΔΟΣ 12"
    words = ["grösse", "don't", "οδοσ", "12"]
    (row,) = spark.createDataFrame([(text,)], "t string").select(T.words(F.col("t")).alias("w"), T.ledger_hash(F.col("t")).alias("h")).collect()
    assert row["w"] == words and row["h"] == hashlib.sha256(json.dumps(words, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
