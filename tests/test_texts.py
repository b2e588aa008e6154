"""Exact folding, title resolution and bridged spans against plain Python."""

import difflib
import random
import unicodedata

import regex

from loomtext.functions import text as T
from loomtext.operators import catalog as C, ledger as L
from loomtext.plans import report


def test_folding_of_every_code_point(spark):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LNM"]
    texts = [" ".join(f"a{c}Z" for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    find = regex.compile(T.WORD).findall
    want = {k: [unicodedata.normalize("NFKC", w).casefold().replace("’", "'") for w in find(t)] for k, t in enumerate(texts)}
    assert {r["id"]: r["w"] for r in rows.select("id", T.exact_words(T.F.col("text")).alias("w")).collect()} == want


def test_folding_of_plain_and_empty_texts(spark):
    texts = [None, "", "Größe ÉTÉ don’t ÿ", "ﬁne ＡＢＣ", "x²", "Ǆ ŉ ẞ", "…™ only"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["w"] for r in rows.select("id", T.exact_words(T.F.col("text")).alias("w")).collect()}
    assert got == {0: None, 1: [], 2: ["grösse", "été", "don't", "ÿ"], 3: ["fine", "abc"], 4: ["x2"], 5: ["dž", "ʼn", "ss"], 6: ["only"]}
    same = rows.where("id in (1, 2, 6)").select(T.exact_words(T.F.col("text")) == T.words(T.F.col("text"))).collect()
    assert all(r[0] for r in same)


def pieces(t):
    t = f" {t} "
    return {t[k : k + 3] for k in range(len(t) - 2)}


def titles(seed, n):
    rng = random.Random(seed)
    words = "carbon soils lakes deep winter model of the growth basin river theory".split()
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for _ in range(n)]
    return base + ["".join(c for c in t if rng.random() > 0.12) for t in base] + ["a", "ab", ""]


def test_similar_titles_against_all_pairs(spark):
    left, right = titles(1, 40), titles(2, 30) + titles(1, 10)
    table = lambda ts: spark.createDataFrame([(t,) for t in ts], "key string")
    for percent in (40, 75, 100):
        got = {tuple(r) for r in C.similar_titles(table(left), table(right), percent).collect()}
        want = {(x, y) for x in left for y in right if x and y and 100 * len(pieces(x) & pieces(y)) >= percent * len(pieces(x) | pieces(y))}
        assert got == want and got


def test_references_go_to_the_closest_title(spark):
    papers = [(1, None, "Carbon stored in deep soils"), (2, "10.1234/x", "Lakes of the north"), (3, None, "Winter growth models"), (4, None, "winter growth models"), (5, None, "Carbon stores in deep soil")]
    refs = [(10, None, "Carbon storde in deep soils"), (11, "10.1234/X", "whatever"), (12, None, "Winter growth models"), (13, None, "zzz qqq"), (14, None, None), (15, None, "Lakes of the north"), (16, None, "Lake of the north")]
    refs, papers = spark.createDataFrame(refs, "ref long, doi string, title string"), spark.createDataFrame(papers, "id long, doi string, title string")
    got = {r["ref"]: (r["paper"], r["how"]) for r in C.resolve_similar(refs, papers).collect()}
    assert got == {10: (1, "similar"), 11: (2, "doi"), 12: (3, "similar"), 13: (None, "none"), 14: (None, "none"), 15: (2, "title"), 16: (2, "similar")}
    assert C.resolve_similar(refs.where("false"), papers).count() == 0 and {r["how"] for r in C.resolve_similar(refs, papers.where("false")).collect()} == {"none"}


def test_title_query_against_plain_ratios(spark):
    from loomtext.plans import catalog_queries as Q

    sf = "/root/testdata/sf0.001"
    key = lambda df: df.withColumn("k", T.title_key(T.F.col("title"))).toPandas()
    refs, papers = key(Q._altered(spark, sf)), key(Q._papers(spark, sf).where("id % 4 <> 1"))
    got = {r["ref"]: (r["paper"], r["how"]) for r in Q.similar_reference_resolution(spark, sf).collect()}
    held = papers.groupby("k")["id"].min()
    for r in refs.itertuples():
        paper, how = got[r.ref]
        near = [(-difflib.SequenceMatcher(None, r.k, k).ratio(), k, i) for k, i in held.items() if r.k and k and 100 * len(pieces(r.k) & pieces(k)) >= 40 * len(pieces(r.k) | pieces(k))]
        near = sorted(n for n in near if n[0] <= -0.45)
        if how == "similar":
            assert paper == near[0][2]
        elif how == "none":
            assert not near
    assert sum(h == "similar" for _, h in got.values()) > 5


def test_bridge(spark):
    text = "one two  three\n\nfour five, six\tseven"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = [(1, 0, 3, "x"), (1, 4, 7, "x"), (1, 9, 14, "x"), (1, 16, 20, "x"), (1, 21, 25, "y"), (1, 27, 30, "y"), (1, 31, 33, "y"), (1, 33, 36, "y")]
    got = L.bridge(spark.createDataFrame(spans, "doc_id long, s int, e int, who string"), docs, "who")
    assert sorted((r["s"], r["e"], r["who"], r["n"]) for r in got.collect()) == [(0, 14, "x", 3), (16, 20, "x", 1), (21, 25, "y", 1), (27, 33, "y", 2), (33, 36, "y", 1)]


def test_numeric_prefixes_are_of_numerals(spark):
    rows = spark.createDataFrame([("4.72", "4.16"), ("4.7", "4.7"), ("12", "13"), ("1,204.5", "1,204.7"), ("a.b1", "a.b2"), ("3.1x", "3.12")], "a string, b string")
    assert [r[0] for r in rows.select(T.numeric_prefix(T.F.col("a"), T.F.col("b"))).collect()] == [2, 0, 0, 6, 0, 0]


def test_report_takes_citations_whole_and_stops_at_references(spark):
    prose = "sediment cores from northern lakes (Stone, 2004) {} show rapid warming patterns"
    ms = [(1, prose.format("clearly")), (2, "amber basin cedar delta ember fjord\n\nReferences\n[1] Some work\n\nAppendix\n\ngrove heath inlet jetty knoll lagoon")]
    src = [(10, prose.format("never")), (11, "amber basin cedar delta ember fjord grove heath inlet jetty knoll lagoon")]
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    r = report.compare(table(ms), table(src))
    found = [(x["m"], x["s"], x["equal"], x["kind"], list(x["places"])) for x in r.matches.collect()]
    assert found == [(1, 10, 11, "similar", [0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11])]
    assert {x["m"]: x["overlap_words"] for x in r.scores.collect()} == {1: 11, 2: 0}


def test_broken_words_are_joined(spark):
    texts = ["The co­op­eration of soil-\ncarbon and soil- \n carbon, wind-\npower and Wind-\nPower.", "soilcarbon windpower wind-power", "plain words", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lambda joins: {d: [(r["w"], texts[d][r["start"] : r["end"]], r["pos"]) for r in L.joined_ledger(docs, joins).where(T.F.col("doc_id") == d).orderBy("pos").collect()] for d in (0, 2)}
    shared = rows(L.line_joins(docs))
    words = [w for w, _, _ in shared[0]]
    assert words == ["the", "cooperation", "of", "soilcarbon", "and", "soilcarbon", "wind", "power", "and", "wind", "power"]
    assert shared[0][1][1] == "co­op­eration" and shared[0][3][1] == "soil-\ncarbon" and [p for _, _, p in shared[0]] == list(range(11))
    own = rows(L.line_joins(docs, "doc_id"))
    assert [w for w, _, _ in own[0]] == ["the", "cooperation", "of", "soil", "carbon", "and", "soil", "carbon", "wind", "power", "and", "wind", "power"]
    assert [w for w, _, _ in own[2]] == ["plain", "words"]


def plain_uncertain(text):
    """Paragraphs around the kernel's doubtful marks, and indented lines outside quotations, by searching the text."""
    from loomtext.operators import kernels as K

    found = set()
    for at in K.Quotations(text).doubtful:
        a, z = text.rfind("\n\n", max(0, at - 10_000), at), text.find("\n\n", at, at + 10_000)
        found.add((a + 2 if a >= 0 else max(0, at - 10_000), z if z >= 0 else min(len(text), at + 10_000)))
    quoted = K.quotation_spans(text)
    return found | {m.span() for m in regex.finditer(r"(?m)^[ \t]{4,}[^\n]+", text) if not any(a <= m.start() and m.end() <= b for a, b in quoted)}


def test_uncertain_quotes(spark):
    from loomtext.operators import kernels as K, structure as R

    rng = random.Random(13)
    parts = ['"', "“", "”", "'", "«", "»", "word", "two words", "5", "\n\n", "\n", "\n\n\n", "    indented line\n", "\n    ", " ", ". ", "> led line\n", "don't", "dogs' "]
    texts = ["", 'open "never closed', 'a "b" c', "“" + "x" * 10_050 + "” end\n\nnext", "\n\n“only", "    whole\n“ in\n    it” line\n"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in R.uncertain_quotes(docs).collect():
        got.setdefault(r["doc_id"], set()).add((r["s"], r["e"]))
    assert got == {k: plain_uncertain(t) for k, t in enumerate(texts) if plain_uncertain(t)}
    assert K.Quotations('A 5" pipe, the dogs\' bowl').doubtful == [] and K.Quotations('so ) " alone').doubtful == [5]


def test_similar_titles_over_blocks(spark):
    """Titles in many blocks, of letters beyond a code unit too, meet once each; no exchange takes pairs of titles."""
    left, right = titles(3, 40) + ["a𝄞bc𝄞 d", "𝄞"], titles(4, 30) + titles(3, 5) + ["a𝄞bc𝄞 e", "𝄞"]
    table = lambda ts: spark.createDataFrame([(t,) for t in ts], "key string")
    found = C.similar_titles(table(left), table(right), 40, most=7)
    got = [tuple(r) for r in found.collect()]
    want = {(x, y) for x in left for y in right if x and y and 100 * len(pieces(x) & pieces(y)) >= 40 * len(pieces(x) | pieces(y))}
    assert len(got) == len(set(got)) and set(got) == want and ("𝄞", "𝄞") in want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "array_intersect" not in plan
