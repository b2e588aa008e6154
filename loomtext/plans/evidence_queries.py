"""Queries over evidence: portions, views, attribution, agreement totals and resumable runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import ledger as L, overlap as O, score as S, structure as R
from loomtext.plans import structure_queries as B
from loomtext.plans.overlap_queries import D, RUNS, SPANS, W, _docs, _shifted, _spans, _src, _words


def quote_portions(spark, d):
    """Exact runs cut at quotation borders; every second stretch of twenty words counts as quoted."""
    runs = O.exact_runs(_docs(spark, d), _src(spark, d))
    p = runs.withColumn("pos", F.explode(F.sequence("i", (F.col("i") + F.col("n") - 1).cast("int")))).drop("n")
    region = F.floor(F.col("pos") / 20)
    return S.quote_portions(p.withColumn("region", region).withColumn("quoted", region % 2 == 1), "m", "s", "i", "j")


def manuscript_view(spark, d):
    """Source numbers of every matched word."""
    return _words(spark, d).groupBy("m", "pos").agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("sources"))


def citation_references(spark, d):
    """Attribution of documents whose built text cites one of its two references by number."""
    docs = B._built(spark, d)
    refs = R.references(docs, R.segments(docs))
    cites = docs.select("doc_id", F.col("doc_id").alias("s"), (F.col("doc_id") % 3 + 1).cast("int").alias("number"), (F.col("doc_id") % 5 != 0).alias("cited"))
    cites = cites.withColumn("number", F.when(F.col("cited"), F.col("number")))
    src = docs.select(F.col("doc_id").alias("s"), F.concat(F.lit("10.1234/AB."), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(0).cast("string")).alias("doi"))
    return S.attribution(cites, refs, src).select("doc_id", "attribution")


def agreement_totals(spark, d):
    """Micro counts and macro per-mille recall of shifted detections against the runs."""
    pos = lambda df: df.select("m", "s", F.explode(F.sequence("lo", (F.col("hi") - 1).cast("int"))).alias("pos"))
    c = S.confusion(pos(_spans(spark, d)), pos(_shifted(_spans(spark, d))))
    recall = F.floor(1000 * F.col("both") / (F.col("both") + F.col("reference_only")))
    return c.groupBy().agg(F.sum("both").alias("both"), F.sum("reference_only").alias("reference_only"), F.sum("detector_only").alias("detector_only"), F.sum(recall).alias("recall_sum"), F.count(F.lit(1)).alias("sources"))


def bridged_highlights(spark, d):
    """Highlighted stretches of each manuscript's text: words of the same sources that only blanks part are one."""
    docs = _docs(spark, d)
    words = _words(spark, d).groupBy(F.col("m").alias("doc_id"), "pos").agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("sources"))
    t = L.offset_ledger(docs.join(words.select("doc_id").distinct(), "doc_id", "left_semi"))
    spans = t.join(words, ["doc_id", "pos"]).select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"), "sources")
    return L.bridge(spans, docs, "sources")


def disguised_fingerprints(spark, d):
    """Fingerprints of texts whose letters were replaced by compatibility forms: those of the plain texts."""
    text = F.replace(F.translate("text", "aAoO1", "ａＡｏＯ①"), F.lit("fi"), F.lit("ﬁ"))
    return _docs(spark, d).select("doc_id", F.sha2(F.array_join(T.exact_words(text), " "), 256).alias("fingerprint"))


def resume_remainder(spark, d):
    """Manuscript and source pairs that share nine words but have no finished checkpoint."""
    pairs = O.exact_runs(_docs(spark, d), _src(spark, d)).select("m", "s").distinct()
    return pairs.join(pairs.where((F.col("m") + F.col("s")) % 3 == 0), ["m", "s"], "left_anti")


QUERIES = {
    "quote_portions": (quote_portions, f"""WITH {RUNS}, p AS (SELECT m, s, i, j, unnest(range(i, i + n)) AS pos FROM runs), g AS (SELECT m, s, i, j, pos // 20 AS r, count(*) AS n FROM p GROUP BY ALL)
SELECT m, s, i, j, row_number() OVER (PARTITION BY m, s, i, j ORDER BY r) - 1 AS portion, n, r % 2 = 1 AS quoted, CASE WHEN r % 2 = 1 THEN 'recognized-quotation' WHEN n < 9 THEN 'below-nine-matched-words' ELSE '' END AS reason FROM g"""),
    "manuscript_view": (manuscript_view, f"WITH {RUNS} SELECT m, pos, array_to_string(list_sort(list(DISTINCT s)), ',') AS sources FROM pos GROUP BY m, pos"),
    "citation_references": (citation_references, """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'not-detected' WHEN doc_id % 3 = 0 AND (doc_id % 2 = 0 OR doc_id = 0) THEN 'matching-source-confirmed' ELSE 'nearby-unverified' END AS attribution FROM documents"""),
    "agreement_totals": (agreement_totals, f"""WITH {SPANS}, a AS (SELECT DISTINCT m, s, unnest(range(lo, hi)) AS p, 1 AS r FROM sp), c AS (SELECT DISTINCT m, s, unnest(range(lo, hi)) AS p, 1 AS d FROM sh),
t AS (SELECT s, count(*) FILTER (WHERE r = 1 AND d = 1) AS b, count(*) FILTER (WHERE d IS NULL) AS ro, count(*) FILTER (WHERE r IS NULL) AS dd FROM a FULL JOIN c USING (m, s, p) GROUP BY s)
SELECT sum(b)::BIGINT AS both, sum(ro)::BIGINT AS reference_only, sum(dd)::BIGINT AS detector_only, sum(1000 * b // (b + ro))::BIGINT AS recall_sum, count(*) AS sources FROM t"""),
    "bridged_highlights": (bridged_highlights, rf"""WITH {RUNS}, h AS (SELECT m, pos, array_to_string(list_sort(list(DISTINCT s)), ',') AS sources FROM pos GROUP BY m, pos),
p AS (SELECT doc_id AS m, text, unnest(regexp_extract_all(text, '[^\p{{L}}\p{{N}}]*{W}')) AS piece, generate_subscripts(regexp_extract_all(text, '[^\p{{L}}\p{{N}}]*{W}'), 1) AS k FROM documents),
o AS (SELECT m, text, k - 1 AS pos, (sum(length(piece)) OVER (PARTITION BY m ORDER BY k))::BIGINT AS e, length(regexp_extract(piece, '{W}$')) AS n FROM p),
w AS (SELECT o.m, text, pos, e - n AS s, e, sources FROM o JOIN h USING (m, pos)),
g AS (SELECT *, substring(text, lag(e) OVER x + 1, s - lag(e) OVER x) AS gap, lag(sources) OVER x AS last FROM w WINDOW x AS (PARTITION BY m ORDER BY s)),
i AS (SELECT *, sum(CASE WHEN last = sources AND regexp_full_match(gap, '\s+') AND NOT contains(gap, chr(10) || chr(10)) THEN 0 ELSE 1 END) OVER (PARTITION BY m ORDER BY s) AS z FROM g)
SELECT m AS doc_id, sources, min(s)::BIGINT AS s, max(e)::BIGINT AS e, count(*) AS n FROM i GROUP BY m, sources, z"""),
    "disguised_fingerprints": (disguised_fingerprints, f"WITH {D} SELECT m AS doc_id, sha256(array_to_string(w, ' ')) AS fingerprint FROM d"),
    "resume_remainder": (resume_remainder, f"WITH {RUNS} SELECT DISTINCT m, s FROM runs WHERE (m + s) % 3 <> 0"),
}
