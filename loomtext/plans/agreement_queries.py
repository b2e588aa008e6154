"""Queries over agreement of nine-word runs with labelled passages, and the context of matches, with SQL counterparts.

Labelled passages are runs of five words or more on one diagonal, joined over single other words to twelve words or more.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import agreement as A, ledger as L, overlap as O
from loomtext.plans.overlap_queries import RUNS, _docs, _spans, _src

PAGE = 500
PIECE_SQL, WORD_SQL = (p.replace("'", "''") for p in (T.PIECE, T.WORD))


def _passages(spark, d):
    return A.joined_runs(O.exact_runs(_docs(spark, d), _src(spark, d), 5))


def passage_groups(spark, d):
    return A.passage_groups(_passages(spark, d), _spans(spark, d))


def _position_words(spark, d):
    """Predicted and labelled words of each source; pages of 500 words are observed where they hold a labelled word.

    Sources of odd number are the validation split: words labelled for a source of even number are excluded there.
    """
    at = lambda df: df.select("m", "s", F.explode(F.sequence(F.col("lo").cast("long"), F.col("hi").cast("long") - 1)).alias("pos")).distinct()
    gold, predicted = at(_passages(spark, d)).withColumn("gold", F.lit(True)), at(_spans(spark, d)).withColumn("predicted", F.lit(True))
    page = F.floor(F.col("pos") / PAGE).alias("page")
    seen = gold.select("m", "s", page).distinct().withColumn("observed", F.lit(True))
    leak = gold.where("s % 2 = 0").select("m", "pos").distinct().withColumn("dev", F.lit(True))
    both = gold.join(predicted, ["m", "s", "pos"], "full").withColumn("page", page).join(seen, ["m", "s", "page"], "left").join(leak, ["m", "pos"], "left")
    chars = L.ledger(_docs(spark, d)).select(F.col("doc_id").alias("m"), F.col("pos").cast("long").alias("pos"), F.length(F.replace("w", F.lit("'"))).alias("chars"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    excluded = (F.coalesce(F.col("dev"), F.lit(False)) & (F.col("s") % 2 == 1)).alias("excluded")
    return both.join(chars, ["m", "pos"]).select("s", "chars", no("predicted"), no("gold"), no("observed"), excluded)


def position_metrics(spark, d):
    return A.position_metrics(_position_words(spark, d))


def position_totals(spark, d):
    return A.micro_macro(A.position_metrics(_position_words(spark, d)))


def passage_context(spark, d):
    """Every nine-word run with the text around it: at most 600 characters each way, to the nearest end of a sentence or paragraph."""
    runs = O.exact_runs(_docs(spark, d), _src(spark, d))
    at = L.offset_ledger(_docs(spark, d).join(runs.select(F.col("m").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    a = at.select(F.col("doc_id").alias("m"), F.col("pos").alias("i"), F.col("start").alias("match_start"))
    b = at.select(F.col("doc_id").alias("m"), F.col("pos").alias("z"), F.col("end").alias("match_end"))
    found = runs.withColumn("z", F.col("i") + F.col("n") - 1).join(a, ["m", "i"]).join(b, ["m", "z"]).join(_docs(spark, d).withColumnRenamed("doc_id", "m"), "m")
    lo, hi = T.context(F.col("text"), F.col("match_start"), F.col("match_end"))
    found = found.withColumns({"start": lo, "end": hi})
    excerpt = F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start"))
    return found.select("m", "s", "i", "j", "start", "end", F.sha2(excerpt, 256).alias("excerpt"), (F.col("match_start") - F.col("start")).alias("highlight"))


PASSAGES = f"""WITH RECURSIVE {RUNS}, r5 AS (SELECT m, s, dg, min(i) AS lo, max(i) + 1 AS hi FROM isl GROUP BY m, s, dg, g HAVING count(*) >= 5),
st AS (SELECT *, coalesce(lo - lag(hi) OVER (PARTITION BY m, s, dg ORDER BY lo) > 1, true) AS f FROM r5),
pg AS (SELECT *, count(*) FILTER (WHERE f) OVER (PARTITION BY m, s, dg ORDER BY lo) AS g FROM st),
rf AS (SELECT m, s, dg, min(lo) AS lo, max(hi) AS hi FROM pg GROUP BY m, s, dg, g HAVING sum(hi - lo) >= 12),
sp AS (SELECT m, s, i - j AS dg, i AS lo, i + n AS hi FROM runs)"""
GROUPS = f"""{PASSAGES}, nn AS (SELECT *, row_number() OVER (ORDER BY m, s, dg, lo, ref) AS id FROM (SELECT *, true AS ref FROM rf UNION ALL SELECT *, false FROM sp)),
ed AS (SELECT a.id AS a, b.id AS b FROM nn a JOIN nn b ON a.m = b.m AND a.s = b.s AND a.ref <> b.ref WHERE 2 * (least(a.hi, b.hi) - greatest(a.lo, b.lo)) >= least(a.hi - a.lo, b.hi - b.lo)
  AND 2 * (least(a.hi - a.dg, b.hi - b.dg) - greatest(a.lo - a.dg, b.lo - b.dg)) >= least(a.hi - a.lo, b.hi - b.lo)),
re AS (SELECT id, id AS c FROM nn UNION SELECT ed.b, re.c FROM re JOIN ed ON ed.a = re.id),
gr AS (SELECT nn.*, c FROM nn JOIN (SELECT id, min(c) AS c FROM re GROUP BY id) USING (id)),
wd AS (SELECT c, pos, bool_or(ref) AS r, bool_or(NOT ref) AS d FROM (SELECT c, ref, unnest(range(lo, hi)) AS pos FROM gr) GROUP BY c, pos),
wb AS (SELECT *, min(pos) FILTER (WHERE r AND d) OVER (PARTITION BY c) AS c0, max(pos) FILTER (WHERE r AND d) OVER (PARTITION BY c) AS c1 FROM wd),
sz AS (SELECT c, count(*) FILTER (WHERE r) AS rw, count(*) FILTER (WHERE d) AS dw, count(*) FILTER (WHERE r AND d) AS sw, count(*) AS u, min(pos) FILTER (WHERE r) AS r0, max(pos) FILTER (WHERE r) AS r1,
  min(pos) FILTER (WHERE d) AS d0, max(pos) FILTER (WHERE d) AS d1, count(*) FILTER (WHERE r <> d AND pos BETWEEN c0 AND c1) AS q FROM wb GROUP BY c),
gp AS (SELECT c, m, s, min(lo) AS "first", count(*) FILTER (WHERE ref) AS passages, count(*) FILTER (WHERE NOT ref) AS detections FROM gr GROUP BY c, m, s)
SELECT m, s, "first", CASE WHEN detections = 0 THEN 'B' WHEN passages = 0 THEN 'C' WHEN (sw > 0 AND abs(r0 - d0) <= 2 AND abs(r1 - d1) <= 2 AND q = 0) OR 10 * sw >= 8 * u THEN 'A' ELSE 'D' END AS category,
 passages, detections, rw AS reference_words, dw AS detector_words, sw AS shared_words FROM gp JOIN sz USING (c)"""
METRICS = f"""{PASSAGES}, gd AS (SELECT DISTINCT m, s, unnest(range(lo, hi)) AS p FROM rf), pr AS (SELECT DISTINCT m, s, unnest(range(lo, hi)) AS p FROM sp), al AS (SELECT * FROM gd UNION SELECT * FROM pr),
wm AS (SELECT s, length(replace(dt.w, '''', '')) AS chars, (m, s, p) IN (SELECT (m, s, p) FROM pr) AS pd, (m, s, p) IN (SELECT (m, s, p) FROM gd) AS g,
  (m, s, p // {PAGE}) IN (SELECT (m, s, p // {PAGE}) FROM gd) AS o, s % 2 = 1 AND (m, p) IN (SELECT (m, p) FROM gd WHERE s % 2 = 0) AS x FROM al JOIN dt USING (m) WHERE dt.i = p),
me AS (SELECT s, coalesce(sum(chars) FILTER (WHERE NOT x AND pd AND g), 0)::BIGINT AS matched, coalesce(sum(chars) FILTER (WHERE NOT x AND g), 0)::BIGINT AS reference,
  coalesce(sum(chars) FILTER (WHERE NOT x AND pd AND o), 0)::BIGINT AS predicted_observed, coalesce(sum(chars) FILTER (WHERE NOT x AND pd AND o AND NOT g), 0)::BIGINT AS additional,
  coalesce(sum(chars) FILTER (WHERE NOT x AND pd AND NOT o), 0)::BIGINT AS outside, coalesce(sum(chars) FILTER (WHERE x), 0)::BIGINT AS leakage FROM wm GROUP BY s)"""
CONTEXT = rf"""WITH {RUNS}, pc AS (SELECT doc_id AS m, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS k FROM (SELECT doc_id, regexp_extract_all(text, '{PIECE_SQL}') AS ps FROM documents)),
e AS (SELECT m, k, sum(length(piece)) OVER (PARTITION BY m ORDER BY k) AS e, length(regexp_extract(piece, '{WORD_SQL}')) AS l FROM pc),
x AS (SELECT r.m, r.s, r.i, r.j, (a.e - a.l)::BIGINT AS ms, b.e::BIGINT AS me, d.text FROM runs r JOIN e a ON a.m = r.m AND a.k = r.i JOIN e b ON b.m = r.m AND b.k = r.i + r.n - 1 JOIN documents d ON d.doc_id = r.m),
y AS (SELECT *, greatest(ms - 600, 0) AS l, substring(text, greatest(ms - 600, 0) + 1, ms - greatest(ms - 600, 0)) AS bef, substring(text, me + 1, 600) AS aft FROM x),
z AS (SELECT *, l + length(regexp_extract(bef, '(?s)^.*(?:[.!?]["”]?\s+|\n[ \t]*\n)')) AS st, regexp_extract(aft, '(?s)^(.*?)(?:([.!?]["”]?)(?:\s|$)|(\n[ \t]*\n))', ['a', 'b', 'c']) AS q FROM y),
v AS (SELECT *, CASE WHEN q.b || q.c <> '' THEN me + length(q.a || q.b || q.c) ELSE least(me + 600, length(text)) END AS en FROM z)
SELECT m, s, i, j, st AS "start", en AS "end", sha256(substring(text, st + 1, en - st)) AS excerpt, ms - st AS highlight FROM v"""
QUERIES = {
    "passage_groups": (passage_groups, GROUPS),
    "position_metrics": (position_metrics, METRICS + " SELECT * FROM me"),
    "position_totals": (position_totals, METRICS + """, ra AS (SELECT *, CASE WHEN reference > 0 THEN matched / reference END AS rc, CASE WHEN predicted_observed > 0 THEN matched / predicted_observed END AS pc FROM me)
SELECT sum(matched)::BIGINT AS matched, sum(reference)::BIGINT AS reference, sum(predicted_observed)::BIGINT AS predicted_observed, sum(additional)::BIGINT AS additional, sum(outside)::BIGINT AS outside,
 sum(leakage)::BIGINT AS leakage, round(avg(rc), 6) AS macro_recall, round(avg(pc), 6) AS macro_precision, count(rc) AS recall_sources, count(pc) AS precision_sources,
 round(sum(matched) / sum(reference), 6) AS micro_recall, round(sum(matched) / sum(predicted_observed), 6) AS micro_precision FROM ra"""),
    "passage_context": (passage_context, CONTEXT),
}
