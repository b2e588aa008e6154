"""Queries over document structure, masks and accounting, on texts built from the documents table.

The tables hold plain prose, so the same expression builds an abstract, a quotation and a reference list around every
whole text in the query and in its SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import align, ledger as L, score as S, structure as R
from loomtext.session import table

BUILT = (
    "concat('A title\\nby somebody\\n\\nAbstract\\nSix words and some more follow here. ', text, '\\n\\n2. Middle part\\nThey said \"', substring(text, 1, 60), '\" again.\\n\\n"
    "References\\n[1] One, A. (2001). First. 10.1234/ab.', doc_id, '.\\n[2] Two, B. (2002). Second.\\nsecond line\\n\\nAppendix A\\nLast words.')"
)
BUILT_SQL = BUILT.replace("\\n", "' || chr(10) || '")


def _built(spark, d):
    text = F.regexp_replace(F.regexp_replace("text", '"', " "), r"\n\s*", "\n")
    return table(spark, d, "documents").select("doc_id", text.alias("text")).select("doc_id", F.expr(BUILT).alias("text"))


def bibliography_segments(spark, d):
    return R.segments(_built(spark, d)).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))


def reference_entries(spark, d):
    docs = _built(spark, d)
    return R.references(docs, R.segments(docs)).select("doc_id", "ref_no", "doi", F.length("raw").cast("long").alias("n_chars"))


def _masked(spark, d):
    """The masked ledger of the built texts, whose line behind the abstract's heading is prose even if it ends in a number."""
    return R.ledger_with_masks(_built(spark, d), contents=R.BARE_CONTENTS)


def abstract_front_matter(spark, d):
    docs = _built(spark, d)
    return R.abstract_start(docs, R.segments(docs), R.BARE_CONTENTS)


def mask_regions(spark, d):
    t = _masked(spark, d)
    return L.run_length(t, "front", "bibliography", "quoted")


def word_accounting(spark, d):
    return S.accounting(_masked(spark, d))


def boundary_regions(spark, d):
    docs = _built(spark, d)
    return R.region_counts(R.marked_texts(docs, R.segments(docs)), "bibliography", "quoted")


def logical_view(spark, d):
    """Places of the words that are left when running text loses its front matter: first and last original place."""
    from pyspark.sql import Window

    t = _masked(spark, d).where(~F.col("front"))
    t = t.withColumn("logical", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1)
    return t.groupBy("doc_id").agg(F.max("logical").alias("last_logical"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def interval_union(spark, d):
    """Union of two families of overlapping intervals of every document."""
    spans = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest((F.length("text") / 50).cast("int"), F.lit(1)))).alias("k"))
    spans = spans.select("doc_id", (F.col("k") * 50 + F.pmod(F.col("doc_id") * 7 + F.col("k") * 13, F.lit(40))).cast("int").alias("s"), F.pmod(F.col("doc_id") + F.col("k") * 11, F.lit(60)).cast("int").alias("n"))
    return L.merge_intervals(spans.select("doc_id", "s", (F.col("s") + F.col("n")).alias("e")))


def page_lookup(spark, d):
    """Page of every thousandth character of each conversation laid out as pages."""
    from pyspark.sql import Window

    p = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    before = F.coalesce(F.sum(F.length("text") + 2).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = p.select("doc_id", "page", before.alias("a"), (before + F.length("text") + 2).alias("b"))
    n = p.groupBy("doc_id").agg(F.max("b").alias("n"))
    at = n.select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"), F.lit(1000))).alias("at"))
    return at.join(p, "doc_id").where("at >= a AND at < b").select("doc_id", "at", "page")


def running_headers(spark, d):
    """Headers confirmed by their page counter, on conversations given a numbered first line."""
    p = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), F.expr("concat(CASE WHEN turn % 3 = 2 THEN 'Some other line' ELSE concat('Journal of tests ', turn + 1) END, '\\n', text, '\\nlast line.\\nend')").alias("text"))
    return R.running_headers(p)


def token_offsets(spark, d):
    t = L.offset_ledger(table(spark, d, "documents"))
    return t.groupBy("doc_id").agg(F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.count(F.lit(1)).alias("n"))


def hyphen_joins(spark, d):
    """Words broken at a line end whose joined spelling stands unbroken in the corpus and is nowhere hyphenated in a line."""
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"(th)(er[a-z]+) ", "$1-\n$2 ").alias("cut"), "text").select("doc_id", F.concat_ws("\n", "cut", "text").alias("text"))
    joined = lambda pattern, a, b: F.lower(F.concat(F.regexp_extract("x", pattern, a), F.regexp_extract("x", pattern, b)))
    part = lambda pattern: docs.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("x"))
    broken = r"([\p{L}\p{N}]+)-[ \t]*\r?\n[ \t]*(\p{L}+)"
    inline = r"([\p{L}\p{N}]+)-([\p{L}\p{N}]+)"
    cand = part(broken).select(joined(broken, 1, 2).alias("w")).distinct()
    compound = part(inline).select(joined(inline, 1, 2).alias("w")).distinct()
    return cand.join(L.ledger(docs).select("w").distinct(), "w", "left_semi").join(compound, "w", "left_anti")


def segment_violations(spark, d):
    """Segments that reach outside their text or overlap the one before: a valid corpus has none."""
    from pyspark.sql import Window

    docs = _built(spark, d)
    s = R.segments(docs).join(docs.select("doc_id", F.length("text").alias("n")), "doc_id")
    s = s.withColumn("prev", F.lag("end").over(Window.partitionBy("doc_id").orderBy("start")))
    return s.groupBy().agg(F.count(F.lit(1)).alias("segments"), F.count_if((F.col("start") < F.coalesce("prev", F.lit(0))) | (F.col("end") > F.col("n")) | (F.col("start") >= F.col("end"))).alias("violations"))


def excerpts(spark, d):
    """Excerpt of up to 40 characters around every document's first 'the', with the highlight moved along."""
    at = F.locate("the", F.col("text")) - 1
    rows = table(spark, d, "documents").select("doc_id", "text", at.alias("at")).where("at >= 0")
    lo = F.greatest(F.col("at") - 20, F.lit(0))
    return rows.select("doc_id", F.col("text").substr(lo + 1, F.lit(43)).alias("excerpt"), (F.col("at") - lo).alias("start"), (F.col("at") - lo + 3).alias("end"))


def csv_neutralize(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.element_at(F.array(F.lit("="), F.lit("+"), F.lit("x"), F.lit("-"), F.lit("@")), (F.col("doc_id") % 5 + 1).cast("int")), F.col("source")).alias("c"))
    return rows.select("doc_id", T.csv_safe(F.col("c")).alias("cell"))


LINES = f"""t AS (SELECT doc_id, {BUILT_SQL} AS text FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '"', ' ', 'g'), '\\n\\s*', chr(10), 'g') AS text FROM documents)),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM t),
l AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM l0),
mk AS (SELECT doc_id, max(k) AS last, max(k) FILTER (WHERE trim(line) = 'References') AS rk, max(st) FILTER (WHERE trim(line) = 'References') AS rs,
  max(k) FILTER (WHERE trim(line) = 'Appendix A') AS ak, max(st) FILTER (WHERE trim(line) = 'Appendix A') AS aps, min(st) FILTER (WHERE trim(line) = 'Abstract') AS fs FROM l GROUP BY doc_id)"""
#: Reference texts are built, so their spans follow from where their headings stand.
MASKED = f"""{LINES}, p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\p{{L}}\\p{{N}}]*[\\p{{L}}\\p{{N}}]+(?:[''’][\\p{{L}}\\p{{N}}]+)*')) AS piece, generate_subscripts(regexp_extract_all(text, '[^\\p{{L}}\\p{{N}}]*[\\p{{L}}\\p{{N}}]+(?:[''’][\\p{{L}}\\p{{N}}]+)*'), 1) - 1 AS pos FROM t),
q AS (SELECT doc_id, pos, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM p),
qt AS (SELECT doc_id, instr(text, '"') - 1 AS a, instr(text, '" again.') AS b FROM t),
w AS (SELECT q.doc_id, q.pos, coalesce(e <= mk.fs, false) AS front, e > mk.rs AND e <= mk.aps AS bibliography, e > qt.a AND e <= qt.b AS inq FROM q JOIN mk USING (doc_id) JOIN qt USING (doc_id)),
m AS (SELECT *, inq AND count(*) FILTER (WHERE inq) OVER (PARTITION BY doc_id) > 3 AS quoted FROM w)"""
QUERIES = {
    "bibliography_segments": (bibliography_segments, None),
    "reference_entries": (reference_entries, "SELECT doc_id, 1 AS ref_no, '10.1234/ab.' || doc_id AS doi, length('[1] One, A. (2001). First. 10.1234/ab.' || doc_id || '.') AS n_chars FROM documents UNION ALL SELECT doc_id, 2, NULL, length('[2] Two, B. (2002). Second. second line') FROM documents"),
    "abstract_front_matter": (abstract_front_matter, "SELECT doc_id, length('A title by somebody  ') AS front_end FROM documents"),
    "mask_regions": (mask_regions, f"""WITH {MASKED}, g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, front, bibliography, quoted ORDER BY pos) AS g FROM m)
SELECT doc_id, front, bibliography, quoted, min(pos) AS lo, max(pos) + 1 AS hi FROM g GROUP BY doc_id, front, bibliography, quoted, g"""),
    "word_accounting": (word_accounting, f"""WITH {MASKED} SELECT doc_id, count(*) AS total_words, count(*) FILTER (WHERE NOT front) AS scoped_words, count(*) FILTER (WHERE NOT (front OR bibliography OR quoted)) AS eligible_words,
 count(*) FILTER (WHERE front) AS front_matter_words, count(*) FILTER (WHERE NOT front AND bibliography) AS excluded_bibliography_words, count(*) FILTER (WHERE NOT front AND NOT bibliography AND quoted) AS excluded_quotation_words,
 0::BIGINT AS other_excluded_words, 0::BIGINT AS violations FROM m GROUP BY doc_id"""),
    "boundary_regions": (boundary_regions, f"""WITH {MASKED}, c AS (SELECT doc_id, bibliography, quoted, lag(bibliography) OVER o AS pb, lag(quoted) OVER o AS pq FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, 1 + count(*) FILTER (WHERE pb <> bibliography OR pq <> quoted) AS regions FROM c GROUP BY doc_id"""),
    "logical_view": (logical_view, f"WITH {MASKED} SELECT doc_id, count(*) - 1 AS last_logical, min(pos) AS first_pos, max(pos) AS last_pos FROM m WHERE NOT front GROUP BY doc_id"),
    "interval_union": (interval_union, """WITH k AS (SELECT doc_id, unnest(range(0, greatest(length(text) // 50, 1) + 1)) AS k FROM documents), s AS (SELECT doc_id, k * 50 + (doc_id * 7 + k * 13) % 40 AS s, (doc_id + k * 11) % 60 AS n FROM k),
o AS (SELECT doc_id, s, s + n AS e, CASE WHEN s > max(s + n) OVER (PARTITION BY doc_id ORDER BY s, s + n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM s),
g AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY s, e) AS g FROM o) SELECT doc_id, min(s) AS s, max(e) AS e FROM g GROUP BY doc_id, g"""),
    "page_lookup": (page_lookup, """WITH p AS (SELECT conv_id AS doc_id, turn AS page, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a, length(text) + 2 AS n FROM conversations),
t AS (SELECT doc_id, unnest(range(0, (max(a + n))::BIGINT, 1000)) AS at FROM p GROUP BY doc_id) SELECT t.doc_id, "at", page FROM t JOIN p ON p.doc_id = t.doc_id AND "at" >= a AND "at" < a + n"""),
    "running_headers": (running_headers, """WITH c AS (SELECT conv_id AS doc_id, turn + 1 AS page FROM conversations WHERE turn % 3 <> 2 AND text IS NOT NULL), n AS (SELECT doc_id FROM c GROUP BY doc_id HAVING count(DISTINCT page) >= 2)
SELECT DISTINCT doc_id, page, 'top' AS edge, 'journal of tests' AS identity FROM c JOIN n USING (doc_id)"""),
    "token_offsets": (token_offsets, r"""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\p{L}\p{N}]*[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*')) AS piece, generate_subscripts(regexp_extract_all(text, '[^\p{L}\p{N}]*[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*'), 1) AS k FROM documents),
e AS (SELECT doc_id, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM p)
SELECT doc_id, sum(e - length(regexp_extract(piece, '[\p{L}\p{N}].*$')))::BIGINT AS starts, sum(e)::BIGINT AS ends, count(*) AS n FROM e GROUP BY doc_id"""),
    "hyphen_joins": (hyphen_joins, r"""WITH t AS (SELECT regexp_replace(text, '(th)(er[a-z]+) ', '\1-' || chr(10) || '\2 ', 'g') || chr(10) || text AS text FROM documents),
c AS (SELECT DISTINCT lower(regexp_replace(x, '-[ \t]*\r?\n[ \t]*', '')) AS w FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}]+-[ \t]*\r?\n[ \t]*\p{L}+')) AS x FROM t)),
i AS (SELECT DISTINCT lower(replace(x, '-', '')) AS w FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}]+-[\p{L}\p{N}]+')) AS x FROM t)),
k AS (SELECT DISTINCT unnest(regexp_extract_all(replace(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), '’', ''''), '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*')) AS w FROM t) SELECT w FROM c WHERE w IN (SELECT w FROM k) AND w NOT IN (SELECT w FROM i)"""),
    "segment_violations": (segment_violations, None),
    "excerpts": (excerpts, """WITH a AS (SELECT doc_id, text, instr(text, 'the') - 1 AS p FROM documents WHERE instr(text, 'the') > 0)
SELECT doc_id, substring(text, greatest(p - 20, 0) + 1, 43) AS excerpt, p - greatest(p - 20, 0) AS "start", p - greatest(p - 20, 0) + 3 AS "end" FROM a"""),
    "csv_neutralize": (csv_neutralize, "SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN '' ELSE '''' END || ['=', '+', 'x', '-', '@'][doc_id % 5 + 1] || source AS cell FROM documents"),
    "quotation_spans": (lambda s, d: align.spans_of(_built(s, d), "quotation"), None),
    "citation_spans": (lambda s, d: align.spans_of(_built(s, d), "citation"), None),
    "full_citation_spans": (lambda s, d: align.spans_of(_built(s, d), "full-citation"), None),
    "author_year_units": (lambda s, d: align.spans_of(_built(s, d), "unit"), None),
}
