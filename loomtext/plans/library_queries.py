"""Queries over library selections, projections, ledgers' hashes and evaluation splits, with SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from loomtext.functions import text as T
from loomtext.operators import catalog as C, overlap as O
from loomtext.plans.overlap_queries import D, RUNS
from loomtext.session import table


def ledger_hashes(spark, d):
    """SHA-256 of every document's words as compact JSON."""
    return table(spark, d, "documents").select("doc_id", T.ledger_hash(F.col("text")).alias("ledger_hash"))


def numeric_prefixes(spark, d):
    """Neighbouring different numerals of a document whose common beginning reaches past a decimal mark."""
    numbers = F.regexp_extract_all(F.col("text"), F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0))
    n = table(spark, d, "documents").select("doc_id", numbers.alias("n")).where("size(n) > 1")
    pairs = n.select("doc_id", F.explode(F.zip_with(F.slice("n", 1, F.size("n") - 1), F.slice("n", 2, F.size("n") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p")).select("doc_id", "p.*")
    return pairs.withColumn("prefix", T.numeric_prefix(F.col("a"), F.col("b"))).where("prefix > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.max("prefix").alias("longest"))


def allow_listed_pages(spark, d):
    """Pages whose id stands on the allow list: the English documents."""
    allowed = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("page_id"), "source").distinct()
    return table(spark, d, "pages").select("page_id", "url").join(allowed, "page_id")


def allow_list_missing(spark, d):
    """Entries of the allow list without a page: none may be missing before a seed is published."""
    allowed = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("page_id")).distinct()
    return allowed.join(table(spark, d, "pages"), "page_id", "left_anti")


def collection_selection(spark, d):
    """Selected documents that are allowed (they have a label), one for each fingerprint: the smallest id."""
    docs = table(spark, d, "documents").where("doc_id % 3 = 0").join(table(spark, d, "labels"), "doc_id", "left_semi")
    return docs.groupBy(T.fingerprint(F.col("text")).alias("fingerprint")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def stale_selection(spark, d):
    """Users whose selected event, the first, is no longer their latest."""
    events = table(spark, d, "events")
    selected = C.first_seen(events, "user_id", "ts", "event_id").select("user_id", "event_id")
    return selected.join(C.latest(events, "user_id", "ts", "event_id").select("user_id", "event_id"), ["user_id", "event_id"], "left_anti")


def public_records(spark, d):
    """Documents without what only the library itself may see."""
    return table(spark, d, "documents").drop("text", "source")


def reader_filter(spark, d):
    """Sources found by a search over number and text."""
    return table(spark, d, "benchmark").where(F.contains(T.fold(F.concat_ws(" ", F.col("item_id").cast("string"), "text")), F.lit("the"))).select("item_id")


def save_log(spark, d):
    """The log of the latest state of each receipt, bounded to the newest 100."""
    return C.latest(table(spark, d, "events"), "user_id", "ts", "event_id").orderBy(F.desc("ts"), "user_id").limit(100).select("user_id", "event_id", "event_type")


def split_leakage(spark, d):
    """For each source, matched places of the development split (even manuscripts), of validation, and of both: the leakage."""
    runs = O.exact_runs(table(spark, d, "documents").select("doc_id", "text"), O.sources_of(table(spark, d, "benchmark")))
    at = runs.select("s", (F.col("m") % 2 == 0).alias("dev"), F.explode(F.sequence(F.col("j"), (F.col("j") + F.col("n") - 1).cast("int"))).alias("j"))
    places = at.groupBy("s", "j").agg(F.max("dev").alias("dev"), F.max(~F.col("dev")).alias("val"))
    return places.groupBy("s").agg(F.count_if("dev").alias("development"), F.count_if("val").alias("validation"), F.count_if(F.col("dev") & F.col("val")).alias("leakage"))


def source_shares(spark, d):
    """Each source's share of a manuscript's matched words against all its sources: micro over words, macro over manuscripts."""
    words = O.matched_words(O.exact_runs(table(spark, d, "documents").select("doc_id", "text"), O.sources_of(table(spark, d, "benchmark"))))
    per = words.groupBy("m", "s").agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("part", F.col("n") / F.sum("n").over(Window.partitionBy("m")))
    return per.groupBy("s").agg(F.sum("n").cast("long").alias("words"), F.round(F.avg("part"), 6).alias("macro"))


NUMBERS = r"regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')"
QUERIES = {
    "ledger_hashes": (ledger_hashes, f"WITH {D} SELECT m AS doc_id, sha256(CAST(to_json(w) AS VARCHAR)) AS ledger_hash FROM d"),
    "numeric_prefixes": (numeric_prefixes, f"""WITH n AS (SELECT doc_id, {NUMBERS} AS n FROM documents),
p AS (SELECT doc_id, n[k] AS a, n[k + 1] AS b FROM (SELECT doc_id, n, unnest(range(1, len(n))) AS k FROM n)),
c AS (SELECT doc_id, list_max(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: a[1:k] = b[1:k])) AS k, a FROM p WHERE a <> b)
SELECT doc_id, count(*) AS n_pairs, max(k) AS longest FROM c WHERE regexp_matches(a[1:k], '[.,]') GROUP BY doc_id"""),
    "allow_listed_pages": (allow_listed_pages, "SELECT p.page_id, url, source FROM pages p JOIN (SELECT DISTINCT doc_id, source FROM documents WHERE lang = 'en') a ON a.doc_id = p.page_id"),
    "allow_list_missing": (allow_list_missing, "SELECT DISTINCT doc_id AS page_id FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT page_id FROM pages)"),
    "collection_selection": (collection_selection, f"""WITH {D} SELECT sha256(array_to_string(w, ' ')) AS fingerprint, min(m) AS doc_id, count(*) AS copies FROM d
WHERE m % 3 = 0 AND m IN (SELECT doc_id FROM labels) GROUP BY 1"""),
    "stale_selection": (stale_selection, """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS l FROM events) SELECT user_id, event_id FROM r WHERE f = 1 AND l <> 1"""),
    "public_records": (public_records, "SELECT doc_id, lang, n_chars FROM documents"),
    "reader_filter": (reader_filter, "SELECT item_id FROM benchmark WHERE contains(lower(item_id || ' ' || text), 'the')"),
    "save_log": (save_log, """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
WHERE r = 1 ORDER BY ts DESC, user_id LIMIT 100"""),
    "split_leakage": (split_leakage, f"""WITH {RUNS}, hit AS (SELECT s, m % 2 = 0 AS dev, unnest(range(j, j + n)) AS j FROM runs),
pl AS (SELECT s, j, bool_or(dev) AS dev, bool_or(NOT dev) AS val FROM hit GROUP BY s, j)
SELECT s, count(*) FILTER (WHERE dev) AS development, count(*) FILTER (WHERE val) AS validation, count(*) FILTER (WHERE dev AND val) AS leakage FROM pl GROUP BY s"""),
    "source_shares": (source_shares, f"""WITH {RUNS}, per AS (SELECT m, s, count(*) AS n FROM pos GROUP BY m, s)
SELECT s, sum(n)::BIGINT AS words, round(avg(part), 6) AS macro FROM (SELECT *, n / sum(n) OVER (PARTITION BY m) AS part FROM per) GROUP BY s"""),
}
