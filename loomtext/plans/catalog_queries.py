"""Queries over the catalogue, imports, quotas and queues, with SQL counterparts.

Papers are made of the pages table (a page's address holds its DOI, its heading is its title), events stand for requests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import catalog as C
from loomtext.sources import html as H
from loomtext.session import table

TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
DOI = "concat('https://doi.org/10.1000/AB.', cast(page_id % 97 AS string), CASE WHEN page_id % 3 = 0 THEN ').' ELSE '' END)"
DOI_SQL = "'https://doi.org/10.1000/AB.' || (page_id % 97) || CASE WHEN page_id % 3 = 0 THEN ').' ELSE '' END"
DAY, MINUTE = 86_400, 60


def _papers(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), F.expr(DOI).alias("doi"), F.expr(TITLE).alias("title"), "url", F.pmod("page_id", F.lit(7)).alias("created_at"))


def doi_normalize(spark, d):
    return _papers(spark, d).select("id", T.doi_key(F.col("doi")).alias("doi_key"), T.title_key(F.col("title")).alias("title_key"))


def doi_list_preview(spark, d):
    """Valid distinct DOIs in order of first place, invalid and repeated ones by place, of a pasted list."""
    from pyspark.sql import Window

    t = _papers(spark, d).select((F.col("id") + 1).alias("position"), F.when(F.col("id") % 5 == 0, F.lit("not-a-doi")).otherwise(F.concat(F.lit("doi:10.1000/x"), (F.col("id") % 31).cast("string"))).alias("token"))
    value = F.regexp_replace(F.lower("token"), "^doi:", "")
    t = t.withColumn("doi", F.when(value.rlike(r"^10\.[0-9]{4,9}/[!-~]+$"), value))
    r = F.row_number().over(Window.partitionBy("doi").orderBy("position"))
    return t.select("position", "doi", F.when(F.col("doi").isNull(), "invalid").when(r == 1, "kept").otherwise("duplicate").alias("outcome"))


def paper_components(spark, d):
    p = _papers(spark, d).select("id", F.array("doi").alias("dois"), F.array("title").alias("titles"))
    return C.paper_groups(p)


def paper_merge(spark, d):
    p = _papers(spark, d).select("id", F.array(T.doi_key(F.col("doi"))).alias("dois"), F.array(T.title_key(F.col("title"))).alias("titles"), F.when(F.col("id") % 2 == 1, 2000 + F.col("id") % 20).alias("year"), F.array("url").alias("urls"))
    m = C.merge_papers(p, C.paper_groups(p))
    return m.select("id", F.size("dois").cast("long").alias("n_dois"), "year", F.array_join("urls", " ").alias("urls"), "records")


def reference_resolution(spark, d):
    refs = _papers(spark, d).select(F.col("id").alias("ref"), F.when(F.col("id") % 2 == 0, F.col("doi")).alias("doi"), "title")
    return C.resolve_references(refs, _papers(spark, d).where("id % 4 <> 1"))


def _altered(spark, d):
    """References to the papers whose titles have lost or changed letters, some beyond recognition."""
    title = F.when(F.col("id") % 5 == 0, F.reverse("title")).when(F.col("id") % 3 == 0, F.regexp_replace("title", "[ae]", "")).otherwise(F.regexp_replace("title", "th", "zz"))
    return _papers(spark, d).select(F.col("id").alias("ref"), F.when(F.col("id") % 7 == 0, F.col("doi")).alias("doi"), title.alias("title"))


def title_candidates(spark, d):
    """Pairs of an altered title and a paper's title that share enough pieces to be compared."""
    key = lambda df: df.select(T.title_key(F.col("title")).alias("key"))
    return C.similar_titles(key(_altered(spark, d)), key(_papers(spark, d)))


def similar_reference_resolution(spark, d):
    """References by DOI, else by an exact title of one paper, else by the closest title."""
    return C.resolve_similar(_altered(spark, d), _papers(spark, d).where("id % 4 <> 1"))


def library_search(spark, d):
    return C.search(_papers(spark, d), "THE", 20, 5).select("id", "title")


def fifo_queue(spark, d):
    return _papers(spark, d).orderBy("created_at", "id").limit(50).select("id", "created_at")


def newest_jobs(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(15).select("event_id", "user_id")


def upsert_latest(spark, d):
    return C.latest(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


def idempotent_first(spark, d):
    e = table(spark, d, "events").withColumn("k", F.concat_ws("|", "user_id", "props"))
    return C.first_seen(e, "k", "ts", "event_id").select("k", "event_id")


def rolling_quota(spark, d):
    """Requests of the same user in the day up to each request, and whether the limit of 50 is passed."""
    r = C.rolling(table(spark, d, "events"), "user_id", DAY)
    return r.select("event_id", "n", (F.col("n") > 50).alias("over"))


def rate_limit(spark, d):
    """Requests refused in the minute up to and with each: over 10 of one owner, or over 30 in all."""
    e = C.rolling(C.rolling(table(spark, d, "events"), "user_id", MINUTE), None, MINUTE, out="total")
    return e.groupBy("user_id").agg(F.max("n").alias("peak"), F.max("total").alias("peak_total"), F.count_if((F.col("n") > 10) | (F.col("total") > 30)).alias("refused"))


def budget_ledger(spark, d):
    e = table(spark, d, "events").withColumn("cost", F.round(F.col("value") * 100).cast("long"))
    return C.rolling(e, "user_id", DAY, "cost", "spent").groupBy("user_id").agg(F.max("spent").alias("peak"))


def retention_filter(spark, d):
    """Events of each kind that outlive their keeping time, counted from the last event."""
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))
    keep = F.when(F.col("event_type") == "view", 3600).when(F.col("event_type") == "click", 4 * 3600).otherwise(DAY).cast("long")
    live = e.crossJoin(F.broadcast(last)).where(F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) <= keep * 1_000_000)
    return live.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def tombstones(spark, d):
    """Users whose last state is not a removal: error events stand for removals."""
    return upsert_latest(spark, d).where("event_type <> 'error'").select("user_id", "event_id")


def host_cooldown(spark, d):
    return _papers(spark, d).select(F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)).alias("host"), "created_at").groupBy("host").agg(F.max("created_at").alias("retry_at"))


def visible_library(spark, d):
    p = _papers(spark, d).select("id", F.sha2("title", 256).alias("sha"), "created_at", F.when(F.col("id") % 3 == 0, "pending").otherwise("ready").alias("state"))
    return C.visible(p.where("id % 2 = 0"), p.where("id % 2 = 1"), p.where("id % 11 = 0")).select("id", "created_at")


def attach_papers(spark, d):
    p = _papers(spark, d).select("id", F.sha2("title", 256).alias("fingerprint"), F.lit("ready").alias("state"))
    return C.attachable(p, p.where("id = 3"), p.where("id % 10 = 0"), 100).select("id")


def manifest_diff(spark, d):
    p = _papers(spark, d).select(F.col("id").alias("reference_id"), F.sha2("title", 256).alias("digest"))
    new = p.where("reference_id % 9 <> 0").withColumn("digest", F.when(F.col("reference_id") % 4 == 0, F.lit("other")).otherwise(F.col("digest")))
    return C.manifest_changes(p.where("reference_id % 7 <> 0"), new)


def collection_readiness(spark, d):
    p = _papers(spark, d).withColumn("f", F.sha2("title", 256)).withColumn("ready", F.col("id") % 3 != 0)
    return p.groupBy().agg(F.count(F.lit(1)).alias("entries"), F.count_if("ready").alias("ready_entries"), F.countDistinct(F.when(F.col("ready"), F.col("f"))).alias("ready_unique"))


def capacity(spark, d):
    return _papers(spark, d).groupBy("created_at").agg(F.count(F.lit(1)).alias("papers"), F.sum(F.length("title")).alias("bytes"))


def coverage_funnel(spark, d):
    s = F.element_at(F.array(*[F.lit(x) for x in ("compared", "compared-with-limits", "excluded-by-user", "unavailable")]), (F.col("id") % 4 + 1).cast("int"))
    n = lambda x: F.count_if(F.col("s") == x)
    return _papers(spark, d).withColumn("s", s).groupBy("created_at").agg(n("compared").alias("compared"), n("compared-with-limits").alias("partial"), n("excluded-by-user").alias("excluded"), n("unavailable").alias("unavailable"))


def split_validation(spark, d):
    """Families that stand in both the development and the validation split: a valid split has none."""
    f = _papers(spark, d).select(T.title_key(F.col("title")).alias("family"), (F.col("id") % 2).alias("split"))
    return f.groupBy("family").agg(F.countDistinct("split").alias("n")).where("n > 1").select("family")


def oa_locations(spark, d):
    """First-seen secure addresses of every paper group, three at most."""
    p = _papers(spark, d).withColumn("g", F.col("id") % 97).where(F.col("url").startswith("https://"))
    u = p.groupBy("g", "url").agg(F.min("id").alias("id")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("id", "url"))).alias("l"))
    return u.select("g", F.array_join(F.slice("l.url", 1, 3), " ").alias("urls"))


def landing_links(spark, d):
    return H.same_site_links(table(spark, d, "pages").select("page_id", "url", F.expr("concat('<meta name=\"citation_pdf_url\" content=\"', CASE WHEN page_id % 2 = 0 THEN concat('https://', parse_url(url, 'HOST'), '/p.pdf') ELSE 'https://elsewhere.test/p.pdf' END, '\">', html)").alias("html"))).select("page_id", "link")


def public_urls(spark, d):
    return table(spark, d, "pages").select("page_id", H.public_url(F.concat("url", F.lit("?type=pdf&token=abc&id=10.1234/x"))).alias("url"))


def method_selection(spark, d):
    """Best method (event kind) of every user by harmonic mean of two rates, ties to the smaller gap, then the name."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("a"), F.countDistinct(F.to_date("ts")).alias("b"))
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct(F.col("a") * F.col("b") * 1000000 / (F.col("a") + F.col("b")), -F.col("a"), F.col("event_type"))).alias("method"))


K = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(title, '<[^>]+>', '', 'g')), '\s*[\[(](?:preprint|accepted manuscript|version\s*[0-9]+|v[0-9]+)[\])]\s*', ' ', 'g'), '[^\p{L}\p{N}_]+', ' ', 'g'), '^ | $', '', 'g'))"""
P = f"p AS (SELECT page_id AS id, {DOI_SQL} AS doi, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url, page_id % 7 AS created_at FROM pages), q AS (SELECT *, '10.1000/ab.' || (id % 97) AS dk, {K} AS tk FROM p)"
ROLL = "SELECT event_id, user_id, event_type, value, {what} OVER (PARTITION BY {by} ORDER BY epoch_us(ts) RANGE BETWEEN {us} PRECEDING AND CURRENT ROW) AS n FROM events"
COMP = f"WITH RECURSIVE {P}, e AS (SELECT a.id AS a, b.id AS b FROM q a JOIN q b ON a.dk = b.dk OR (a.tk = b.tk AND a.tk <> '')), r AS (SELECT id, id AS c FROM q UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id), g AS (SELECT id, min(c) AS component FROM r GROUP BY id)"
QUERIES = {
    "doi_normalize": (doi_normalize, f"WITH {P} SELECT id, dk AS doi_key, tk AS title_key FROM q"),
    "doi_list_preview": (doi_list_preview, """WITH t AS (SELECT page_id + 1 AS position, CASE WHEN page_id % 5 = 0 THEN NULL ELSE '10.1000/x' || (page_id % 31) END AS doi FROM pages)
SELECT position, doi, CASE WHEN doi IS NULL THEN 'invalid' WHEN row_number() OVER (PARTITION BY doi ORDER BY position) = 1 THEN 'kept' ELSE 'duplicate' END AS outcome FROM t"""),
    "paper_components": (paper_components, COMP + " SELECT * FROM g"),
    "paper_merge": (paper_merge, COMP + """, x AS (SELECT g.component, q.id, q.dk, q.url, CASE WHEN q.id % 2 = 1 THEN 2000 + q.id % 20 END AS year FROM g JOIN q USING (id)), u AS (SELECT component, url, min(id) AS f FROM x GROUP BY ALL),
v AS (SELECT component, list(url ORDER BY f)[1:3] AS urls FROM u GROUP BY component) SELECT component AS id, count(DISTINCT dk) AS n_dois, first(year ORDER BY id) FILTER (WHERE year IS NOT NULL) AS year, array_to_string(any_value(urls), ' ') AS urls, count(*) AS records FROM x JOIN v USING (component) GROUP BY component"""),
    "reference_resolution": (reference_resolution, f"""WITH {P}, s AS (SELECT * FROM q WHERE id % 4 <> 1), a AS (SELECT dk, min(id) AS pd FROM s GROUP BY dk), t AS (SELECT tk, min(id) AS pt FROM s WHERE tk <> '' GROUP BY tk HAVING count(*) = 1)
SELECT q.id AS ref, coalesce(pd, pt) AS paper, CASE WHEN pd IS NOT NULL THEN 'doi' WHEN pt IS NOT NULL THEN 'title' ELSE 'none' END AS how FROM q LEFT JOIN a ON a.dk = q.dk AND q.id % 2 = 0 LEFT JOIN t ON t.tk = q.tk"""),
    "title_candidates": (title_candidates, f"""WITH {P}, a AS (SELECT DISTINCT {K} AS t FROM (SELECT CASE WHEN id % 5 = 0 THEN reverse(title) WHEN id % 3 = 0 THEN regexp_replace(title, '[ae]', '', 'g') ELSE replace(title, 'th', 'zz') END AS title FROM p)),
b AS (SELECT DISTINCT tk AS t FROM q), x AS (SELECT t, list_distinct(list_transform(range(1, length(t) + 1), lambda k: substring(' ' || t || ' ', k, 3))) AS g FROM a WHERE t <> ''), y AS (SELECT t, list_distinct(list_transform(range(1, length(t) + 1), lambda k: substring(' ' || t || ' ', k, 3))) AS g FROM b WHERE t <> '')
SELECT x.t AS x, y.t AS y FROM x, y WHERE 100 * len(list_intersect(x.g, y.g)) >= 40 * (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g)))"""),
    "similar_reference_resolution": (similar_reference_resolution, None),
    "library_search": (library_search, f"WITH {P} SELECT id, title FROM p WHERE instr(lower(title), 'the') > 0 OR instr(lower(doi), 'the') > 0 ORDER BY created_at DESC, id LIMIT 20 OFFSET 5"),
    "fifo_queue": (fifo_queue, f"WITH {P} SELECT id, created_at FROM p ORDER BY created_at, id LIMIT 50"),
    "newest_jobs": (newest_jobs, "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 15"),
    "upsert_latest": (upsert_latest, "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "idempotent_first": (idempotent_first, "SELECT user_id || '|' || props AS k, first(event_id ORDER BY ts, event_id) AS event_id FROM events GROUP BY 1"),
    "rolling_quota": (rolling_quota, f"SELECT event_id, n, n > 50 AS over FROM ({ROLL.format(what='count(*)', by='user_id', us=DAY * 1_000_000)})"),
    "rate_limit": (rate_limit, f"""SELECT user_id, max(n) AS peak, max(total) AS peak_total, count(*) FILTER (WHERE n > 10 OR total > 30) AS refused FROM (
  SELECT a.*, b.n AS total FROM ({ROLL.format(what='count(*)', by='user_id', us=MINUTE * 1_000_000)}) a
  JOIN ({ROLL.format(what='count(*)', by='1', us=MINUTE * 1_000_000)}) b USING (event_id)) GROUP BY user_id"""),
    "budget_ledger": (budget_ledger, f"SELECT user_id, max(n)::BIGINT AS peak FROM ({ROLL.format(what='sum(round(value * 100)::BIGINT)', by='user_id', us=DAY * 1_000_000)}) GROUP BY user_id"),
    "retention_filter": (retention_filter, """SELECT event_type, count(*) AS n FROM events, (SELECT max(ts) AS last FROM events) WHERE epoch_us(last) - epoch_us(ts) <= 1000000::BIGINT * CASE event_type WHEN 'view' THEN 3600 WHEN 'click' THEN 14400 ELSE 86400 END GROUP BY event_type"""),
    "tombstones": (tombstones, "SELECT user_id, event_id FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error'"),
    "host_cooldown": (host_cooldown, r"SELECT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host, max(page_id % 7) AS retry_at FROM pages GROUP BY 1"),
    "visible_library": (visible_library, f"""WITH {P}, x AS (SELECT id, sha256(title) AS sha, created_at FROM p), b AS (SELECT * FROM x WHERE id % 2 = 0), t AS (SELECT sha FROM x WHERE id % 11 = 0)
SELECT id, created_at FROM (SELECT * FROM b UNION ALL SELECT * FROM x WHERE id % 2 = 1 AND id % 3 <> 0 AND sha NOT IN (SELECT sha FROM b)) WHERE sha NOT IN (SELECT sha FROM t)"""),
    "attach_papers": (attach_papers, f"""WITH {P}, x AS (SELECT id, sha256(title) AS f FROM p) SELECT min(id) AS id FROM x WHERE f NOT IN (SELECT f FROM x WHERE id = 3 OR id % 10 = 0) GROUP BY f ORDER BY 1 LIMIT 100"""),
    "manifest_diff": (manifest_diff, "SELECT page_id AS reference_id, CASE WHEN page_id % 7 = 0 THEN 'added' WHEN page_id % 9 = 0 THEN 'missing' WHEN page_id % 4 = 0 THEN 'changed' ELSE 'kept' END AS change FROM pages WHERE page_id % 63 <> 0"),
    "collection_readiness": (collection_readiness, f"WITH {P} SELECT count(*) AS entries, count(*) FILTER (WHERE id % 3 <> 0) AS ready_entries, count(DISTINCT title) FILTER (WHERE id % 3 <> 0) AS ready_unique FROM p"),
    "capacity": (capacity, f"WITH {P} SELECT created_at, count(*) AS papers, sum(length(title))::BIGINT AS bytes FROM p GROUP BY created_at"),
    "coverage_funnel": (coverage_funnel, f"WITH {P} SELECT created_at, " + ", ".join(f"count(*) FILTER (WHERE id % 4 = {k}) AS {n}" for k, n in enumerate(("compared", "partial", "excluded", "unavailable"))) + " FROM p GROUP BY created_at"),
    "split_validation": (split_validation, f"WITH {P} SELECT tk AS family FROM q GROUP BY tk HAVING count(DISTINCT id % 2) > 1"),
    "oa_locations": (oa_locations, "WITH u AS (SELECT page_id % 97 AS g, url, min(page_id) AS f FROM pages WHERE starts_with(url, 'https://') GROUP BY ALL) SELECT g, array_to_string(list(url ORDER BY f)[1:3], ' ') AS urls FROM u GROUP BY g"),
    "landing_links": (landing_links, r"SELECT page_id, 'https://' || regexp_extract(url, '^https?://([^/:?#]+)', 1) || '/p.pdf' AS link FROM pages WHERE page_id % 2 = 0"),
    "public_urls": (public_urls, None),
    "method_selection": (method_selection, """WITH e AS (SELECT user_id, event_type, count(*) AS a, count(DISTINCT ts::DATE) AS b FROM events GROUP BY ALL)
SELECT user_id, last(event_type ORDER BY a * b * 1000000 / (a + b), -a, event_type) AS method FROM e GROUP BY user_id"""),
}
