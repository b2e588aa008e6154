"""Web pages as a source: publisher links and addresses that are safe to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://(?:[^/@]*@)?([^/:?#]+)", 1))


def site(url: Column) -> Column:
    """The last two labels of the host, by which pages of one publisher are known."""
    return F.regexp_extract(host(url), r"([^.]+\.[^.]+)$", 1)


def same_site_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, link): the first secure PDF address that a page names and that lies on its own site."""
    tags = F.regexp_extract_all("html", F.lit(r"(?i)<meta[^>]*name=[\"']citation_pdf_url[\"'][^>]*>"), F.lit(0))
    links = F.transform(F.slice(tags, 1, 3), lambda t: F.regexp_extract(t, r"(?i)content=[\"']([^\"']+)[\"']", 1))
    here = pages.select("page_id", "url", links.alias("links"))
    own = F.filter("links", lambda x: x.startswith("https://") & ~x.rlike(r"^https://[^/]*@") & (site(x) == site(F.col("url"))))
    return here.select("page_id", "url", F.get(own, F.lit(0)).alias("link")).where("link IS NOT NULL")


def public_url(url: Column) -> Column:
    """The address without user data, fragment or any query item but DOI and format selectors."""
    bare = F.regexp_replace(url, "#.*$", "")
    head, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    items = F.filter(F.split(query, r"[&?]"), lambda q: q.rlike(r"^(?:id|doi)=10\.[0-9]{4,9}(?:/|%2F)\S+$") | q.rlike(r"^type=(?:printable|pdf)$"))
    kept = F.array_join(items, "&")
    return F.when(url.rlike(r"^[a-z]+://[^/]*@"), "(invalid source URL)").otherwise(F.concat(head, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def jats_text(docs: DataFrame, id_col: str = "id", xml_col: str = "xml", least_words: int = 200) -> DataFrame:
    """(id, text, ok): plain body text of article XML; not ok without a body, with entities, or under `least_words` words."""
    body = F.regexp_extract(xml_col, r"(?s)<body[^>]*>(.*)</body>", 1)
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"</(?:p|title|sec)>", "\n"), "<[^>]+>", ""), r"[ \t]+", " "))
    safe = ~F.col(xml_col).contains("<!ENTITY") & (body != "") & (F.size(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))) >= least_words)
    return docs.select(F.col(id_col).alias("id"), F.when(safe, text).alias("text"), safe.alias("ok"))
