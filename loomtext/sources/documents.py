"""Document sources: text files, conversations laid out as pages, and checked corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def text_files(spark: SparkSession, path: str, most_bytes: int = 40 * 1024 * 1024) -> DataFrame:
    """(path, text, status) of whole text files: byte-order marks are obeyed, line ends become \\n; status says why a text is null.

    Files over `most_bytes`, with NUL characters or without text are listed, not dropped.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    mark = F.hex(F.substring("content", 1, 3))
    text = (
        F.when(mark.startswith("EFBBBF"), F.decode(F.expr("substring(content, 4)"), "UTF-8"))
        .when(mark.startswith("FFFE") | mark.startswith("FEFF"), F.decode("content", "UTF-16"))
        .when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    )
    text = F.regexp_replace(text, "\r\n?", "\n")
    status = (
        F.when(F.col("length") > most_bytes, "too-large").when(F.col("text").isNull(), "not-text").when(F.instr("text", "\u0000") > 0, "not-text")
        .when(F.col("text").rlike(r"^\s*$"), "empty").otherwise("ok")
    )
    rows = files.withColumn("text", F.when(F.col("length") <= most_bytes, text)).withColumn("status", status)
    return rows.select("path", F.when(F.col("status") == "ok", F.col("text")).alias("text"), "status")


def pages_to_documents(pages: DataFrame, by: str = "doc_id", order: str = "page") -> DataFrame:
    """(by, text, pages): pages joined by a blank line, with the offset at which each starts."""
    rows = pages.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("number"), F.coalesce("text", F.lit("")).alias("text")))).alias("ps"))
    starts = F.transform("ps", lambda p, k: F.struct(p["number"].alias("number"), F.aggregate(F.slice("ps", F.lit(1), k), F.lit(0), lambda s, q: s + F.length(q["text"]) + 2).alias("start")))
    return rows.select(by, F.array_join("ps.text", "\n\n").alias("text"), starts.alias("pages"))


def title_of(text):
    """First line that is not blank, at most 500 characters."""
    return F.substring(F.trim(F.regexp_extract(text, r"(?m)^\s*(\S[^\n]*)$", 1)), 1, 500)


#: Licences that a public corpus may carry.
LICENCES = ("CC-BY-4.0", "CC-BY-3.0", "CC-BY-SA-4.0", "CC0-1.0", "Public-Domain")


def corpus_violations(entries: DataFrame, texts: DataFrame, licences: tuple[str, ...] = LICENCES) -> DataFrame:
    """(sha256, reason) of manifest entries that a corpus must not have: no text of that hash, a licence not listed, an
    address that is not secure, or a hash that stands twice. entries: (sha256, licence, url); texts: (text)."""
    known = texts.select(F.sha2("text", 256).alias("sha256")).distinct().withColumn("there", F.lit(True))
    twice = entries.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"))
    e = entries.join(known, "sha256", "left").join(twice, "sha256", "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("there").isNull(), "no-text"), F.when(~F.col("licence").isin(*licences), "licence"),
        F.when(~F.col("url").startswith("https://"), "address"), F.when(F.col("copies") > 1, "duplicate"),
    ))
    return e.select("sha256", F.explode(reasons).alias("reason")).distinct()


def stale(cache: DataFrame, texts: DataFrame, parser_version: str, structure_version: int = 3) -> DataFrame:
    """Texts whose structure is not cached under their hash and the versions given. cache: (sha256, parser, structure)."""
    now = cache.where((F.col("parser") == parser_version) & (F.col("structure") == structure_version)).select("sha256")
    return texts.withColumn("sha256", F.sha2("text", 256)).join(now, "sha256", "left_anti")
