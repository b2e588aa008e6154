"""Retrieval joins and exact runs between manuscripts and sources.

Both sides are small-keyed tables: (doc_id, pos, g) of word runs. Joins are equi-joins on the run, so Spark shuffles on
it or broadcasts the smaller side by its own size estimate, and adaptive execution splits hot runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loomtext.functions import text as T
from loomtext.operators import ledger as L, structure as R


def sources_of(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").alias("doc_id"), "text")


def seeds(manuscripts: DataFrame, sources: DataFrame, k: int, *keep: str) -> DataFrame:
    """(m, s, i, j, keep...): places where k words (g, joined by blanks) of a manuscript equal k words of a source."""
    m = L.grams(manuscripts, k).select(F.col("doc_id").alias("m"), F.col("pos").alias("i"), F.xxhash64("g").alias("h"), "g")
    s = L.grams(sources, k).select(F.col("doc_id").alias("s"), F.col("pos").alias("j"), F.xxhash64("g").alias("h"), F.col("g").alias("g2"))
    return m.join(s, "h").where("g = g2").select("m", "s", "i", "j", *keep)


def exact_runs(manuscripts: DataFrame, sources: DataFrame, k: int = 9) -> DataFrame:
    """(m, s, i, j, n): maximal runs of at least k equal words, from k-word seeds on one diagonal."""
    hit = seeds(manuscripts, sources, k)
    island = F.col("i") - F.row_number().over(Window.partitionBy("m", "s", F.col("i") - F.col("j")).orderBy("i"))
    return (
        hit.withColumn("d", F.col("i") - F.col("j")).withColumn("g", island)
        .groupBy("m", "s", "d", "g").agg(F.min("i").alias("i"), F.min("j").alias("j"), (F.count(F.lit(1)) + k - 1).alias("n")).drop("d", "g")
    )


def matched_words(found: DataFrame) -> DataFrame:
    """(m, s, pos): manuscript words inside the runs, each once a source."""
    return found.select("m", "s", F.explode(F.sequence(F.col("i"), (F.col("i") + F.col("n") - 1).cast("int"))).alias("pos")).distinct()


def window_candidates(manuscripts: DataFrame, sources: DataFrame) -> DataFrame:
    """(m, mlo, s, slo, hits): window pairs by the number of distinct word pairs they share."""

    def shingles(docs: DataFrame, a: str, lo: str) -> DataFrame:
        pairs = L.grams(docs, 2)
        first = F.greatest(F.ceil((F.col("pos") + 2 - 120) / 96), F.lit(0)).cast("int")
        tiles = L.windows(docs).select("doc_id", "lo", "hi")
        at = pairs.select("doc_id", "g", "pos", F.explode(F.sequence(first, F.floor(F.col("pos") / 96).cast("int"))).alias("k"))
        at = at.select("doc_id", "g", "pos", (F.col("k") * 96).alias("lo")).join(tiles, ["doc_id", "lo"]).where(F.col("pos") + 2 <= F.col("hi"))
        return at.select(F.col("doc_id").alias(a), F.col("lo").alias(lo), "g").distinct()

    return shingles(manuscripts, "m", "mlo").join(shingles(sources, "s", "slo"), "g").groupBy("m", "mlo", "s", "slo").agg(F.count(F.lit(1)).alias("hits"))


def sentence_candidates(manuscripts: DataFrame, sources: DataFrame, least: int = 3) -> DataFrame:
    """(m, msent, s, ssent, hits): sentences sharing at least `least` word pairs; a manuscript pair counts each time it stands there."""

    def pairs(docs: DataFrame, a: str, b: str) -> DataFrame:
        w = R.sentences(docs).select(F.col("doc_id").alias(a), F.col("sent").alias(b), T.words(F.col("text")).alias("w")).where(F.size("w") >= 2)
        at = w.select(a, b, "w", F.explode(F.sequence(F.lit(0), F.size("w") - 2)).alias("p"))
        return at.select(a, b, F.concat_ws(" ", F.col("w")[F.col("p")], F.col("w")[F.col("p") + 1]).alias("g"))

    hit = pairs(manuscripts, "m", "msent").join(pairs(sources, "s", "ssent").distinct(), "g")
    return hit.groupBy("m", "msent", "s", "ssent").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= least)


def strong_anchors(manuscripts: DataFrame, sources: DataFrame) -> DataFrame:
    """(m, s, i, j): equal six-word runs with at least two words of four letters or more.

    Every place of a run in a manuscript meets every place of it in a source: the result itself has all these rows.
    Words are measured on the joined runs alone (j keeps the test from being pushed below the join).
    """
    run = F.when(F.col("j") >= 0, F.col("g"))
    long_words = F.size(F.filter(F.split(run, " "), lambda w: F.length(w) >= 4))
    return seeds(manuscripts, sources, 6, "g").where(long_words >= 2).select("m", "s", "i", "j")


def identical(manuscripts: DataFrame, sources: DataFrame) -> DataFrame:
    """(m, s): sources whose words equal the manuscript's."""
    m = manuscripts.select(F.col("doc_id").alias("m"), T.fingerprint(F.col("text")).alias("f"))
    s = sources.select(F.col("doc_id").alias("s"), T.fingerprint(F.col("text")).alias("f"))
    return m.join(s, "f").select("m", "s")
