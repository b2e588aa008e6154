"""Word accounting, union scores, per-word states and evaluation counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def accounting(tokens: DataFrame, by: str = "doc_id", exclude_quotes: bool = True) -> DataFrame:
    """Counts of a masked ledger (boolean front, bibliography, quoted, eligible); each excluded word counts once, front first."""
    n = lambda c, name: F.count_if(c).alias(name)
    front, bib, quoted, ok = (F.col(c) for c in ("front", "bibliography", "quoted", "eligible"))
    q = quoted & F.lit(exclude_quotes)
    return tokens.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_words"), n(~front, "scoped_words"), n(ok, "eligible_words"), n(~ok & front, "front_matter_words"),
        n(~ok & ~front & bib, "excluded_bibliography_words"), n(~ok & ~front & ~bib & q, "excluded_quotation_words"),
        n(~ok & ~front & ~bib & ~q, "other_excluded_words"), n(ok & (front | bib | q), "violations"),
    )


def eligible(front: Column, bibliography: Column, quoted: Column, exclude_quotes: bool = True) -> Column:
    return ~(front | bibliography) & ~(quoted & F.lit(exclude_quotes))


def union_score(words: DataFrame, totals: DataFrame, by: str = "m") -> DataFrame:
    """(by, overlap_words, denominator): distinct matched places over each manuscript's words; manuscripts without a match stay with 0."""
    hit = words.groupBy(by).agg(F.countDistinct("pos").alias("overlap_words"))
    return totals.join(hit, by, "left").select(by, F.coalesce("overlap_words", F.lit(0)).alias("overlap_words"), "denominator")


def split_score(words: DataFrame, by: str = "m") -> DataFrame:
    """(by, exact_words, similar_only_words, combined_words) of (by, pos, exact): exact wins where both stand."""
    each = words.groupBy(by, "pos").agg(F.max("exact").alias("exact"))
    return each.groupBy(by).agg(F.count_if("exact").alias("exact_words"), F.count_if(~F.col("exact")).alias("similar_only_words"), F.count(F.lit(1)).alias("combined_words"))


def per_source(words: DataFrame, totals: DataFrame, sources: DataFrame) -> DataFrame:
    """Every source with its distinct matched words and manuscripts; sources without a match stay with 0."""
    hit = words.groupBy("s").agg(F.count_distinct("m", "pos").alias("overlap_words"), F.countDistinct("m").alias("manuscripts"))
    all_words = totals.agg(F.sum("denominator").alias("denominator"))
    return sources.select(F.col("doc_id").alias("s")).join(hit, "s", "left").na.fill(0, ["overlap_words", "manuscripts"]).crossJoin(F.broadcast(all_words))


def word_states(tokens: DataFrame) -> DataFrame:
    """tokens with `state`: the first that holds of front, bibliography, running header, quotation, exact, similar; else
    unmatched where every source was checked, or not-fully-checked."""
    state = (
        F.when(F.col("front"), "front-matter").when(F.col("bibliography"), "bibliography").when(F.col("header"), "running-header")
        .when(F.col("quoted"), "quotation").when(F.col("exact"), "exact").when(F.col("similar"), "similar")
        .when(F.col("all_checked"), "unmatched").otherwise("not-fully-checked")
    )
    return tokens.withColumn("state", state)


def confusion(reference: DataFrame, detected: DataFrame) -> DataFrame:
    """(s, both, reference_only, detector_only) over distinct (m, s, pos) of either side."""
    a = reference.select("m", "s", "pos").distinct().withColumn("r", F.lit(1))
    b = detected.select("m", "s", "pos").distinct().withColumn("d", F.lit(1))
    full = a.join(b, ["m", "s", "pos"], "full")
    return full.groupBy("s").agg(
        F.count_if(F.col("r").isNotNull() & F.col("d").isNotNull()).alias("both"), F.count_if(F.col("d").isNull()).alias("reference_only"), F.count_if(F.col("r").isNull()).alias("detector_only")
    )


def associate(reference: DataFrame, detected: DataFrame) -> DataFrame:
    """Pairs of spans of one manuscript and source that overlap on both sides by half of the shorter span or more.

    Both tables: (m, s, lo, hi, slo, shi), hi and shi exclusive. Returns m, s, lo, hi, dlo, dhi, slo, dslo.
    """
    d = detected.select("m", "s", F.col("lo").alias("dlo"), F.col("hi").alias("dhi"), F.col("slo").alias("dslo"), F.col("shi").alias("dshi"))
    both = lambda lo, hi, a, b: F.least(hi, b) - F.greatest(lo, a)
    enough = lambda lo, hi, a, b: 2 * both(lo, hi, a, b) >= F.least(F.col(hi) - F.col(lo), F.col(b) - F.col(a))
    return reference.join(d, ["m", "s"]).where(enough("lo", "hi", "dlo", "dhi") & enough("slo", "shi", "dslo", "dshi")).select("m", "s", "lo", "hi", "dlo", "dhi", "slo", "dslo")


def span_category(matched: Column, lo: Column, hi: Column, dlo: Column, dhi: Column) -> Column:
    """A where the bounds differ by at most two words or the spans' Jaccard is at least 0.8, else D."""
    shared = F.greatest(F.least(hi, dhi) - F.greatest(lo, dlo), F.lit(0))
    joined = (hi - lo) + (dhi - dlo) - shared
    near = (F.abs(lo - dlo) <= 2) & (F.abs(hi - dhi) <= 2)
    return F.when(~matched, "B").when(near | (10 * shared >= 8 * joined), "A").otherwise("D")


def measures(pairs: DataFrame, *by: str) -> DataFrame:
    """Span, gaps and counts of ordered pair paths: (by..., matched, mspan, sspan, mgap, sgap, longest_run)."""
    order = Window.partitionBy(*by).orderBy("i", "j")
    step = lambda c: F.col(c) - F.lag(c).over(order)
    p = pairs.withColumn("di", step("i")).withColumn("dj", step("j"))
    p = p.withColumn("r", F.sum(F.when((F.col("di") == 1) & (F.col("dj") == 1), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = p.groupBy(*by, "r").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"), F.max("di").alias("di"), F.max("dj").alias("dj"))
    return each.groupBy(*by).agg(
        F.sum("n").alias("matched"), (F.max("i1") - F.min("i0") + 1).alias("mspan"), (F.max("j1") - F.min("j0") + 1).alias("sspan"),
        F.coalesce(F.max("di") - 1, F.lit(0)).alias("mgap"), F.coalesce(F.max("dj") - 1, F.lit(0)).alias("sgap"), F.max("n").alias("longest_run"),
    )


def result_state(examined: Column, denominator: Column, eligible_words: Column, limited: Column, unchecked: Column) -> Column:
    return (
        F.when(examined == 0, "not_compared").when(denominator == 0, "unscorable").when(eligible_words == 0, "all_excluded")
        .when(limited | (unchecked > 0), "partial").otherwise("complete")
    )


def score_kind(examined: Column, denominator: Column, limited: Column) -> Column:
    return F.when((examined == 0) | (denominator == 0), "unavailable").when(limited, "lower_bound").otherwise("observed")


def quote_portions(pairs: DataFrame, *by: str, least: int = 9) -> DataFrame:
    """(by..., portion, n, quoted, reason): an alignment's (pos, region, quoted) pairs cut where the quotation region changes."""
    order = Window.partitionBy(*by).orderBy("pos")
    cut = F.coalesce((F.lag("region").over(order) != F.col("region")).cast("int"), F.lit(0))
    p = pairs.withColumn("__c", cut).withColumn("portion", F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    p = p.groupBy(*by, "portion").agg(F.count(F.lit(1)).alias("n"), F.max("quoted").alias("quoted"))
    return p.withColumn("reason", F.when(F.col("quoted"), "recognized-quotation").when(F.col("n") < least, "below-nine-matched-words").otherwise(""))


def attribution(citations: DataFrame, references: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, s, attribution): whether a document's bracketed numbers lead to a reference with the source's DOI.

    citations: (doc_id, s, number) near the match, number null where a citation has none or none was seen (cited says
    which); references: (doc_id, ref_no, doi); sources: (s, doi).
    """
    c = citations.join(sources, "s").join(references.select("doc_id", F.col("ref_no").alias("number"), F.col("doi").alias("rdoi")), ["doc_id", "number"], "left")
    sure = F.lower("rdoi") == F.lower("doi")
    return c.groupBy("doc_id", "s").agg(F.when(F.max(sure), "matching-source-confirmed").when(F.max("cited"), "nearby-unverified").otherwise("not-detected").alias("attribution"))
