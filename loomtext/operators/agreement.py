"""Agreement of detections with labelled passages: groups of passages and character counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loomtext.operators import score as S
from loomtext.operators.components import connected_components


def joined_runs(runs: DataFrame, gap: int = 1, least: int = 12) -> DataFrame:
    """(m, s, lo, hi, slo, shi): runs (m, s, i, j, n) of one diagonal joined over at most `gap` other words, of `least` equal words or more."""
    order = Window.partitionBy("m", "s", "d").orderBy("i")
    r = runs.withColumn("d", F.col("i") - F.col("j"))
    r = r.withColumn("f", F.coalesce((F.col("i") - F.lag(F.col("i") + F.col("n")).over(order) > gap).cast("int"), F.lit(1)))
    r = r.withColumn("g", F.sum("f").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.groupBy("m", "s", "d", "g").agg(F.min("i").alias("lo"), F.max(F.col("i") + F.col("n")).alias("hi"), F.sum("n").alias("n")).where(F.col("n") >= least)
    return r.select("m", "s", "lo", "hi", (F.col("lo") - F.col("d")).alias("slo"), (F.col("hi") - F.col("d")).alias("shi"))


def passage_groups(reference: DataFrame, detected: DataFrame) -> DataFrame:
    """Passages and detections that overlap by half of the shorter span on both sides, directly or through others, as groups.

    Both tables: (m, s, lo, hi, slo, shi), hi and shi exclusive. A span without a partner is a group of its own. Returns
    a row for each group: m, s, first (its first word), passages, detections, reference_words, detector_words and
    shared_words (distinct words of the manuscript) and category: B (passages alone), C (detections alone), A (bounds at
    most two words apart and no other word differs, or Jaccard of 0.8 or more), else D. Repeated spans count once.
    """
    key = lambda side, lo, slo: F.xxhash64(F.lit(side), "m", "s", lo, slo)
    node = lambda df, ref: df.select("m", "s", "lo", "hi", F.lit(ref).alias("ref"), key("r" if ref else "d", "lo", "slo").alias("node")).distinct()
    nodes = node(reference, True).unionByName(node(detected, False))
    links = S.associate(reference, detected).select(key("r", "lo", "slo").alias("a"), key("d", "dlo", "dslo").alias("b"))
    grouped = nodes.join(connected_components(links), "node", "left").withColumn("g", F.coalesce("component", "node"))
    by = ["m", "s", "g"]
    spans = grouped.groupBy(*by).agg(F.min("lo").alias("first"), F.count_if("ref").alias("passages"), F.count_if(~F.col("ref")).alias("detections"))
    words = grouped.select(*by, "ref", F.explode(F.sequence(F.col("lo"), (F.col("hi") - 1).cast(grouped.schema["lo"].dataType))).alias("pos"))
    words = words.groupBy(*by, "pos").agg(F.max("ref").alias("r"), F.max(~F.col("ref")).alias("d"))
    r, d = F.col("r"), F.col("d")
    ends = [f(F.when(c, F.col("pos"))).alias(f"{n}{k}") for n, c in (("r", r), ("d", d), ("c", r & d)) for k, f in (("0", F.min), ("1", F.max))]
    sizes = words.groupBy(*by).agg(F.count_if(r).alias("reference_words"), F.count_if(d).alias("detector_words"), F.count_if(r & d).alias("shared_words"), F.count(F.lit(1)).alias("u"), *ends)
    inner = words.where("r <> d").join(sizes.select(*by, "c0", "c1"), by).where("pos BETWEEN c0 AND c1").groupBy(*by).agg(F.count(F.lit(1)).alias("inner"))
    near = F.expr("shared_words > 0 AND abs(r0 - d0) <= 2 AND abs(r1 - d1) <= 2 AND inner IS NULL")
    category = F.when(F.col("detections") == 0, "B").when(F.col("passages") == 0, "C").when(near | F.expr("10 * shared_words >= 8 * u"), "A").otherwise("D")
    found = spans.join(sizes, by).join(inner, by, "left")
    return found.select("m", "s", "first", category.alias("category"), "passages", "detections", "reference_words", "detector_words", "shared_words")


def position_metrics(words: DataFrame) -> DataFrame:
    """Character counts of each source from words (s, chars, predicted, gold, observed, excluded).

    Excluded words count as leakage only. Of the others: matched, reference, predicted_observed, additional (predicted
    in observed pages beyond the gold) and outside (predicted elsewhere).
    """
    n = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("chars"))), F.lit(0)).cast("long").alias(name)
    p, g, o, ok = F.col("predicted"), F.col("gold"), F.col("observed"), ~F.col("excluded")
    return words.groupBy("s").agg(
        n(ok & p & g, "matched"), n(ok & g, "reference"), n(ok & p & o, "predicted_observed"), n(ok & p & o & ~g, "additional"), n(ok & p & ~o, "outside"), n(~ok, "leakage")
    )


def micro_macro(metrics: DataFrame) -> DataFrame:
    """One row of position_metrics: recall and strict visible precision over all characters, and as means over the sources that have them."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    m = metrics.select("*", ratio("matched", "reference").alias("recall"), ratio("matched", "predicted_observed").alias("precision"))
    sums = [F.sum(c).cast("long").alias(c) for c in ("matched", "reference", "predicted_observed", "additional", "outside", "leakage")]
    total = m.agg(*sums, *[F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("recall", "precision")], F.count("recall").alias("recall_sources"), F.count("precision").alias("precision_sources"))
    return total.withColumns({"micro_recall": F.round(ratio("matched", "reference"), 6), "micro_precision": F.round(ratio("matched", "predicted_observed"), 6)})
