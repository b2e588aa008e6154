"""One comparison from documents to report tables: masks, matches by a chosen model, scores, states, coverage; and its sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from loomtext.functions import text as T
from loomtext.operators import align, ledger as L, overlap as O, pairs as G, score as S, structure as R
from loomtext.session import materialize

MAX_MANUSCRIPT, MAX_SOURCE = 1_000_000, 2_000_000
MODELS = ("exact", "standard", "ordered", "classified", "improved")


@dataclass
class Report:
    """Tables of one run: matches (m, s, mlo, mhi, slo, shi, equal, kind, status, places: the manuscript's matched words), coverage (every source with its status),
    scores (one row a manuscript), accounting, intervals (word states) and per_source."""

    matches: DataFrame
    coverage: DataFrame
    scores: DataFrame
    accounting: DataFrame
    intervals: DataFrame
    per_source: DataFrame


def masked(tokens: DataFrame, ok: str, side: str) -> DataFrame:
    """(doc_id, text): the ledger's words joined by blanks, sentence ends marked, each word that is not ok replaced by one
    that occurs nowhere else; words keep their places."""
    blind = F.concat(F.lit("masked" + side), F.col("doc_id").cast("string"), F.lit("at"), F.col("pos").cast("string"))
    w = F.concat(F.when(F.col(ok), F.col("w")).otherwise(blind), F.when(F.col("stop"), ".").otherwise(""))
    return tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", w.alias("w")))).alias("ws")).select("doc_id", F.array_join("ws.w", " ").alias("text"))


def find(manuscripts: DataFrame, sources: DataFrame, model: str) -> DataFrame:
    """Matches of one model over (doc_id, text) tables."""
    cols = ["m", "s", "mlo", "mhi", "slo", "shi", "equal", "kind", "status", "places"]
    runs = O.exact_runs(manuscripts, sources).select(
        "m", "s", F.col("i").alias("mlo"), (F.col("i") + F.col("n")).alias("mhi"), F.col("j").alias("slo"), (F.col("j") + F.col("n")).alias("shi"),
        F.col("n").alias("equal"), F.lit("exact").alias("kind"), F.lit("compared").alias("status"), F.sequence(F.col("i"), (F.col("i") + F.col("n") - 1).cast("int")).alias("places"),
    )
    if model == "exact":
        return runs
    if model == "standard":
        return align.standard_near(manuscripts, sources).unionByName(align.anchored(manuscripts, sources)).select(*cols).distinct()
    if model == "ordered":
        return align.ordered(manuscripts, sources).select(*cols)
    if model == "improved":
        return align.graph(manuscripts, sources).select(*cols)
    if model == "classified":
        sent = R.sentences(manuscripts).select(F.col("doc_id").alias("m"), F.col("sent").alias("msent"), F.size(T.words(F.col("text"))).alias("k"))
        from pyspark.sql import Window

        at = F.coalesce(F.sum("k").over(Window.partitionBy("m").orderBy("msent").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        near = align.similar_sentences(manuscripts, sources).join(sent.withColumn("mlo", at), ["m", "msent"])
        near = near.select("m", "s", "mlo", (F.col("mlo") + F.col("k")).alias("mhi"), F.lit(None).cast("int").alias("slo"), F.lit(None).cast("int").alias("shi"), F.col("shared").alias("equal"), F.lit("similar").alias("kind"), F.lit("compared").alias("status"), F.transform("places", lambda p: (p + F.col("mlo")).cast("int")).alias("places"))
        return runs.unionByName(near)
    raise ValueError(f"model is one of {', '.join(MODELS)}")


def _units(tokens: DataFrame, docs: DataFrame) -> G.Side:
    """The units of a side's tokens (doc_id, pos, w, start, end, ok, skipped): its author-year citations count whole, its other citations match nothing."""
    tokens = L.mask(tokens, align.spans_of(docs, "full-citation"), "cited")
    return G.side(materialize(G.ledger_units(tokens, G.token_ranges(tokens, align.spans_of(docs, "unit"))), "units"))


def improved(m: G.Side, s: G.Side, runs: DataFrame, budget: int | None) -> DataFrame:
    """Exact runs, and the ordered matches that do not lie in one of them."""
    found = G.matches(m, s, budget, fewest=4)
    r = runs.select(F.col("m").alias("rm"), F.col("s").alias("rs"), F.col("mlo").alias("rlo"), F.col("mhi").alias("rhi"), (F.col("slo") - F.col("mlo")).alias("rshift"))
    inside = F.expr("m = rm AND s = rs AND shift = rshift AND mlo >= rlo AND mhi <= rhi")
    return runs.unionByName(found.join(r, inside, "left_anti").drop("shift"))


def compare(manuscripts: DataFrame, sources: DataFrame, model: str = "improved", excluded: DataFrame | None = None, budget: int | None = G.C.BUDGET) -> Report:
    """Compare every manuscript with every source, both (doc_id, text).

    Front matter, bibliography and longer quotations of a manuscript, and the bibliography of a source, match nothing
    and leave the denominator as said in the accounting. Sources too long, null or equal to a manuscript keep a coverage
    row with the reason. Every manuscript and source keeps a row in its table whether it matched or not; a manuscript that is null or too
    long has no words there and the reason as its status. Sources in `excluded` (doc_id) are the user's own choice: they
    are not compared and keep a coverage row that says so. The improved model finds nothing across front matter or a
    bibliography, lets longer quotations and citations only take up room, and takes equal author-year citations whole;
    `budget` is what one group of its equal words may cost, None for all it takes.
    """
    size = F.length("text")
    skipped = manuscripts.where((size > MAX_MANUSCRIPT) | size.isNull()).select(F.col("doc_id").alias("m"), F.when(size.isNull(), "unavailable").otherwise("skipped-size-limit").alias("status"))
    manuscripts = manuscripts.where(size <= MAX_MANUSCRIPT).select("doc_id", "text")
    usable = sources.where(size <= MAX_SOURCE).select("doc_id", "text")
    chosen = sources.select("doc_id").where("false") if excluded is None else excluded.select("doc_id").distinct()
    usable = usable.join(chosen, "doc_id", "left_anti")
    # Standard and classified words are put together by the evidence of all texts, the others' by each text's own.
    shared = model in ("standard", "classified")
    joins = lambda docs: L.line_joins(manuscripts.unionByName(usable)) if shared else L.line_joins(docs, "doc_id")
    ledger = materialize(R.ledger_with_masks(manuscripts, joins(manuscripts)), "ledger")
    s_tokens = L.mask(L.joined_ledger(usable, joins(usable)), R.bibliography(R.segments(usable)), "bibliography").withColumn("ok", ~F.col("bibliography"))
    if model == "improved":
        s_tokens = L.mask(s_tokens, R.long_quotes(s_tokens, R.straight_quotes(usable)), "skipped")
    s_tokens = materialize(s_tokens, "source_ledger")
    same = O.identical(manuscripts, usable)
    if model == "improved":
        runs = materialize(find(masked(ledger, "eligible", "m"), masked(s_tokens.withColumn("ok", F.col("ok") & ~F.col("skipped")), "ok", "s"), "exact"), "runs")
        m_tokens = ledger.withColumns({"ok": ~(F.col("front") | F.col("bibliography")), "skipped": F.col("quoted")})
        found = improved(_units(m_tokens, manuscripts), _units(s_tokens, usable), runs, budget)
    else:
        found = find(masked(ledger, "eligible", "m"), masked(s_tokens, "ok", "s"), model)
    found = materialize(found.join(same, ["m", "s"], "left_anti"), "matches")

    words = found.select("m", "s", F.explode("places").alias("pos"), (F.col("kind") == "exact").alias("exact"))
    ok = ledger.where("eligible").select(F.col("doc_id").alias("m"), "pos")
    words = materialize(words.join(ok, ["m", "pos"]).distinct(), "words")
    accounting = S.accounting(ledger)
    totals = manuscripts.select(F.col("doc_id").alias("m")).join(accounting.select(F.col("doc_id").alias("m"), F.col("eligible_words").alias("denominator")), "m", "left").na.fill(0, ["denominator"])
    split = S.split_score(words)
    scores = S.union_score(words, totals).join(split, "m", "left").na.fill(0, ["exact_words", "similar_only_words", "combined_words"])
    scores = scores.withColumn("percent", F.round(100 * F.col("overlap_words") / F.expr("nullif(denominator, 0)"), 2))
    limits = found.where("status <> 'compared'").select("s").distinct().withColumn("limited", F.lit(True))
    gone = same.select("s").distinct().withColumn("same", F.lit(True))
    coverage = sources.select(F.col("doc_id").alias("s"), size.alias("n")).join(limits, "s", "left").join(gone, "s", "left")
    coverage = coverage.join(chosen.select(F.col("doc_id").alias("s"), F.lit(True).alias("chosen")), "s", "left").select(
        "s",
        F.when(F.col("chosen"), "excluded-by-user").when(F.col("n").isNull(), "unavailable").when(F.col("n") > MAX_SOURCE, "skipped-size-limit").when(F.col("same"), "excluded-identical")
        .when(F.col("limited"), "compared-with-limits").otherwise("compared").alias("status"),
    )
    unchecked = coverage.agg(F.count_if(~F.col("status").isin("compared", "excluded-identical", "excluded-by-user")).alias("open"))
    hit = words.groupBy("m", "pos").agg(F.max("exact").alias("exact"))
    t = ledger.withColumnRenamed("doc_id", "m").join(hit, ["m", "pos"], "left").crossJoin(F.broadcast(unchecked))
    t = t.select("m", "pos", "front", "bibliography", "quoted", F.lit(False).alias("header"), F.coalesce("exact", F.lit(False)).alias("exact"), F.coalesce(~F.col("exact"), F.lit(False)).alias("similar"), (F.col("open") == 0).alias("all_checked"))
    intervals = L.run_length(S.word_states(t), "state", by="m")
    without = skipped.select("m", F.lit(0).cast("long").alias("overlap_words"), F.lit(0).cast("long").alias("denominator"), "status")
    scores = scores.withColumn("status", F.lit("compared")).unionByName(without, allowMissingColumns=True)
    return Report(found, coverage, scores, accounting, intervals, S.per_source(words, totals, sources))


def summary(report: Report) -> DataFrame:
    """One line of text a manuscript."""
    s = report.scores
    return s.select("m", F.format_string("%d of %d eligible words overlap (%d exact, %d similar only)", "overlap_words", "denominator", F.coalesce("exact_words", F.lit(0)), F.coalesce("similar_only_words", F.lit(0))).alias("text"))


def write_report(report: Report, path: str) -> None:
    """Write every table as JSON lines, and the matches as CSV that no spreadsheet runs; each folder appears when it is whole."""
    for name in ("matches", "coverage", "scores", "accounting", "intervals", "per_source"):
        getattr(report, name).write.mode("overwrite").json(f"{path}/{name}.json")
    cells = [T.csv_safe(F.col(c).cast("string")).alias(c) for c in report.matches.columns]
    report.matches.select(*cells).write.mode("overwrite").option("header", True).csv(f"{path}/matches.csv")


def write_html(report: Report, path: str) -> None:
    """Write one small HTML page a manuscript (a row of text each), made by Spark."""
    esc = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    row = F.concat(F.lit("<tr><td>"), esc("s"), F.lit("</td><td>"), esc("kind"), F.lit("</td><td>"), esc("mlo"), F.lit("-"), esc("mhi"), F.lit("</td></tr>"))
    tables = report.matches.where("kind <> 'none'").groupBy("m").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows"))
    page = F.concat(F.lit("<html><body><h1>Manuscript "), F.col("m").cast("string"), F.lit("</h1><p>"), F.col("text"), F.lit("</p><table>"), F.coalesce("rows", F.lit("")), F.lit("</table></body></html>"))
    summary(report).join(tables, "m", "left").select(page.alias("value")).write.mode("overwrite").text(path)
