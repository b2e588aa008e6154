"""Token ledgers: one row per word unit, with its place, and tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loomtext.functions import text as T
from loomtext.session import small_side


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = T.WORD) -> DataFrame:
    """(doc_id, pos, w): lower-cased word units in order; texts without words have no row."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(T.words(F.col(text_col), pattern)).alias("pos", "w"))


def _pieces(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, pos, raw, gap, w, start, end, stop): every word with the text between it and the one before."""
    pieces = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.regexp_extract_all(text_col, F.lit(T.PIECE), F.lit(0))).alias("pos", "piece"))
    before = F.coalesce(F.sum(F.length("piece")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stop = F.coalesce(F.lead("piece").over(Window.partitionBy("doc_id").orderBy("pos")).rlike(r"^[.!?][\"”’)\]]*\s"), F.lit(False))
    at = pieces.select("doc_id", "pos", F.regexp_extract("piece", T.WORD, 0).alias("raw"), "piece", before.alias("before"), stop.alias("stop"))
    end = F.col("before") + F.length("piece")
    gap = F.col("piece").substr(F.lit(1), F.length("piece") - F.length("raw"))
    return at.select("doc_id", "pos", "raw", gap.alias("gap"), T.fold(F.col("raw")).alias("w"), (end - F.length("raw")).cast("int").alias("start"), end.cast("int").alias("end"), "stop")


def offset_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ledger() with start and end (code points of the original text, end exclusive) and stop: whether a sentence mark follows."""
    return _pieces(docs, id_col, text_col).select("doc_id", "pos", "w", "start", "end", "stop")


#: A word broken at a line end, one with a hyphen inside a line, and the break alone.
BROKEN = r"[\p{L}\p{N}]+-[ \t]*\r?\n[ \t]*\p{L}+"
COMPOUND = r"[\p{L}\p{N}]+-[\p{L}\p{N}]+"
LINE_BREAK = r"-[ \t]*\r?\n[ \t]*"


def line_joins(docs: DataFrame, *by: str) -> DataFrame:
    """(by..., w): words broken at a line end whose joined spelling stands unbroken somewhere and nowhere with a hyphen inside a line.

    With `by` doc_id each document is its own evidence, without it all are each other's.
    """
    found = lambda pattern: docs.select(*by, F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("x"))
    plain = lambda pattern, cut: found(pattern).select(*by, T.fold(F.regexp_replace("x", cut, "")).alias("w")).distinct()
    whole = docs.select(*by, F.explode(F.array_distinct(T.words(F.col("text")))).alias("w"))
    return plain(BROKEN, LINE_BREAK).join(whole, [*by, "w"], "left_semi").join(plain(COMPOUND, "-"), [*by, "w"], "left_anti")


def joined_ledger(docs: DataFrame, joins: DataFrame) -> DataFrame:
    """offset_ledger() in which words that a soft hyphen or a line end breaks are one, with the place of both.

    A part joins the one before if that ends in a letter, it begins with a small one, and between them is only a soft
    hyphen, or a hyphen at a line end whose joined spelling is among `joins` (w, or doc_id and w). Of parts at several
    line ends in a row each second one joins.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    t = _pieces(docs, "doc_id", "text").withColumn("spelled", F.concat(F.lag("w").over(order), F.col("w")))
    t = t.withColumn("may", F.coalesce(F.lag("raw").over(order).rlike(r"\p{L}$") & F.col("raw").rlike(r"^\p{Ll}"), F.lit(False)))
    by = [c for c in joins.columns if c == "doc_id"]
    known = joins.select(*by, F.col("w").alias("spelled"), F.lit(True).alias("known")).distinct()
    t = t.join(small_side(known), [*by, "spelled"], "left")
    t = t.withColumn("line", F.col("may") & F.coalesce("known", F.lit(False)) & F.col("gap").rlike(f"^{LINE_BREAK}$"))
    # Within a row of parts that could all join, the first, third and so on do.
    since = F.col("pos") - F.last(F.when(~F.col("line"), F.col("pos")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    joins_on = (F.col("may") & (F.col("gap") == "­")) | (F.col("line") & (since % 2 == 1))
    t = t.withColumn("unit", F.sum((~joins_on).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    one = F.array_sort(F.collect_list(F.struct("pos", "w")))
    whole = t.groupBy("doc_id", "unit").agg(F.array_join(F.transform(one, lambda x: x["w"]), "").alias("w"), F.min("start").alias("start"), F.max("end").alias("end"), F.max_by("stop", "pos").alias("stop"))
    return whole.select("doc_id", F.col("unit").cast("int").alias("pos"), "w", "start", "end", "stop")


def grams(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, g): every run of k words as one string, made row by row without a shuffle."""
    w = docs.select(F.col(id_col).alias("doc_id"), T.words(F.col(text_col)).alias("w")).where(F.size("w") >= k)
    at = w.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("pos"))
    return at.select("doc_id", "pos", F.concat_ws(" ", *[F.col("w")[F.col("pos") + o] for o in range(k)]).alias("g"))


def gram_counts(docs: DataFrame, ks: tuple[int, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, n_distinct, k): runs of k words of each document, all and different ones, where it has one.

    A text's runs are counted in its own row; only those of texts that share their id meet in a shuffle.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = small_side(texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id"))
    same = texts["doc_id"].eqNullSafe(shared["doc_id"])
    alone = texts.join(shared, same, "left_anti").select("doc_id", T.words(F.col("text")).alias("w"))
    run = lambda k: lambda p: F.array_join(F.slice("w", p, k), " ")
    different = lambda k: F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), run(k))))
    each = [F.when(F.size("w") >= k, F.struct((F.size("w") - (k - 1)).cast("long").alias("n"), different(k).cast("long").alias("n_distinct"), F.lit(k).alias("k"))) for k in ks]
    counts = alone.select("doc_id", F.explode(F.array(*each)).alias("x")).where("x is not null").select("doc_id", "x.*")
    rest = texts.join(shared, same, "left_semi")
    for k in ks:
        met = grams(rest, k).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("g").alias("n_distinct"))
        counts = counts.unionByName(met.withColumn("k", F.lit(k)))
    return counts


def windows(docs: DataFrame, size: int = 120, stride: int = 96, least: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lo, hi) overlapping word windows of each document; the last one reaches the end."""
    n = docs.select(F.col(id_col).alias("doc_id"), F.size(T.words(F.col(text_col))).alias("n")).where(F.col("n") >= least)
    last = F.greatest(F.ceil((F.col("n") - size) / stride), F.lit(0)).cast("int")
    w = n.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("k")).select("doc_id", (F.col("k") * stride).alias("lo"), F.least(F.col("k") * stride + size, "n").alias("hi"))
    return w.where(F.col("hi") - F.col("lo") >= least)


def runs(positions: DataFrame, *by: str, pos: str = "pos") -> DataFrame:
    """(by..., lo, hi): maximal runs of consecutive distinct places, hi exclusive."""
    rows = positions.select(*by, pos).distinct()
    island = F.col(pos) - F.row_number().over(Window.partitionBy(*by).orderBy(pos))
    return rows.withColumn("__g", island).groupBy(*by, "__g").agg(F.min(pos).alias("lo"), (F.max(pos) + 1).alias("hi")).drop("__g")


def regions(tokens: DataFrame, *masks: str, by: str = "doc_id", pos: str = "pos", out: str = "region") -> DataFrame:
    """A running number that grows wherever one of the masks changes."""
    order = Window.partitionBy(by).orderBy(pos)
    state = F.struct(*masks)
    changed = F.coalesce((F.lag(state).over(order) != state).cast("int"), F.lit(0))
    return tokens.withColumn("__c", changed).withColumn(out, F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__c")


def run_length(tokens: DataFrame, *state: str, by: str = "doc_id", pos: str = "pos") -> DataFrame:
    """(by, state..., lo, hi): consecutive places of equal state as one interval."""
    numbered = regions(tokens, *state, by=by, pos=pos, out="__r")
    return numbered.groupBy(by, "__r", *state).agg(F.min(pos).alias("lo"), (F.max(pos) + 1).alias("hi")).drop("__r")


def merge_intervals(spans: DataFrame, by: str = "doc_id") -> DataFrame:
    """Union of (by, s, e) intervals; touching ones merge."""
    order = Window.partitionBy(by).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    fresh = (F.col("s") > F.coalesce(F.max("e").over(order), F.lit(-1))).cast("int")
    island = F.sum("__n").over(Window.partitionBy(by).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("__n", fresh).withColumn("__g", island).groupBy(by, "__g").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("__g")


def mask(tokens: DataFrame, spans: DataFrame, out: str, by: str = "doc_id") -> DataFrame:
    """tokens with a boolean `out`: whether the token overlaps one of the (by, s, e) spans."""
    # One sweep a document: of the spans that start before a token ends, the one that reaches farthest decides.
    at = tokens.withColumns({"__at": F.col("end").cast("long"), "__e": F.lit(None).cast("long")})
    edges = spans.where("e > s").select(F.col(by), F.col("s").cast("long").alias("__at"), F.col("e").cast("long").alias("__e"))
    order = Window.partitionBy(by).orderBy("__at", F.col("__e").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = at.unionByName(edges, allowMissingColumns=True).withColumn("__reach", F.max("__e").over(order)).where("__e is null")
    return swept.withColumn(out, F.coalesce(F.col("__reach") > F.col("start"), F.lit(False))).drop("__at", "__e", "__reach")


def bridge(spans: DataFrame, docs: DataFrame, *same: str) -> DataFrame:
    """(doc_id, s, e, same..., n): spans of equal `same` that only white space without a blank line parts become one; n counts its parts.

    Spans (doc_id, s, e, same...) do not overlap; neighbours without anything between them stay apart.
    """
    order = Window.partitionBy("doc_id").orderBy("s")
    before = spans.withColumns({"__e": F.lag("e").over(order), "__same": F.lag(F.struct(*same)).over(order) == F.struct(*same)})
    gap = F.col("text").substr(F.col("__e") + 1, F.col("s") - F.col("__e"))
    white = gap.rlike(r"^\s+$") & ~F.contains(gap, F.lit("\n\n"))
    joined = before.join(docs.select("doc_id", "text"), "doc_id").withColumn("__new", (~F.coalesce(F.col("__same") & white, F.lit(False))).cast("int")).drop("text")
    group = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("__g", group).groupBy("doc_id", "__g", *same).agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n")).drop("__g")
