"""Document structure from plain text: lines, headings, references, abstract, running headers, quotation spans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomtext.functions import text as T
from loomtext.operators import ledger as L

# The heading grammar.
REFERENCE_HEADING = (
    r"(?i)^(?:\d+[.)]?\s+)?(?:references|bibliography|works cited|cited works|literature cited|reference list|list of references|"
    r"selected references|references and notes|endnotes|annotated bibliography|selective bibliography|bibliography cited|"
    r"bibliographical references and notes|cited references|references? cited|references? and notes?|reference notes|"
    r"references and further reading|references and links|references index|references list|references section)\s*:?\s*$"
)
COMMON_HEADING = (
    r"(?i)^(?:(?:\d+(?:\.\d+)*[.)]?)\s+)?(?:abstract|introduction|background|methods?|materials and methods|methodology|results|discussion|"
    r"conclusions?|limitations|acknowledg(?:e)?ments?|appendix(?:\s+[A-Z])?|supplementary material)\s*:?\s*$"
)
NUMBERED_HEADING = r"^\d+(?:\.\d+)*[.)]?\s+[A-Z][^\n.!?]{1,90}$"
END_HEADING = (
    r"(?i)^(?:\d+[.)]?\s+)?(?:appendix|appendices|glossary|tables?|figures?|charts?|exhibits|acknowledg(?:e)?ments?)"
    r"(?:\s+(?:[A-Z]|\d+(?:\.\d+)*))?(?:\s*:\s*[^\n]{1,80})?\s*$"
)
CHAPTER_HEADING = r"(?i)^chapter\s+(?:\d+|[ivxlcdm]+)(?:\s*:\s*[^\n]{1,80})?\s*$"
REFERENCE_START = r"^\s*(?:\[\d+\]|\d+[.)])\s+"
#: Abbreviations after which a full stop ends no sentence; nor does one after a single capital.
ABBREVIATIONS = "e.g i.e et al vs cf etc approx Fig Figs Eq No pp p Dr Prof Mr Ms Vol St"
CLOSERS, OPENERS = r"[\"”’)\]]", r"[\"“(\[]"
ABSTRACT_ALONE = r"(?i)^(?:\d+(?:\.\d+)*[.)]?\s+)?abstract\s*[:.]?$"
ABSTRACT_INLINE = r"(?i)^(?:\d+(?:\.\d+)*[.)]?\s+)?abstract\s*(?::|\.|—|–|-)\s*\S"
#: A line of a table of contents, by the page number at its end; BARE_CONTENTS takes no line that a sentence ends within.
CONTENTS = r"(?:\.{3,}|\s)\d+$"
BARE_CONTENTS = r"(?s)^(?!.*\p{Ll}[.!?][\"”’)\]]*\s).*(?:\.{3,}|\s)\d+$"


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, start): physical lines with the offset of each."""
    at = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    before = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    return at.withColumn("start", F.coalesce(before, F.lit(0)).cast("int"))


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sent, text): sentences in order, numbered from 0.

    One ends at . ! or ? with its closing marks if blanks and then a capital or digit follow, perhaps behind an opening
    mark, unless an abbreviation or a single capital stands before the full stop; and at blank lines.
    """
    short = r"(?:e\.g|i\.e|et al|" + "|".join(w for w in ABBREVIATIONS.split() if w.isalpha() and w not in ("et", "al")) + "|[A-Z])"
    stop = rf"(?<=[.!?]{CLOSERS}{{0,9}})(?<!\b{short}\.{CLOSERS}{{0,9}})\s+(?={OPENERS}?[A-Z0-9])"
    return docs.select("doc_id", F.posexplode(F.split("text", rf"\n[ \t]*\n|{stop}")).alias("sent", "text"))


def strict_heading(s: Column) -> Column:
    return s.rlike(REFERENCE_HEADING) | s.rlike(COMMON_HEADING) | s.rlike(END_HEADING) | s.rlike(CHAPTER_HEADING)


def segments(docs: DataFrame) -> DataFrame:
    """(doc_id, seg, kind, section, start, end): headings, body paragraphs and reference entries.

    A blank line ends a segment, a heading is one of its own, and inside the references every entry that opens with its
    number starts one. A numbered heading inside the references that reads like an entry is an entry. Whether a line
    stands inside the references follows from the last heading before it that opens or closes them.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    x = lines(docs).withColumn("s", F.trim("line"))
    strict, numbered, entry = strict_heading(F.col("s")), F.col("s").rlike(NUMBERED_HEADING), F.col("s").rlike(REFERENCE_START)
    x = x.withColumn("blank", F.col("s") == "").withColumn("sure", strict | (numbered & ~entry)).withColumn("maybe", numbered & entry & ~strict)
    # Only a sure heading opens or closes the references; a doubtful one counts as a heading just where they are closed,
    # and there it leaves them closed.
    opens = F.when(F.col("sure"), F.col("s").rlike(REFERENCE_HEADING))
    x = x.withColumn("inside", F.coalesce(F.last(opens, ignorenulls=True).over(past), F.lit(False)))
    x = x.withColumn("heading", F.col("sure") | (F.col("maybe") & ~F.col("inside")))
    x = x.withColumn("section", F.coalesce(F.last(F.when(F.col("heading"), F.col("s")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit("Unspecified")))
    before_blank, before_heading = (F.coalesce(F.lag(c).over(order), F.lit(True)) for c in ("blank", "heading"))
    fresh = F.col("heading") | before_blank | before_heading | (F.col("inside") & entry)
    x = x.withColumn("fresh", (fresh & ~F.col("blank")).cast("int")).withColumn("seg", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lead = F.length("line") - F.length(F.ltrim("line"))
    x = x.where(~F.col("blank")).withColumn("a", F.col("start") + lead).withColumn("b", F.col("start") + F.length(F.rtrim("line")))
    kind = F.when(F.col("heading"), "heading").when(F.col("inside"), "reference").otherwise("body")
    return x.withColumn("kind", kind).groupBy("doc_id", "seg", "kind", "section").agg(F.min("a").alias("start"), F.max("b").alias("end"))


def bibliography(segs: DataFrame) -> DataFrame:
    """(doc_id, s, e) of reference entries and of what stands under a reference heading."""
    return segs.where(F.col("kind").isin("reference", "bibliography") | F.col("section").rlike(REFERENCE_HEADING)).select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"))


def references(docs: DataFrame, segs: DataFrame) -> DataFrame:
    """(doc_id, ref_no, raw, doi) of the reference entries, numbered from 1."""
    refs = segs.where("kind = 'reference'").join(docs.select("doc_id", "text"), "doc_id")
    raw = F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start"))
    doi = F.regexp_replace(F.regexp_extract(raw, "(?i)" + T.DOI, 0), r"[.,;)\]}]+$", "")
    return refs.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("start")).alias("ref_no"), raw.alias("raw"), F.when(doi != "", doi).alias("doi"))


def abstract_start(docs: DataFrame, segs: DataFrame, contents: str = CONTENTS) -> DataFrame:
    """(doc_id, front_end): offset of the first abstract heading before the references; documents without one have no row.

    A heading alone in its line does not count if the line after it is one of a table of contents.
    """
    letters = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"\p{L}+"), F.lit(0)))
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    x = lines(docs).withColumn("s", F.trim("line")).withColumn("next", F.first(F.when(F.col("s") != "", F.col("s")), ignorenulls=True).over(order))
    alone = F.col("s").rlike(ABSTRACT_ALONE) & (letters(F.coalesce("next", F.lit(""))) >= 6) & ~F.coalesce("next", F.lit("")).rlike(contents)
    inline = F.col("s").rlike(ABSTRACT_INLINE) & (letters(F.col("s")) >= 7)
    limit = bibliography(segs).groupBy("doc_id").agg(F.min("s").alias("limit"))
    found = x.where(alone | inline).withColumn("at", F.col("start") + F.length("line") - F.length(F.ltrim("line"))).join(limit, "doc_id", "left")
    return found.where(F.col("limit").isNull() | (F.col("at") < F.col("limit"))).groupBy("doc_id").agg(F.min("at").alias("front_end"))


def running_headers(pages: DataFrame) -> DataFrame:
    """(doc_id, page, edge, identity): confirmed running headers of (doc_id, page, text) pages.

    A first or last line of two to twelve words, at most 120 characters and without sentence marks or digits besides a
    page counter at one end, is a header when on two pages or more its counter is the page's number.
    """
    rows = pages.select("doc_id", "page", F.filter(F.transform(F.split("text", "\n"), F.trim), lambda s: s != "").alias("ls")).where(F.size("ls") >= 3)
    edges = rows.select("doc_id", "page", F.explode(F.array(F.struct(F.lit("top").alias("edge"), F.element_at("ls", 1).alias("line")), F.struct(F.lit("bottom").alias("edge"), F.element_at("ls", -1).alias("line")))).alias("x")).select("doc_id", "page", "x.*")
    first, last = F.regexp_extract("line", r"^(\d{1,3})\s", 1), F.regexp_extract("line", r"\s(\d{1,3})$", 1)
    identity = F.regexp_replace(F.regexp_replace("line", r"^\d{1,3}\s+", ""), r"\s+\d{1,3}$", "")
    e = edges.withColumn("counter", F.when(first != "", first).otherwise(last)).withColumn("identity", F.lower(F.regexp_replace(identity, r"\s+", " ")))
    n = F.size(F.regexp_extract_all("identity", F.lit(r"\p{L}+"), F.lit(0)))
    e = e.where(n.between(2, 12) & (F.length("line") <= 120) & ~F.col("identity").rlike(r"[.!?;:=\t]|\d"))
    e = e.withColumn("confirmed", (F.col("counter") != "") & (F.expr("try_cast(counter AS int)") == F.col("page")))
    sure = e.where("confirmed").groupBy("doc_id", "edge", "identity").agg(F.countDistinct("page").alias("n")).where("n >= 2")
    return e.where("confirmed").join(sure, ["doc_id", "edge", "identity"]).select("doc_id", "page", "edge", "identity").distinct()


def long_quotes(tokens: DataFrame, spans: DataFrame, most: int = 3) -> DataFrame:
    """The (doc_id, s, e) quotation spans that hold more than `most` words of the ledger."""
    from loomtext.operators.pairs import token_ranges

    return token_ranges(tokens, spans, "s", "e").where(F.col("hi") - F.col("lo") > most).select("doc_id", "s", "e")


def paragraphs_of(docs: DataFrame, places: DataFrame, most: int = 10_000) -> DataFrame:
    """(doc_id, at, s, e): the paragraph around each place (doc_id, at), cut off `most` characters before and behind it.

    A paragraph reaches from behind the last empty line that ends before the place to the next one at it or later. Both
    are looked up in one sweep over places and empty lines each.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    x = lines(docs).withColumn("last", F.lead("line_no").over(order).isNull())
    breaks = x.where((F.col("line") == "") & (F.col("line_no") > 0) & ~F.col("last")).select("doc_id", (F.col("start") - 1).alias("k"))
    at = places.select("doc_id", F.col("at").cast("int").alias("at")).distinct().join(docs.select("doc_id", F.length("text").alias("length")), "doc_id")

    def swept(shift: int, name: str, first: bool) -> DataFrame:
        """The places with the nearest break before them, or the nearest one behind."""
        rows = at.select("doc_id", F.col("at").alias("x"), "length", F.lit(None).cast("int").alias("k")).unionByName(breaks.select("doc_id", (F.col("k") + shift).alias("x"), F.lit(None).cast("int").alias("length"), "k"))
        w = Window.partitionBy("doc_id").orderBy("x", F.col("k").isNull() if first else F.col("k").isNotNull())
        near = F.max("k").over(w.rowsBetween(Window.unboundedPreceding, 0)) if first else F.min("k").over(w.rowsBetween(0, Window.unboundedFollowing))
        return rows.withColumn(name, near).where("k is null").select("doc_id", F.col("x").alias("at"), "length", name)

    both = swept(2, "before", True).join(swept(0, "behind", False).drop("length"), ["doc_id", "at"])
    near_start = F.when(F.col("before") >= F.col("at") - most, F.col("before") + 2).otherwise(F.greatest(F.col("at") - most, F.lit(0)))
    near_end = F.when(F.col("behind") + 2 <= F.col("at") + most, F.col("behind")).otherwise(F.least(F.col("at") + most, "length"))
    return both.select("doc_id", "at", near_start.cast("int").alias("s"), near_end.cast("int").alias("e"))


def uncertain_quotes(docs: DataFrame) -> DataFrame:
    """(doc_id, s, e): what may be quoted but is not taken to be: paragraphs around doubtful marks, and lines indented by four blanks or more outside quotations.

    Such spans are kept apart: nothing that they hold is excluded.
    """
    from loomtext.operators import align

    around = paragraphs_of(docs, align.spans_of(docs, "doubtful").select("doc_id", F.col("s").alias("at"))).select("doc_id", "s", "e")
    indented = lines(docs).where(F.col("line").rlike(r"^[ \t]{4,}[^\n]+$")).select("doc_id", F.col("start").alias("s"), (F.col("start") + F.length("line")).cast("int").alias("e"))
    quoted = align.spans_of(docs, "quotation").select("doc_id", F.col("s").alias("qs"), F.col("e").alias("qe"))
    outside = indented.join(quoted, (indented["doc_id"] == quoted["doc_id"]) & (F.col("qs") <= F.col("s")) & (F.col("e") <= F.col("qe")), "left_anti")
    return around.unionByName(outside).distinct()


def straight_quotes(docs: DataFrame) -> DataFrame:
    """(doc_id, s, e): spans between double quotation marks of one kind, native form for texts without nesting."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", '"')).alias("k", "part"))
    before = F.coalesce(F.sum(F.length("part") + 1).over(Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return parts.withColumn("b", before).withColumn("n", n).where("k % 2 = 1 AND k < n - 1").select("doc_id", (F.col("b") - 1).cast("int").alias("s"), (F.col("b") + F.length("part") + 1).cast("int").alias("e"))


def marked_texts(docs: DataFrame, segs: DataFrame, starts: DataFrame | None = None, most: int = 3) -> DataFrame:
    """(doc_id, front_end, ps, raw, rs, ends, bibliography, quoted): arrays over the words of each text that has any.

    The spans of a document join its text, and its words are marked in that row: no table of words is shuffled.
    """

    @F.pandas_udf("ends array<int>, bibliography array<boolean>, quoted array<boolean>")
    def marks(pieces: pd.Series, words: pd.Series, parts: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.DataFrame:
        """Where the words end, whether they touch spans, and whether quotations of more than `most` words; parts are the lengths between quotation marks."""
        out = []
        for piece, word, part, low, high in zip(pieces, words, parts, lows, highs, strict=True):
            ends = np.cumsum(piece, dtype=np.int64)
            begins = ends - np.asarray(word, np.int64)
            at = np.cumsum(np.asarray(part, np.int64) + 1) - 1
            quotes = [(s, e + 1) for s, e in zip(at[0:-1:2], at[1:-1:2])]
            found = [ends.astype(np.int32)]
            for spans, least in ((zip(low, high, strict=True), 0), (quotes, most)):
                hit = np.zeros(len(ends), bool)
                for s, e in spans:
                    lo, hi = np.searchsorted(ends, s, "right"), np.searchsorted(begins, e, "left")
                    if e > s and hi - lo > least:
                        hit[lo:hi] = True
                found.append(hit)
            out.append(found)
        return pd.DataFrame(out, columns=["ends", "bibliography", "quoted"])

    spans = bibliography(segs).groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    rows = docs.select("doc_id", "text").join(spans, "doc_id", "left")
    rows = rows.withColumn("front_end", F.lit(None).cast("int")) if starts is None else rows.join(starts, "doc_id", "left")
    lengths = lambda c: F.transform(c, F.length)
    side = lambda c: F.coalesce(F.col("spans")[c], F.array().cast("array<int>"))
    cut = rows.select("doc_id", "front_end", F.split("text", '"').alias("parts"), side("s").alias("lows"), side("e").alias("highs"), F.regexp_extract_all("text", F.lit(T.PIECE), F.lit(0)).alias("ps")).where(F.size("ps") > 0)
    cut = cut.withColumn("raw", F.transform("ps", lambda p: F.regexp_extract(p, T.WORD, 0))).withColumns({"ns": lengths("ps"), "rs": lengths("raw")})
    cut = cut.select("doc_id", "front_end", "ps", "raw", "rs", marks("ns", "rs", lengths("parts"), "lows", "highs").alias("x"))
    return cut.select("doc_id", "front_end", "ps", "raw", "rs", "x.ends", "x.bibliography", "x.quoted")


def region_counts(marked: DataFrame, *masks: str) -> DataFrame:
    """(doc_id, regions): how many stretches of words with the same masks each of marked_texts() has."""
    state = lambda k: F.struct(*[F.get(m, k) for m in masks])
    cuts = F.filter(F.sequence(F.lit(0), F.size("ends") - 1), lambda k: (k > 0) & (state(k) != state(k - 1)))
    return marked.select("doc_id", (F.size(cuts) + 1).cast("long").alias("regions"))


def marked_words(docs: DataFrame, segs: DataFrame, starts: DataFrame | None = None, most: int = 3) -> DataFrame:
    """ledger.offset_ledger() with bibliography and quoted, and front if `starts` (doc_id, front_end) are given."""
    cut = marked_texts(docs, segs, starts, most)
    at = cut.select("doc_id", "front_end", "ps", "raw", "rs", "ends", "bibliography", "quoted", F.explode(F.sequence(F.lit(0), F.size("ps") - 1)).alias("pos"))
    own = lambda c, k=0: F.get(c, F.col("pos") + k)
    stop = F.coalesce(own("ps", 1).rlike(r"^[.!?][\"”’)\]]*\s"), F.lit(False))
    start = own("ends") - own("rs")
    t = at.select("doc_id", "pos", T.fold(own("raw")).alias("w"), start.alias("start"), own("ends").alias("end"), stop.alias("stop"), own("bibliography").alias("bibliography"), own("quoted").alias("quoted"), F.coalesce(start < F.col("front_end"), F.lit(False)).alias("front"))
    return t.drop("front") if starts is None else t


def ledger_with_masks(docs: DataFrame, joins: DataFrame | None = None, contents: str = CONTENTS) -> DataFrame:
    """Offset ledger with front, bibliography, quoted and eligible columns; with `joins` (ledger.line_joins), broken words are one."""
    from loomtext.operators import score

    segs = segments(docs)
    starts = abstract_start(docs, segs, contents)
    if joins is None:
        t = marked_words(docs, segs, starts)
    else:
        t = L.mask(L.joined_ledger(docs, joins), bibliography(segs), "bibliography")
        t = L.mask(t, long_quotes(t, straight_quotes(docs)), "quoted")
        t = t.join(starts, "doc_id", "left").withColumn("front", F.coalesce(F.col("start") < F.col("front_end"), F.lit(False))).drop("front_end")
    return t.withColumn("eligible", score.eligible(F.col("front"), F.col("bibliography"), F.col("quoted")))
