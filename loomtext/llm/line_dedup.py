"""Line dedup over a corpus: exact and one-word-edit repeats, by a deletion-neighbourhood join, native expressions only.

A line's words are its lower-cased runs of non-blank characters. Two lines are the same within the bound when one word
substituted, inserted or deleted turns one into the other. Deleting the word at place i from both ends of a
substitution gives equal variants at equal i; an insertion makes one line equal to a variant of the other. So every line
emits its variants as hashed keys, lines join on equal keys, and the word edit distance of each joined pair is verified.
Lines of fewer than MIN_WORDS words, of which one is too large a part, repeat only where all their words are equal.

Before variants are made, lines that share neither half with any other line are set aside: an edit of one word leaves
the first or the last half of the words untouched, so such lines have no partner, and the variants of the others need
only delete words outside the shared half. Every group of equal variants joins with its earliest line alone, which
decides for all: the work grows with the lines, not with the square of a group. Texts are split into lines once; only
documents that hold the first of a line that shares a half are read again, and of these only such lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtext.session import materialize, small_side

MIN_WORDS = 5
BLANKS = "[ \\t\\r\\f\\x0B]+"


def words_of(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), BLANKS), "")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))


def _halves(n: Column) -> tuple[Column, Column]:
    """Lengths of the half that a line shares with a partner as long, or one word longer or shorter."""
    return F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")


def _keys(df: DataFrame, *keep: str) -> DataFrame:
    """keep..., n and the hashes of the word array w: h1 and h2 of all words, p1, p2 (s1, s2) of the first (last) half."""
    n, w = F.col("n"), F.col("w")
    q1, q2 = _halves(F.greatest(n, F.lit(1)))
    part = lambda q, last: F.xxhash64(q, F.slice(w, n - q + 1 if last else 1, q))
    odd = n % 2 == 1
    done = df.select(*keep, "w", F.size("w").alias("n")).select(*keep, "n", "w", part(q1, False).alias("p1"), part(q1, True).alias("s1"))
    return done.select(
        *keep, "n", F.xxhash64(n, "p1", F.when(odd, w[q1]), "s1").alias("h1"), F.xxhash64(F.lit(7), w).alias("h2"),
        "p1", F.when(odd, F.col("p1")).otherwise(part(q2, False)).alias("p2"), "s1", F.when(odd, F.col("s1")).otherwise(part(q2, True)).alias("s2"),
    )


def _within_one(x: Column, y: Column) -> Column:
    """Whether two word arrays are at most one word edit apart."""
    longest = F.greatest(F.size(x), F.size(y))

    def common(a: Column, b: Column) -> Column:
        at = F.array_position(F.zip_with(a, b, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(at == 0, longest).otherwise(at - 1)

    return common(x, y) + common(F.reverse(x), F.reverse(y)) >= longest - 1


def _first_words(open_: DataFrame, rows: DataFrame) -> DataFrame:
    """open_ with the words w of each line, read from the document that holds the line first."""
    wanted = open_.groupBy(F.col("first.id").alias("wid"), F.col("first.th").alias("wth")).agg(F.collect_list(F.struct(F.col("first.line_no").alias("at"), "h1", "h2", "lo", "hi", "first")).alias("wanted"))
    wanted = materialize(wanted, "wanted")
    held = rows.join(small_side(wanted), F.col("id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth"))).dropDuplicates(["wid", "wth"])
    lines = held.select("wanted", F.split("text", "\n").alias("lines")).select(F.explode(F.transform("wanted", lambda x: F.struct(x.alias("o"), F.col("lines")[x["at"]].alias("line")))).alias("e"))
    return lines.select("e.o.*", words_of(F.col("e.line")).alias("w")).select("h1", "h2", "first", "w", F.size("w").alias("n"), "lo", "hi")


def _near(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """Hashes (h1, h2) of the distinct lines that have an earlier line within one word edit."""
    key = ["h1", "h2"]
    half = lambda side, k: F.struct(F.lit(side).alias("side"), F.col(k).alias("k"))
    halves = classes.select(*key, F.explode(F.array_distinct(F.array(half(0, "p1"), half(0, "p2"), half(1, "s1"), half(1, "s2")))).alias("e")).select(*key, "e.*")
    met = halves.groupBy("side", "k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("side", "k")
    open_ = halves.join(met, ["side", "k"]).groupBy(*key).agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    near = materialize(_first_words(materialize(open_.join(classes.select(*key, "first"), key), "open"), rows), "near")

    shared = _halves(F.col("n"))[1]
    since = F.when(F.col("lo") == 0, F.when(F.col("hi") == 1, F.lit(1)).otherwise(shared + 1)).otherwise(F.lit(1))
    until = F.when(F.col("hi") == 1, F.when(F.col("lo") == 0, F.col("n")).otherwise(F.col("n") - shared)).otherwise(F.col("n"))
    places = near.select("h1", "n", "w", F.explode(F.concat(F.array(F.lit(0)), F.sequence(since, until))).alias("i"))
    variant = F.when(F.col("i") == 0, F.xxhash64("w")).otherwise(
        F.xxhash64(F.slice("w", 1, F.greatest(F.col("i") - 1, F.lit(0))), F.slice("w", F.col("i") + 1, F.greatest(F.col("n") - F.col("i"), F.lit(0))))
    )
    variants = materialize(places.select("h1", "n", "i", variant.alias("v")), "deletions")
    joint = variants.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("v")
    cand = materialize(variants.join(joint, "v").join(near.select("h1", "first"), "h1"), "variants")

    dels = cand.where("i > 0")
    lead = dels.groupBy("v", "n", "i").agg(F.min(F.struct("first", "h1")).alias("e"), F.count(F.lit(1)).alias("c")).where("c > 1")
    subst = dels.join(lead, ["v", "n", "i"]).where(F.col("h1") != F.col("e.h1")).select(F.col("h1").alias("x"), F.col("e.h1").alias("y"))
    whole = cand.where("i = 0").select("v", (F.col("n") + 1).alias("n"), F.col("h1").alias("fh"), F.col("first").alias("ff"))
    ins = dels.join(whole, ["v", "n"])
    later = F.col("first") > F.col("ff")
    ins = ins.select(F.when(later, F.col("h1")).otherwise(F.col("fh")).alias("x"), F.when(later, F.col("fh")).otherwise(F.col("h1")).alias("y"))
    pairs = subst.unionByName(ins).distinct()
    side = lambda a: near.select(F.col("h1").alias(a), F.col("h2").alias(f"{a}2"), F.col("w").alias(f"w{a}"), F.col("first").alias(f"f{a}"))
    pairs = pairs.join(side("x"), "x").join(side("y"), "y").where(F.col("fx") > F.col("fy"))
    return pairs.where(_within_one(F.col("wx"), F.col("wy"))).select(F.col("x").alias("h1"), F.col("x2").alias("h2")).distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Lines to remove: one row (id, th, drops) per document that has any; th is xxhash64 of its text, drops the line numbers from 0."""
    rows = _rows(docs, id_col, text_col)
    lines = rows.where("text is not null").select("id", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("trim(line) <> ''")
    table = materialize(_keys(lines.select("id", "th", "line_no", words_of(F.col("line")).alias("w")), "id", "th", "line_no"), "lines").where("n > 0")
    classes = materialize(
        table.groupBy("h1", "h2").agg(
            F.min(F.struct("id", "line_no", "th")).alias("first"), F.count(F.lit(1)).alias("c"), F.min("n").alias("n"), *[F.min(x).alias(x) for x in ("p1", "p2", "s1", "s2")]
        ),
        "classes",
    )
    near = materialize(_near(classes.where(F.col("n") >= min_words), rows), "near").withColumn("near", F.lit(True))
    flagged = classes.select("h1", "h2", "first", "c").join(near, ["h1", "h2"], "left").where("c > 1 or near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    flagged = materialize(flagged, "flagged")
    is_first = F.struct("id", "line_no", "th").eqNullSafe(F.col("first"))
    drops = table.select("id", "th", "line_no", "h1", "h2").join(small_side(flagged), ["h1", "h2"]).where(F.col("near") | ~is_first)
    return drops.groupBy("id", "th").agg(F.collect_set("line_no").alias("drops"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Documents without the lines that repeat an earlier line exactly or within one word edit.

    The edit is allowed in lines of at least `min_words` words; shorter ones repeat only with equal words; lines without
    a word always stay. Earlier means a smaller (id, line number), null ids first and a text's hash deciding between
    equal ids; a line goes when any earlier line is within the bound, whether or not that one stays. Returns the input
    columns, whatever their names, with text_col rewritten, and n_lines, n_removed (long); input columns of these two
    names are replaced. A null text stays null with no lines; an empty text is one line; rows with equal ids and texts
    count as one document; a text of any length is a list of lines; an empty table gives no rows.
    """
    drops = materialize(repeated_lines(docs, id_col, text_col, min_words), "drops")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    own = {c: f"c{k}" for k, c in enumerate(names)}
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()])
    text = F.col(own[text_col])
    match = F.col(own[id_col]).cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(text.cast("string")) == F.col("th"))
    joined = rows.join(small_side(drops), match, "left")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("drops", i)), "\n")
    none = F.col("drops").isNull()
    return joined.select(
        *[(F.when(none, text).otherwise(left) if c == text_col else F.col(a)).alias(c) for c, a in own.items()],
        F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("n_lines"),
        F.when(none, F.lit(0)).otherwise(F.size("drops")).cast("long").alias("n_removed"),
    )


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, line_no, line, list_filter(string_split_regex(lower(line), '[ \t\r\f\x0B]+'), lambda x: x <> '') AS ws FROM l),
c AS (SELECT ws, len(ws) AS n, min({'d': doc_id, 'l': line_no}) AS f FROM w WHERE len(ws) >= 1 GROUP BY ws),
e AS (SELECT * FROM c WHERE n >= 5),
v AS (SELECT ws, n, f, i, ws[1:i-1] || ws[i+1:n] AS v FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM e)),
near AS (
  SELECT a.ws FROM v a JOIN v b ON a.v = b.v AND a.i = b.i AND a.n = b.n WHERE b.f < a.f
  UNION SELECT a.ws FROM v a JOIN e b ON a.v = b.ws WHERE b.f < a.f
  UNION SELECT b.ws FROM v a JOIN e b ON a.v = b.ws WHERE a.f < b.f),
kept AS (
  SELECT w.doc_id, count(*) AS n_lines,
    count(*) FILTER (WHERE c.ws IS NOT NULL AND (near.ws IS NOT NULL OR c.f <> {'d': w.doc_id, 'l': w.line_no})) AS n_removed,
    string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT (c.ws IS NOT NULL AND (near.ws IS NOT NULL OR c.f <> {'d': w.doc_id, 'l': w.line_no}))) AS text
  FROM w LEFT JOIN c ON c.ws = w.ws LEFT JOIN (SELECT DISTINCT ws FROM near) near ON near.ws = c.ws
  GROUP BY w.doc_id)
SELECT doc_id, coalesce(text, '') AS text, n_lines, n_removed FROM kept
"""
