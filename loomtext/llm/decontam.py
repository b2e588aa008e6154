"""Benchmark decontamination by spaced seeds, native expressions only.

A seed is a mask over ten consecutive tokens that reads six of them and ignores four, so a substituted token between
the read ones does not break it. Benchmark items and documents are hashed under every mask at every token; equal hashes
give hits (document, item, shift, place). Around each hit the aligned tokens are compared one by one. Items shorter than
a mask are sought as the whole sequence of their tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtext.session import materialize, small_side

MASKS = ("1101100011", "1110100101", "1011001011", "1001011101")
SPAN = 10
FLANKS = (5, 10)
MIN_OVERLAP = 12
MIN_ITEM = 5
PERCENT = 80


def tokens_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _seeds(df: DataFrame, *keep: str) -> DataFrame:
    """A row for every mask at every place of the token array w: keep..., i (from 0), k."""
    at = df.where(F.size("w") >= SPAN).select(*keep, "w", F.explode(F.sequence(F.lit(0), F.size("w") - SPAN)).alias("i"))
    hashes = [
        F.xxhash64(F.lit(m), *[F.col("w")[F.col("i") + o] for o, bit in enumerate(mask) if bit == "1"])
        for m, mask in enumerate(MASKS)
    ]
    return at.select(*keep, "i", F.array(*hashes).alias("ks")).select(*keep, "i", F.explode("ks").alias("k"))


def _whole(df: DataFrame, n: int, *keep: str) -> DataFrame:
    """A row for every n tokens in a row: keep..., i, k."""
    at = df.where(F.size("w") >= n).select(*keep, "w", F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("i"))
    return at.select(*keep, "i", F.xxhash64(F.lit(-n), *[F.col("w")[F.col("i") + o] for o in range(n)]).alias("k"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Documents that share a passage with a benchmark item.

    Tokens are the lower-cased runs of letters and digits. A hit is verified when the aligned tokens from a flank before
    to a flank after its seed, clipped to both texts, are at least MIN_OVERLAP (or the whole of a shorter item) and at
    least PERCENT per cent equal, under one of the FLANKS. Items of MIN_ITEM to SPAN - 1 tokens must stand in the document
    as they are; still shorter ones are too common to mark a passage and are not sought. A text without blanks or marks
    is one token, however long.
    Returns one row per document and item with a verified hit: id, th (xxhash64 of the text), item, n_hits (verified
    places) and best (most equal tokens around one), all long. Null, blank or shorter texts have no seeds and are in no
    row; null ids and null item ids are carried as they are; rows with equal ids and texts count once; an empty table on
    either side gives no rows; other columns, whatever their names, are ignored.
    A side is broadcast only if it is measured to be small; else both sides are shuffled on the hash.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    items = materialize(
        benchmark.select(F.col(item_col).cast("long").alias("item"), tokens_of(F.col(item_text_col)).alias("w")).where(F.size("w") >= MIN_ITEM).distinct(), "items"
    )
    items = items.select("item", "w", F.xxhash64("item", "w").alias("it"))
    tokens = rows.select("id", "th", tokens_of(F.col("text")).alias("w"))
    wanted, probes = _seeds(items, "it"), _seeds(tokens, "id", "th")
    for (n,) in items.where(F.size("w") < SPAN).select(F.size("w")).distinct().collect():  # of SPAN - MIN_ITEM lengths at most
        wanted = wanted.unionByName(_whole(items.where(F.size("w") == n), n, "it"))
        probes = probes.unionByName(_whole(tokens, n, "id", "th"))
    wanted = materialize(wanted.select("k", "it", F.col("i").alias("j")).distinct(), "seeds")
    hits = probes.join(small_side(wanted), "k").select("id", "th", "it", (F.col("i") - F.col("j")).alias("shift"), "j").distinct()
    hits = materialize(hits.groupBy("id", "th", "it").agg(F.collect_list(F.struct("shift", "j")).alias("hits")), "hits")

    found = hits.select(F.col("id").alias("hid"), F.col("th").alias("hth"), "it", "hits")
    near = rows.join(small_side(found), F.col("id").eqNullSafe(F.col("hid")) & (F.col("th") == F.col("hth")))
    near = near.select("id", "th", "it", "hits", tokens_of(F.col("text")).alias("w")).dropDuplicates(["id", "th", "it"])
    near = near.join(small_side(items.select("it", "item", F.col("w").alias("iw"))), "it")

    def equal(h: Column, flank: int) -> Column:
        """Equal tokens around a hit, or 0 where they are too few."""
        lo = F.greatest(h["j"] - flank, F.lit(0), -h["shift"])
        n = F.least(h["j"] + SPAN + flank, F.size("iw"), F.size("w") - h["shift"]) - lo
        same = F.zip_with(F.slice("w", lo + h["shift"] + 1, n), F.slice("iw", lo + 1, n), lambda a, b: (a == b).cast("int"))
        total = F.aggregate(same, F.lit(0), lambda s, x: s + x)
        share = F.when(F.size("iw") < SPAN, 100).otherwise(PERCENT)
        return F.when((n >= F.least(F.lit(MIN_OVERLAP), F.size("iw"))) & (100 * total >= share * n), total).otherwise(0)

    scored = near.select("id", "th", "item", F.filter(F.transform("hits", lambda h: F.greatest(*[equal(h, f) for f in FLANKS])), lambda e: e > 0).alias("e")).where(F.size("e") > 0)
    return scored.select("id", "th", "item", F.size("e").cast("long").alias("n_hits"), F.array_max("e").cast("long").alias("best"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that `contaminated` finds.

    All columns stay, whatever their names; null and short texts stay; rows with equal ids and texts go together.
    """
    bad = materialize(contaminated(docs, benchmark, id_col, text_col).select("id", "th").distinct(), "bad")
    own = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()])
    match = F.col(own[id_col]).cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(F.col(own[text_col]).cast("string")) == F.col("th"))
    return rows.join(small_side(bad), match, "left_anti").select(*[F.col(a).alias(c) for c, a in own.items()])


_SEED_SQL = " UNION ALL ".join(
    f"SELECT {{keep}}, i, '{m}|' || " + " || '|' || ".join(f"w[i + {o + 1}]" for o, bit in enumerate(mask) if bit == "1") + " AS k FROM {t}"
    for m, mask in enumerate(MASKS)
)
SQL = (
    r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
dp AS (SELECT *, unnest(range(0, len(w) - 9)) AS i FROM d WHERE len(w) >= 10),
bp AS (SELECT *, unnest(range(0, len(w) - 9)) AS i FROM b WHERE len(w) >= 10),
ds AS ("""
    + _SEED_SQL.format(keep="doc_id", t="dp")
    + """),
bs AS ("""
    + _SEED_SQL.format(keep="item_id", t="bp")
    + """),
sh AS (SELECT item_id, w, len(w) AS n FROM b WHERE len(w) BETWEEN 5 AND 9),
sd AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d JOIN (SELECT DISTINCT n FROM sh) ON len(w) >= n),
h AS (SELECT DISTINCT doc_id, item_id, ds.i - bs.i AS shift, bs.i AS j FROM ds JOIN bs USING (k)
  UNION SELECT doc_id, item_id, i AS shift, 0 AS j FROM sd JOIN sh ON sd.n = sh.n AND sd.w[i + 1:i + sd.n] = sh.w),
r AS (SELECT h.*, d.w AS w, b.w AS iw, greatest(j - f, 0, -shift) AS lo, least(j + 10 + f, len(b.w), len(d.w) - shift) AS hi
  FROM h JOIN d USING (doc_id) JOIN b USING (item_id) CROSS JOIN (VALUES (5), (10)) AS flanks(f)),
e AS (SELECT doc_id, item_id, shift, j, len(iw) AS item, hi - lo AS n, len(list_filter(range(lo, hi), lambda x: w[x + shift + 1] = iw[x + 1])) AS e FROM r)
SELECT doc_id, item_id, count(DISTINCT (shift, j)) AS n_hits, max(e) AS best FROM e
WHERE n >= least(12, item) AND 100 * e >= CASE WHEN item < 10 THEN 100 ELSE 80 END * n GROUP BY doc_id, item_id
"""
)
