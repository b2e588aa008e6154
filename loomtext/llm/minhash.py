"""MinHash near-dedup with b-bit signatures.

Word shingles are hashed to 64 bits; 192 minima per document give 38 band keys of five rows (candidates) and a packed
signature of the minima's low four bits (12 longs; documents of the last round get 64 more). Candidates whose collision-corrected estimate could still reach the
threshold are confirmed on the full shingle sets. Links are sought in three rounds (smallest partner, bucket leaders,
then every remaining pair of a bucket whose ends lie in different components), so groups of copies never expand into
all their pairs. In that last round the open documents of a large bucket are dealt to blocks, and blocks meet in pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from loomtext.llm.batches import map_texts
from loomtext.operators.components import connected_components
from loomtext.session import materialize, small_side

PERMUTATIONS, ROWS, BITS = 192, 5, 4
BANDS = PERMUTATIONS // ROWS
LANES = PERMUTATIONS * BITS // 64
FINE = 1024
#: Open documents of a bucket that one group of the last round compares at once.
BLOCK = 2000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240607)
_BYTES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FLIP = _RNG.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)[:, None]
_MULT = (_RNG.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_FINE_FLIP = _RNG.integers(0, 2**32, FINE, dtype=np.uint32)[:, None]
_FINE_MULT = (_RNG.integers(0, 2**31, FINE, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_BAND = _RNG.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, in order."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = ~_SPACE[raw]
    if not inside.any():
        return np.empty(0, np.uint64)
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = ends - starts
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    power = np.cumprod(np.full(lengths.max(), _STEP, np.uint64))
    values = _BYTES[raw[inside]] * power[at]
    return _mix(np.add.reduceat(values, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; a shorter text is one shingle, a text without words has none."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(len(words) - width + 1, 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        total = (total + words[k : k + n]) * _STEP
        total ^= total >> np.uint64(29)
    return np.unique(_mix(total + np.uint64(min(width, len(words)))))


def _minima(sh: np.ndarray, flip: np.ndarray, mult: np.ndarray) -> np.ndarray:
    x = (sh >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(flip), 2**32 - 1, np.uint32)
    for k in range(0, len(x), 2048):
        np.minimum(least, ((x[None, k : k + 2048] ^ flip) * mult).min(axis=1), out=least)
    return least


def _packed(least: np.ndarray) -> np.ndarray:
    low = (least & np.uint32(15)).astype(np.uint64).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(low, axis=1).view(np.int64)


def signature(sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed low bits of the minima of a non-empty shingle set."""
    least = _minima(sh, _FLIP, _MULT)
    bands = _mix((least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return bands.view(np.int64), _packed(least)


def _fingerprint(sh: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit sums that stand for the whole set."""
    a, b = np.array([sh.sum(dtype=np.uint64), _mix(sh ^ _STEP).sum(dtype=np.uint64)]).view(np.int64)
    return int(a), int(b)


def _profiles(rows: DataFrame, width: int) -> DataFrame:
    def make(texts):
        out = []
        for text in texts:
            sh = shingles(text, width)
            if len(sh):
                bands, sig = signature(sh)
                out.append((len(sh), *_fingerprint(sh), bands, sig))
            else:
                out.append((0, 0, 0, None, None))
        return list(zip(*out))

    fields = {"n": "long", "f1": "long", "f2": "long", "bands": "array<long>", "sig": "array<long>"}
    return map_texts(rows, {"id": F.col("id")}, F.col("text"), fields, make)


def _sets(rows: DataFrame, width: int) -> DataFrame:
    def make(texts):
        sets = [shingles(t, width) for t in texts]
        marks = [_fingerprint(sh) for sh in sets]
        return [m[0] for m in marks], [m[1] for m in marks], [sh.view(np.int64) for sh in sets]

    return map_texts(rows, {"rep": F.col("id")}, F.col("text"), {"f1": "long", "f2": "long", "sh": "array<long>"}, make)


def _fine(rows: DataFrame) -> DataFrame:
    def make(sets):
        return ([_packed(_minima(np.array(sh, np.int64).view(np.uint64), _FINE_FLIP, _FINE_MULT)) for sh in sets],)

    return map_texts(rows, {"rep": F.col("rep")}, F.col("sh"), {"fine": "array<long>"}, make)


def _differing(v: Column) -> Column:
    """How many of the sixteen four-bit fields of a long are not zero."""
    v = v.bitwiseOR(F.shiftrightunsigned(v, 1))
    return F.bit_count(v.bitwiseOR(F.shiftrightunsigned(v, 2)).bitwiseAND(F.lit(0x1111111111111111)))


def _corrected(differ: Column, n: int) -> Column:
    """Jaccard estimate from n minima of which `differ` differ in their low bits, corrected for chance equality."""
    chance = 1 / 2**BITS
    return ((1 - differ / n) - chance) / (1 - chance)


def matching_estimate(x: str, y: str) -> Column:
    differ = F.lit(0)
    for k in range(LANES):
        differ = differ + _differing(F.col(x)[k].bitwiseXOR(F.col(y)[k]))
    return _corrected(differ, PERMUTATIONS)


def fine_estimate(x: str, y: str) -> Column:
    each = F.zip_with(x, y, lambda a, b: _differing(a.bitwiseXOR(b)))
    return _corrected(F.aggregate(each, F.lit(0), lambda s, v: s + v), FINE)


def _floor(percent: int, slack: float, n: int) -> float:
    """The least estimate that a pair at the threshold gives, but for `slack` standard deviations."""
    p, chance = percent / 100, 1 / 2**BITS
    return p - chance * (1 - p) / (1 - chance) - slack * ((p * (1 - p) / n) ** 0.5) / (1 - chance)


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, slack: float = 4.0, block: int = BLOCK
) -> DataFrame:
    """Near-duplicate components of documents.

    Documents link when 100 * |A & B| >= percent * |A | B| on their sets of `width`-word shingles. Returns one row per
    input row: id_col (long), n_shingles (long), class_id (smallest id with the same set), component_id (smallest id
    reachable by links, itself included) and kept (id = component_id).
    A pair is examined when it shares one of the bands (at similarity 0.8 a pair shares none with probability 3e-7) and
    its estimate is no more than `slack` standard deviations under the threshold.
    Null or blank texts have an empty set and link with nothing; rows with equal ids each get a row and count as one node; a null id takes
    part in no link but its own set's class and is kept only if no document shares its component; an empty table gives
    no rows; other columns of the input are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    prof = materialize(
        _profiles(base, width), "profiles"
    )
    key = ["n", "f1", "f2"]
    reps = materialize(
        prof.where("n > 0 and id is not null").groupBy(*key).agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig")),
        "reps",
    )
    banded = reps.select("rep", F.posexplode("bands").alias("k", "band"))
    shared = banded.groupBy("band").agg(F.min("rep").alias("lead"), F.max("rep").alias("top")).where("lead < top").select("band", "lead")
    buckets = materialize(banded.join(shared, "band"), "buckets")

    sigs = reps.select("rep", "sig", "bands").join(buckets.select("rep").distinct(), "rep", "left_semi")
    sigs = materialize(sigs, "sigs")
    floor, fine_floor = (_floor(percent, slack, n) for n in (PERMUTATIONS, FINE))

    def likely(pairs: DataFrame) -> DataFrame:
        """pairs (a, b) whose estimate may reach the threshold."""
        s = lambda n: sigs.select(F.col("rep").alias(n), F.col("sig").alias(f"s{n}"))
        return pairs.join(s("a"), "a").join(s("b"), "b").where(matching_estimate("sa", "sb") >= floor).select("a", "b")

    first = buckets.where("lead < rep").groupBy("rep").agg(F.min("lead").alias("a")).select("a", F.col("rep").alias("b"))
    leads = buckets.where("lead < rep").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()

    wanted = sigs.select(F.col("rep").alias("id"))
    rows = sigs.count()
    found = base.join(small_side(wanted), "id", "left_semi") if rows else base.where("false")
    sets = materialize(
        _sets(found, width).dropDuplicates(["rep", "f1", "f2"]).select("rep", "sh")
        if rows
        else found.select(F.col("id").alias("rep"), F.array(F.lit(0).cast("long")).alias("sh")),
        "sets",
    )

    def confirmed(pairs: DataFrame) -> DataFrame:
        s = lambda n: sets.select(F.col("rep").alias(n), F.col("sh").alias(f"s{n}"))
        both = F.size(F.array_intersect("sa", "sb"))
        return (
            pairs.join(s("a"), "a")
            .join(s("b"), "b")
            .where(100 * both >= percent * (F.size("sa") + F.size("sb") - both))
            .select("a", "b")
        )

    def labels(links: DataFrame) -> DataFrame:
        return materialize(connected_components(links).select(F.col("node").alias("rep"), "component"), "labels")

    def labelled(df: DataFrame, lab: DataFrame, col: str, out: str) -> DataFrame:
        return df.join(lab.select(F.col("rep").alias(col), F.col("component").alias(out)), col, "left").withColumn(out, F.coalesce(out, col))

    links = materialize(confirmed(likely(first)), "links1")
    lab = labels(links)
    crossing = labelled(labelled(leads, lab, "a", "ca"), lab, "b", "cb").where("ca != cb").select("a", "b").join(first, ["a", "b"], "left_anti")
    more = materialize(confirmed(likely(crossing)), "links2")
    if more.limit(1).count():
        links = links.unionByName(more)
        lab = labels(links)
    # Every remaining pair of a bucket: only buckets that still hold several components, only pairs across them.
    tagged = labelled(buckets.select("band", "k", "rep"), lab, "rep", "c")
    mixed = tagged.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("band")
    open_ = materialize(tagged.join(mixed, "band", "left_semi").join(sigs, "rep"), "open")
    # Shingles of one open document alone (u of n) are in no intersection here: at most n - u can be shared, which
    # bounds the similarity of a pair from above and rules out most pairs of copies that were edited apart.
    own = sets.join(open_.select("rep").distinct(), "rep", "left_semi")
    lone = own.select("rep", F.explode("sh").alias("s")).groupBy("s").agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("c")).where("c = 1")
    lone = lone.groupBy("rep").agg(F.count(F.lit(1)).alias("u"))
    can = own.select("rep", F.size("sh").alias("n")).join(lone, "rep", "left").select("rep", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("most"))
    can = can.where(100 * F.col("most") >= percent * F.col("n"))
    fine = _fine(own.join(can.select("rep"), "rep", "left_semi"))
    open_ = materialize(open_.join(materialize(can.join(fine, "rep"), "fine"), "rep"), "bounded")
    # A bucket of several blocks becomes groups (p, q), p <= q, of two blocks each: no group outgrows its task.
    dealt = open_.join(small_side(open_.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))), "band")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})
    side = lambda n: dealt.select(F.col("rep").alias(n), *[F.col(k).alias(k + n) for k in ("band", "p", "q", "own", "k", "c", "n", "most", "sig", "bands", "fine")])
    x, y = side("a").where("owna = pa"), side("b").where("ownb = qb")
    shared_most = F.least("mosta", "mostb")
    within = 100 * shared_most >= percent * (F.col("na") + F.col("nb") - shared_most)
    # A pair counts in the first band that it shares; the finer signature then leaves little but pairs at the threshold.
    earlier = F.arrays_overlap(F.slice("bandsa", F.lit(1), F.col("ka")), F.slice("bandsb", F.lit(1), F.col("kb")))
    likely_rest = (matching_estimate("siga", "sigb") >= floor) & ~earlier & (fine_estimate("finea", "fineb") >= fine_floor)
    once = F.expr("pa < qa OR a < b")
    rest = x.join(y, F.expr("banda = bandb AND pa = pb AND qa = qb AND ca <> cb") & once & within & likely_rest).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    last = materialize(confirmed(rest.join(leads, ["a", "b"], "left_anti")), "links3")
    if last.limit(1).count():
        lab = labels(links.unionByName(last))

    classes = labelled(reps.select(*key, "rep"), lab, "rep", "component")
    salts = 16
    salted = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        prof.select("id", *key, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int").alias("salt"))
        .join(salted, [*key, "salt"], "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.coalesce("rep", "id").alias("class_id"),
            F.coalesce("component", "id").alias("component_id"),
        )
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    )
