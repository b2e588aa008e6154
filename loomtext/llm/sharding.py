"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots; the bytes and rows of each slot are summed; a versioned map gives each slot
its shard. Rebalancing edits the map: slots move from shards above the mean to shards below it, so records move only
with their slot. The map has as many rows as there are slots, whatever the number of records.
"""

from __future__ import annotations

import bisect
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomtext.session import materialize, shared_dir

SLOTS = 4096
TOLERANCE = 0.002


def slot_of(*cols: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(slots)).cast("int")


def first_map(shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Version 0 of the map: slots dealt in turn."""
    return {s: s % shards for s in range(slots)}


def rebalance(shard_of: dict[int, int], sizes: dict[int, int], shards: int, tolerance: float = TOLERANCE) -> dict[int, int]:
    """The next version of the map: moves slots, largest that helps first, until no move or swap brings sizes nearer."""
    new = dict(shard_of)
    load = [0] * shards
    held: list[set[int]] = [set() for _ in range(shards)]
    for slot, shard in new.items():
        load[shard] += sizes.get(slot, 0)
        held[shard].add(slot)
    size = lambda s: sizes.get(s, 0)
    mean, open_ = sum(load) / shards, set(range(shards))
    for _ in range(8 * len(new)):
        if not open_:
            break
        high, low = max(open_, key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        if gap <= tolerance * mean:
            break
        move = max((s for s in held[high] if 0 < size(s) < gap), key=lambda s: (-abs(gap - 2 * size(s)), -s), default=None)
        best, swap = abs(gap - 2 * size(move)) if move is not None else gap, None
        if best > tolerance * mean:  # no single slot fits: look for a pair whose exchange does
            there = sorted(held[low], key=lambda s: (size(s), s))
            at = [size(s) for s in there]
            for s in sorted(held[high]):
                k = bisect.bisect_left(at, size(s) - gap / 2)
                for t in there[max(0, k - 1) : k + 1]:
                    d = size(s) - size(t)
                    if 0 < d < gap and abs(gap - 2 * d) < best:
                        best, swap = abs(gap - 2 * d), (s, t)
        if best >= gap:
            open_.discard(high)  # one large slot: the others are still evened out
            continue
        for slot, a, b in [(swap[0], high, low), (swap[1], low, high)] if swap else [(move, high, low)]:
            held[a].discard(slot)
            held[b].add(slot)
            load[a] -= size(slot)
            load[b] += size(slot)
            new[slot] = b
    return new


def map_rows(spark: SparkSession, versions: list[dict[int, int]], first: int = 0) -> DataFrame:
    """Versions of the map, numbered from `first`, as a table (version, vslot, shard)."""
    rows = [(v, s, k) for v, m in enumerate(versions, first) for s, k in sorted(m.items())]
    return spark.createDataFrame(rows, "version int, vslot int, shard int")


def stored_map(spark: SparkSession, path: str) -> tuple[int, dict[int, int]] | None:
    """The latest version that the table at `path` holds, as (version, shard of each slot); None where there is none yet."""
    try:
        table = spark.read.schema("version int, vslot int, shard int").parquet(path)
    except AnalysisException:
        return None
    last = table.agg(F.max("version")).first()[0]
    return None if last is None else (last, {r["vslot"]: r["shard"] for r in table.where(F.col("version") == last).collect()})


def shard_records(docs: DataFrame, shards: int = 8, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """Every record with its shard, near equal in bytes, and its place in the shard.

    The slot map is a table (version, vslot, shard) at `map_path`, a new one in the shared folder unless given. Its latest
    version (or version 0, slots dealt in turn, which is then stored) is rebalanced for the bytes found; if that moves a
    slot, the edited map is appended as the next version. With another number of shards than before, slots of shards that
    are no more are dealt in turn first.

    A record's size is the UTF-8 bytes of its text (null: none) plus 1. Returns one row per input row: id_col, size
    (long), text_crc32 (long, unsigned, of the UTF-8 bytes; null text: that of no bytes), vslot (its virtual slot), shard
    and slot (its place in the shard, from 0 without gaps: by virtual slot, then id, checksum and size). The slot comes
    from the id, checksum and size, so equal ids or a hot text alone do not fill one slot (copies of a text are spread on purpose); rows equal in all three share
    a slot and are placed in any order. Null ids are hashed and ordered as a value of their own; an empty table gives no
    rows; other input columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    rows = materialize(rows.withColumn("vslot", slot_of(F.col("id"), F.col("crc"), F.col("size"), slots=slots)), "records")
    sums = {r["vslot"]: (r["b"], r["n"]) for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    path = map_path or f"{shared_dir(spark).rstrip('/')}/loomtext-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/slot_map"
    known = stored_map(spark, path)
    version, old = known or (0, first_map(shards, slots))
    if known is None:
        map_rows(spark, [old]).write.mode("append").parquet(path)
    final = rebalance({s: k if k < shards else s % shards for s, k in old.items()}, {s: b for s, (b, _) in sums.items()}, shards)
    if final != old:
        map_rows(spark, [final], version + 1).write.mode("append").parquet(path)
    offset, base = [0] * shards, []
    for s in range(slots):
        base.append((s, final[s], offset[final[s]]))
        offset[final[s]] += sums.get(s, (0, 0))[1]
    places = spark.createDataFrame(base, "vslot int, shard int, base long")
    order = Window.partitionBy("vslot").orderBy("id", "crc", "size")
    return (
        rows.withColumn("at", F.row_number().over(order) - 1)
        .join(F.broadcast(places), "vslot")
        .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("base") + F.col("at")).cast("long").alias("slot"), "vslot")
    )
