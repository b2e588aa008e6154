"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomtext.session import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph given by its edges.

    Returns (node, component): every node that has an edge to another node, with the smallest node reachable from it.
    Self-loops, repeated edges and edges with a null end add nothing; no edges give no rows. Each round is two
    pre-aggregated group-bys and joins on the node, so a hub is never held in one group, and is written to the shared
    folder; the number of rounds grows with the logarithm of the longest path.
    """
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    cur = materialize(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
    last = mark(cur)
    if last[0] == 0:
        return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = cur.select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        cur = materialize(
            large.join(low, "u")
            .select(F.explode(F.array(pair("u", "m"), pair("v", "m"))).alias("e"))
            .select("e.*")
            .where("u != v")
            .distinct(),
            "edges",
        )
        now = mark(cur)
        if now == last:
            break
        last = now
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
