"""Embedding near-dedup: spherical k-means cells and blocked cosine products within them.

Equal vectors are one class from the start. Each class vector lives in the cell of its nearest centre and is a guest in
every cell whose border it is near: a pair that a border parts lies, on one side at least, within half the distance
that the threshold allows. Guests within all of it are taken, which makes the search exact. A `reach` below sqrt(dim)
takes those within that many standard deviations of the distance for a random direction, and loses pairs of vectors that
vary in few directions. Cells are packed into boxes, or split over several, and boxes meet in pairs: a vector is sent
once for each box that has a cell in which it is a guest, or a guest in its cell, whatever their number there. No task
holds more than two boxes and the products of a strip of one with the other, whatever the size of a cell. Products are
taken in single precision first; what they may have rounded below the threshold is taken again in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from loomtext.operators.components import connected_components
from loomtext.session import materialize

SAMPLE_ROWS = 20_000
PER_CELL = 2000
#: Vectors in a box: about a SPREAD-th of all, but no fewer than LEAST_BLOCK, nor more than BLOCK or VALUES components.
BLOCK = 32_768
LEAST_BLOCK = 2000
SPREAD = 12
VALUES = 1 << 23
STRIP = 1000
#: Share of close pairs in a strip from which all its products are taken in double precision.
DENSE = 0.02


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k unit centres of the unit rows of x, deterministic; empty centres keep their place."""
    pick = np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)
    centres = x[np.sort(pick)]
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return centres


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def close(xa: np.ndarray, xb: np.ndarray, threshold: float):
    """Pairs of unit rows with a double product of the threshold or more: (first row of a strip of xb, rows of xa, rows of the strip)."""
    fa, fb = xa.astype(np.float32), xb.astype(np.float32)
    least = np.float32(threshold - (xa.shape[1] + 8) * 2.0**-23)  # below it by more than single precision can err
    strip = max(1, min(STRIP, (1 << 23) // max(1, len(xa))))
    for start in range(0, len(xb), strip):
        part = xb[start : start + strip]
        at = np.flatnonzero(fa @ fb[start : start + strip].T >= least)
        if len(at) > DENSE * len(xa) * len(part):
            at = np.flatnonzero(xa @ part.T >= threshold)
        elif len(at):
            few = max(1, (1 << 22) // xa.shape[1])
            pieces = (np.divmod(at[k : k + few], len(part)) for k in range(0, len(at), few))
            at = at[np.concatenate([np.einsum("ij,ij->i", xa[i], part[j]) for i, j in pieces]) >= threshold]
        if len(at):
            yield start, *np.divmod(at, len(part))


def spread(i: np.ndarray, j: np.ndarray, n: int, ids: np.ndarray) -> np.ndarray:
    """Of each of n rows, the row of the smallest id reachable over the links i - j: labels spread until none changes."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    to = rank.copy()
    while ((least := np.minimum(to[i], to[j])) < np.maximum(to[i], to[j])).any():
        np.minimum.at(to, i, least)
        np.minimum.at(to, j, least)
    return order[to]


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, per_cell: int = PER_CELL,
    block: int = BLOCK, reach: float | None = None, sample: int = SAMPLE_ROWS,
) -> DataFrame:
    """Vectors linked by cosine >= threshold, in double precision.

    Returns one row per input row: id_col (long), n_links (other vectors linked directly), component_id (smallest id
    reachable, itself included), kept (id = component_id) and class_id (smallest id of an equal vector).
    Vectors that are null, zero, empty or hold null or non-finite components link with nothing, nor do rows with a null
    id; vectors of different lengths never link; rows with equal ids are linked as separate vectors but share a node; an
    empty table gives no rows; other columns are ignored. The centres are fitted on at most about `sample` vectors,
    chosen by their hash; every vector is indexed.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    good = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = materialize(rows.withColumn("ok", F.col("id").isNotNull() & F.coalesce(good, F.lit(False))).select("id", F.when(F.col("ok"), F.col("v")).alias("v")), "vectors")
    keys = ["k1", "k2"]  # 128 bits stand for a vector, which travels no further than its class
    rows = rows.withColumns({"k1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "k2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(7), "v"))})
    reps = materialize(rows.where("v is not null").groupBy(*keys).agg(F.first("v").alias("v"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")), "classes")

    centres: dict[int, np.ndarray] = {}
    for r in reps.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect():
        own = reps.where(F.size("v") == r["dim"]).select("v")
        if r["n"] > sample:
            own = own.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(sample / r["n"] * (1 << 30)))
        x = _unit([row["v"] for row in own.collect()] or [[1.0] * r["dim"]])
        centres[r["dim"]] = spherical_kmeans(x, max(1, min(1024, math.ceil(r["n"] / per_cell))))

    # Vectors travel as they were given: single precision takes half the bytes of double.
    form = np.float32 if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else np.float64
    vectors_at = lambda x: _unit(np.frombuffer(b"".join(x), form).reshape(len(x), -1))
    gap = math.sqrt(max(0.0, 2 - 2 * threshold)) / 2

    def assign(batches):
        for pdf in batches:
            out = []
            for dim, at in pdf.groupby(pdf["v"].map(len)).indices.items():
                part = pdf.iloc[at]
                m = centres[dim]
                x = _unit(part["v"])
                dots = x @ m.T
                home = dots.argmax(axis=1)
                between = np.sqrt(np.maximum(2 - 2 * (m @ m.T), 1e-18))
                off = (dots[np.arange(len(x)), home][:, None] - dots) / between[home]
                near = off <= gap * (1.0 if reach is None else min(1.0, reach / math.sqrt(dim))) + 1e-12
                near[np.arange(len(x)), home] = False
                for k in range(len(x)):
                    out.append((part["rep"].iloc[k], part["c"].iloc[k], dim, int(home[k]), np.flatnonzero(near[k]).astype(np.int32), np.asarray(part["v"].iloc[k], form).tobytes()))
            yield pd.DataFrame(out, columns=["rep", "c", "dim", "home", "guests", "x"])

    placed = materialize(reps.mapInPandas(assign, "rep long, c long, dim int, home int, guests array<int>, x binary"), "placed")
    whole = Window.partitionBy("dim")
    # Cells are packed into boxes of about as many vectors, large ones dealt to several: one row a cell, so their number
    # is bounded by the number of centres.
    size = F.least(F.lit(block), F.greatest(F.lit(min(block, LEAST_BLOCK)), F.ceil(F.sum("n").over(whole) / SPREAD)), F.greatest(F.lit(1), F.floor(F.lit(VALUES) / F.col("dim"))))
    cells = placed.groupBy("dim", F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("n")).withColumn("size", size)
    cells = cells.withColumn("upto", F.sum("n").over(whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cells = materialize(cells.select("dim", "cell", F.floor((F.col("upto") - F.col("n")) / F.col("size")).cast("int").alias("first"), F.ceil(F.col("n") / F.col("size")).cast("int").alias("parts")), "cells")
    held = F.broadcast(cells.withColumn("boxes", F.sequence("first", F.col("first") + F.col("parts") - 1)))
    part = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int")
    boxed = placed.join(held.withColumnRenamed("cell", "home"), ["dim", "home"]).withColumn("box", F.col("first") + part).drop("first", "parts", "boxes")
    # Which cells each box has guests in. A vector meets the boxes of the cells that it is a guest in, and those that have
    # guests in its own cell.
    visits = materialize(boxed.select("dim", "box", F.explode("guests").alias("cell")).distinct(), "visits")
    hosts = held.join(visits.groupBy("dim", "cell").agg(F.collect_set("box").alias("visitors")), ["dim", "cell"], "left")
    hosts = materialize(hosts.select("dim", "cell", "boxes", F.coalesce("visitors", F.array().cast("array<int>")).alias("visitors")), "hosts")
    lists = hosts.groupBy("dim").agg(F.map_from_entries(F.collect_list(F.struct("cell", "boxes"))).alias("m"), F.max("cell").alias("last"))
    none = F.array().cast("array<int>")
    lists = lists.select("dim", F.transform(F.sequence(F.lit(0), "last"), lambda g: F.coalesce(F.element_at("m", g), none)).alias("boxes_of"))
    boxed = boxed.join(F.broadcast(hosts.select("dim", F.col("cell").alias("home"), F.concat("boxes", "visitors").alias("near"))), ["dim", "home"]).join(F.broadcast(lists), "dim")
    meets = F.array_distinct(F.concat("near", F.flatten(F.transform("guests", lambda g: F.coalesce(F.get("boxes_of", g), none)))))
    dealt = boxed.withColumn("other", F.explode(meets)).select("dim", F.least("box", "other").alias("p"), F.greatest("box", "other").alias("q"), F.col("box").alias("own"), "rep", "c", "x")

    def links(key, pdf):
        _, p, q = key
        a, b = (pdf[pdf["own"] == side].reset_index(drop=True) for side in (p, q))
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": [], "n": [], "to": []})
        xa = vectors_at(a["x"])
        xb = xa if p == q else vectors_at(b["x"])
        ids, c = ((a[k].to_numpy() if p == q else np.concatenate([a[k], b[k]])) for k in ("rep", "c"))
        n, ties = np.zeros(len(ids), np.int64), []
        for start, i, j in close(xa, xb, threshold):
            j = j + start
            if p == q:
                i, j = i[i < j], j[i < j]
            else:
                j = j + len(a)
            n += (np.bincount(i, c[j], len(ids)) + np.bincount(j, c[i], len(ids))).astype(np.int64)
            to = spread(i, j, len(ids), ids)
            ties.append((at := np.flatnonzero(to != np.arange(len(ids))), to[at]))
        at = np.flatnonzero(n)
        to = spread(*(np.concatenate([t[k] for t in ties]) for k in (0, 1)), len(ids), ids) if ties else np.arange(len(ids))
        return pd.DataFrame({"rep": ids[at], "n": n[at], "to": ids[to[at]]})

    found = materialize(dealt.groupBy("dim", "p", "q").applyInPandas(links, "rep long, n long, to long"), "links")
    comp = connected_components(found.select(F.col("rep").alias("a"), F.col("to").alias("b"))).select(F.col("node").alias("rep"), "component")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    salts = 16
    done = reps.join(counts, "rep", "left").join(comp, "rep", "left")
    done = done.select(*keys, "rep", (F.col("c") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
    done = done.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        rows.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(salts)).cast("int"))
        .join(done, [*keys, "salt"], "left")
        .select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"), F.coalesce("rep", "id").alias("class_id"))
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
        .select(id_col, "n_links", "component_id", "kept", "class_id")
    )
