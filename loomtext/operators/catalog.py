"""Catalogue of papers: identity, resolution, upserts, quotas and queues."""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from loomtext.functions import text as T
from loomtext.operators.components import connected_components
from loomtext.session import materialize


def paper_groups(papers: DataFrame) -> DataFrame:
    """(id, component): papers that share a DOI or a title key, directly or through others; the smallest id names the group.

    papers: (id long, dois array, titles array). Every key is joined to its first holder only, so a common key adds one
    edge a paper.
    """
    dois = papers.select("id", F.explode(F.transform("dois", lambda d: F.struct(F.lit("d").alias("t"), T.doi_key(d).alias("k")))).alias("x"))
    titles = papers.select("id", F.explode(F.transform("titles", lambda d: F.struct(F.lit("t").alias("t"), T.title_key(d).alias("k")))).alias("x"))
    keys = dois.unionByName(titles).select("id", "x.*").where("k != ''").distinct()
    first = keys.groupBy("t", "k").agg(F.min("id").alias("a"))
    found = connected_components(keys.join(first, ["t", "k"]).select("a", F.col("id").alias("b")))
    return papers.select("id").join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def merge_papers(papers: DataFrame, groups: DataFrame, most_urls: int = 3) -> DataFrame:
    """One paper a group: aliases and origins united, the first known year, at most `most_urls` first-seen PDF addresses."""
    rows = papers.join(groups, "id")
    ordered = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", c))), lambda x: x[c])))
    return rows.groupBy(F.col("component").alias("id")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("dois")))).alias("dois"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("titles")))).alias("titles"),
        F.min_by("year", F.when(F.col("year").isNotNull(), F.col("id"))).alias("year"), F.slice(ordered("urls"), 1, most_urls).alias("urls"), F.count(F.lit(1)).alias("records"),
    )


def resolve_references(refs: DataFrame, papers: DataFrame) -> DataFrame:
    """(ref, paper, how): each reference to the first paper of its DOI, else to the only paper of its exact title, else to none."""
    by_doi = papers.select(T.doi_key(F.col("doi")).alias("dk"), F.col("id").alias("pd")).where("dk != ''").groupBy("dk").agg(F.min("pd").alias("pd"))
    by_title = papers.select(T.title_key(F.col("title")).alias("tk"), F.col("id").alias("pt")).where("tk != ''").groupBy("tk").agg(F.min("pt").alias("pt"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    r = refs.select("ref", T.doi_key(F.col("doi")).alias("dk"), T.title_key(F.col("title")).alias("tk")).join(by_doi, "dk", "left").join(by_title, "tk", "left")
    return r.select("ref", F.coalesce("pd", "pt").alias("paper"), F.when(F.col("pd").isNotNull(), "doi").when(F.col("pt").isNotNull(), "title").otherwise("none").alias("how"))


#: Title keys in a block of either side: two blocks meet in a task, and a key is sent once for each block of the other side.
TITLES = 32_768


def title_pieces(title: str) -> set[str]:
    """The distinct runs of three characters of a title key with a blank at either end."""
    padded = f" {title} "
    return {padded[k : k + 3] for k in range(len(title))}


def alike(xs: list[str], ys: list[str], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each of xs, by its place, the places of those ys whose piece sets have 100 * common >= percent * united, as far as there are any."""
    ids: dict[str, int] = {}
    each = [[ids.setdefault(p, len(ids)) for p in title_pieces(y)] for y in ys]
    sizes = np.array([len(e) for e in each])
    held = np.fromiter((p for e in each for p in e), np.int64, sizes.sum())
    where = np.repeat(np.arange(len(ys)), sizes)[np.argsort(held, kind="stable")]
    lists = np.split(where, np.cumsum(np.bincount(held, minlength=len(ids)))[:-1])
    for k, x in enumerate(xs):
        own = title_pieces(x)
        met = [lists[ids[p]] for p in own if p in ids]
        if met:
            common = np.bincount(np.concatenate(met), minlength=len(ys))
            at = np.flatnonzero((100 + percent) * common >= percent * (len(own) + sizes))
            if len(at):
                yield k, at


def similar_titles(left: DataFrame, right: DataFrame, percent: int = 40, most: int = TITLES) -> DataFrame:
    """(x, y): distinct title keys of both sides (column `key`) whose piece sets have 100 * common >= percent * united.

    Both sides are dealt to blocks of at most about `most` keys, and blocks meet in pairs: a task counts the pieces that
    a key of one has in common with all of the other, and what it finds is all that leaves it. Equal keys are taken once,
    so that a title of many papers joins as one.
    """
    held = [materialize(df.where("key <> ''").select("key").distinct(), "titles") for df in (left, right)]
    # No fewer than eight blocks of either side where there is much to do, so that the pairs are many tasks.
    sizes = [s.count() for s in held]
    blocks = [math.ceil(n / min(most, max(1000, math.ceil(n / 8)))) or 1 for n in sizes]
    own = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = held[0].select(own(blocks[0]).alias("p"), every(blocks[1]).alias("q"), F.lit(0).alias("side"), "key")
    sent = sent.unionByName(held[1].select(every(blocks[0]).alias("p"), own(blocks[1]).alias("q"), F.lit(1).alias("side"), "key"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides: tuple[list[str], list[str]] = ([], [])
        for pdf in batches:
            for side in (0, 1):
                sides[side].extend(pdf.loc[pdf["side"] == side, "key"])
        xs, ys = sides
        x: list[str] = []
        y: list[str] = []
        for k, at in alike(xs, ys, percent) if xs and ys else ():
            x += [xs[k]] * len(at)
            y += [ys[j] for j in at]
            if len(x) >= 50_000:
                yield pd.DataFrame({"x": x, "y": y})
                x, y = [], []
        yield pd.DataFrame({"x": x, "y": y}, dtype=object)

    return sent.groupBy("p", "q").applyInPandas(meet, "x string, y string")


def title_ratios(pairs: DataFrame) -> DataFrame:
    """(x, y, ratio): twice the characters in matching blocks over all characters, blocks found from the longest on."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(ratio=[difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(pdf["x"], pdf["y"], strict=True)])

    return pairs.select("x", "y").mapInPandas(run, "x string, y string, ratio double")


def resolve_similar(refs: DataFrame, papers: DataFrame, percent: int = 40, least: float = 0.45) -> DataFrame:
    """resolve_references() with a third stage: a reference without either goes to the paper of the closest title, as `similar`.

    Titles are compared if they share enough pieces (similar_titles); the highest ratio of `least` or more wins, then the
    smaller title, then the smallest id. A title that several papers have is a candidate like any other.
    """
    done = materialize(resolve_references(refs, papers), "resolved")
    open_ = done.where("how = 'none'").join(refs.select("ref", T.title_key(F.col("title")).alias("x")), "ref").where("x <> ''")
    ids = papers.select(T.title_key(F.col("title")).alias("y"), "id").where("y <> ''").groupBy("y").agg(F.min("id").alias("id"))
    close = title_ratios(similar_titles(open_.select(F.col("x").alias("key")), ids.select(F.col("y").alias("key")), percent)).where(F.col("ratio") >= least)
    best = close.join(ids, "y").groupBy("x").agg(F.min_by("id", F.struct(-F.col("ratio"), F.col("y"))).alias("near"))
    found = open_.join(best, "x").select("ref", "near")
    return done.join(found, "ref", "left").select("ref", F.coalesce("paper", "near").alias("paper"), F.when(F.col("near").isNotNull(), "similar").otherwise(F.col("how")).alias("how"))


def latest(rows: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """The last row of every key (upsert result)."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc(tie))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def first_seen(rows: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """The first row of every key (idempotent submit)."""
    w = Window.partitionBy(key).orderBy(order, tie)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def search(papers: DataFrame, needle: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """Papers whose title or DOI holds the needle, whatever its case, newest first."""
    low = needle.lower()
    hit = (F.instr(F.lower("title"), low) > 0) | (F.instr(F.lower("doi"), low) > 0)
    return papers.where(hit).orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def visible(bundled: DataFrame, shared: DataFrame, removed: DataFrame) -> DataFrame:
    """Bundled papers and ready shared ones of other contents, without those removed."""
    ready = shared.where("state = 'ready'").join(bundled.select("sha"), "sha", "left_anti").select("id", "sha", "created_at")
    return bundled.select("id", "sha", "created_at").unionByName(ready).join(removed.select("sha"), "sha", "left_anti").select("id", "sha", "created_at")


def attachable(papers: DataFrame, manuscript: DataFrame, attached: DataFrame, most: int = 800) -> DataFrame:
    """Ready papers of contents neither the manuscript's nor attached before, one a content, at most `most` in all."""
    w = Window.partitionBy("fingerprint").orderBy("id")
    fresh = papers.where("state = 'ready'").join(manuscript.select("fingerprint"), "fingerprint", "left_anti").join(attached.select("fingerprint"), "fingerprint", "left_anti")
    return fresh.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r").orderBy("id").limit(most)


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(reference_id, change): added, kept, changed or missing entries between two manifests; a valid update has none missing."""
    o, n = old.select("reference_id", F.col("digest").alias("od")), new.select("reference_id", F.col("digest").alias("nd"))
    change = F.when(F.col("od").isNull(), "added").when(F.col("nd").isNull(), "missing").when(F.col("od") == F.col("nd"), "kept").otherwise("changed")
    return o.join(n, "reference_id", "full").select("reference_id", change.alias("change"))


def rolling(events: DataFrame, by: str | None, seconds: int, value: str | None = None, out: str = "n", ts: str = "ts") -> DataFrame:
    """events with the count (or sum of value) of the key's events (all events without a key) in the `seconds` up to and with each.

    Time is cut into slices of that length. An event stands in its slice and, to be counted, in the next one, so a
    window never leaves its slice and a busy key is spread over as many tasks as it has slices.
    """
    span = seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    own = F.floor(at / span)
    rows = events.withColumn("__at", at).withColumn("__slice", F.explode(F.array(own, own + 1)))
    w = Window.partitionBy(*[by] * bool(by), "__slice").orderBy("__at").rangeBetween(-span, 0)
    rows = rows.withColumn(out, F.count(F.lit(1)).over(w) if value is None else F.sum(value).over(w))
    return rows.where(F.col("__slice") == F.floor(F.col("__at") / span)).drop("__at", "__slice")
