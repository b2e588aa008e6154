"""Streaming queries over the given tables, drained to the end, with SQL counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomtext.session import shared_dir, table
from loomtext.streaming import incremental as I


def _stream(spark, d, name):
    still = table(spark, d, name)
    path = f"{d}/{name}.parquet"
    # A stream source is a folder of files; a single-file table is matched by its name.
    return spark.readStream.schema(still.schema).parquet(path + "*")


def stream_window_counts(spark, d):
    """Events of each kind in hourly windows."""
    e = _stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = I.daily_counts(e, by="event_type", width="1 hour")
    done = I.drain(counts, spark, "complete")
    last = done.agg(F.max("batch").alias("batch"))
    return done.join(F.broadcast(last), "batch").select(F.unix_seconds("window.start").alias("hour_start"), "event_type", "n")


def stream_first_wins(spark, d):
    """Number of request keys that pass a first-wins stream."""
    e = _stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("|", "user_id", "props").alias("k"))
    return I.drain(I.first_wins(e, "k", within="3650 days"), spark).groupBy().agg(F.count(F.lit(1)).alias("kept"), F.countDistinct("k").alias("n_keys"))


def stream_import_states(spark, d):
    """Import states of users, their events taken as state updates."""
    kind = F.element_at(F.create_map(*[F.lit(x) for p in (("view", "resolving"), ("click", "downloading"), ("error", "failed"), ("purchase", "processing")) for x in p]), F.col("event_type"))
    e = _stream(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.coalesce(kind, F.lit("queued")).alias("state"))
    done = I.drain(I.import_states(e), spark, "update")
    return done.groupBy("id").agg(F.max_by("state", "batch").alias("state"), F.max(F.col("applied") + F.col("refused")).cast("long").alias("updates"))


def stream_incremental_overlap(spark, d):
    """Exact runs of the documents against sources that arrive as a stream."""
    top = f"{shared_dir(spark).rstrip('/')}/loomtext-{uuid.uuid4().hex}"
    sources = _stream(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    I.incremental_overlap(sources, table(spark, d, "documents").select("doc_id", "text"), f"{top}/out", f"{top}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{top}/out").select("m", "s", "i", "j", "n")


def _runs_sql():
    from loomtext.plans.overlap_queries import RUNS

    return f"WITH {RUNS} SELECT m, s, i, j, n FROM runs"


QUERIES = {
    "stream_window_counts": (stream_window_counts, "SELECT (epoch_us(ts) // 3600000000) * 3600 AS hour_start, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "stream_first_wins": (stream_first_wins, "SELECT count(DISTINCT user_id || '|' || props) AS kept, count(DISTINCT user_id || '|' || props) AS n_keys FROM events"),
    "stream_import_states": (stream_import_states, None),
    "stream_incremental_overlap": (stream_incremental_overlap, _runs_sql()),
}
