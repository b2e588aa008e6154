"""Structured Streaming forms of the stateful behaviours: quotas, first-wins submits, import states, incremental overlap."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomtext.operators import overlap as O
from loomtext.session import materialize, shared_dir


def daily_counts(events: DataFrame, ts: str = "ts", by: str = "user_id", late: str = "1 hour", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events of each key in tumbling or sliding windows, late ones up to `late` counted."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), by).agg(F.count(F.lit(1)).alias("n"))


def first_wins(requests: DataFrame, key: str, ts: str = "ts", within: str = "1 day") -> DataFrame:
    """Each request key once; repeats within the time given are dropped."""
    return requests.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


#: Which import states may follow each other.
NEXT_STATES = {
    "queued": {"resolving", "cancelled"}, "resolving": {"downloading", "metadata-only", "failed", "cancelled"},
    "downloading": {"processing", "unavailable", "failed", "cancelled"}, "processing": {"ready", "failed", "cancelled"}, "failed": {"queued"},
}


def import_states(updates: DataFrame) -> DataFrame:
    """(id, state, applied, refused) of streamed (id, seq, state) updates; only legal transitions are applied."""

    def step(key, batches, state):
        now, applied, refused = state.get if state.exists else ("queued", 0, 0)
        for pdf in batches:
            for _, row in pdf.sort_values("seq").iterrows():
                if row["state"] in NEXT_STATES.get(now, ()):
                    now, applied = row["state"], applied + 1
                else:
                    refused += 1
        state.update((now, applied, refused))
        yield pd.DataFrame({"id": [key[0]], "state": [now], "applied": [applied], "refused": [refused]})

    return updates.groupBy("id").applyInPandasWithState(step, "id long, state string, applied int, refused int", "state string, applied int, refused int", "update", "NoTimeout")


def incremental_overlap(sources: DataFrame, manuscripts: DataFrame, out: str, checkpoint: str, k: int = 9):
    """Compare sources as they arrive with fixed manuscripts: a started query that appends exact runs to `out`.

    The manuscripts' word runs are one static table; every micro-batch joins its own sources with it, and a restart goes
    on after the last batch that the checkpoint folder has.
    """

    def batch(df: DataFrame, number: int) -> None:
        O.exact_runs(manuscripts, df, k).withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    return sources.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, spark: SparkSession, mode: str = "append", collect: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all that is there into a Parquet table of the shared folder, and read it."""
    import uuid

    top = f"{shared_dir(spark).rstrip('/')}/loomtext-{uuid.uuid4().hex}"
    out, ck = f"{top}/out", f"{top}/checkpoint"

    def write(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", ck).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.withColumn("batch", F.lit(0)).schema if collect is None else None
    return spark.read.schema(schema).parquet(out) if schema else materialize(collect(spark.read.parquet(out)))
