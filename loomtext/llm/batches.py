"""Small parts of Arrow batches, so that a task's results never pile up beside its input."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROWS, CHARS = 256, 1 << 20


def trim() -> None:
    """Give freed memory back to the system: workers live on, idle, after their task, beside the next stage's."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """At most 1,000 rows an Arrow batch, unless the session has a limit of its own: texts make wide rows, and the
    buffers of 10,000 of them, twice over in the JVM and once in each worker, stay allocated."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def parts(batches: Iterator[pd.DataFrame], rows: int = ROWS, chars: int = CHARS, text: str = "text") -> Iterator[pd.DataFrame]:
    """The frames in slices of at most `rows` rows and about `chars` characters of the text column (or one longer text)."""
    for pdf in batches:
        start, held = 0, 0
        for k, n in enumerate(pdf[text].map(lambda t: len(t) if t is not None else 0)):
            if k > start and (k - start >= rows or held + n > chars):
                yield pdf.iloc[start:k]
                start, held = k, 0
            held += n
        if start < len(pdf):
            yield pdf.iloc[start:]
    trim()


_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<struct<id:long,cosine:double,label:int>>": pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())])),
    "array<struct<label:string,start:long,end:long,priority:int,base:boolean>>": pa.list_(
        pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int32()), ("base", pa.bool_())])
    ),
}


def map_texts(df: DataFrame, keep: dict[str, Column], text: Column, fields: dict[str, str], make: Callable[..., list], rows: int = ROWS, size: int = CHARS, more: list[Column] | None = None) -> DataFrame:
    """The columns of `keep` as they are, and new columns that `make` gives for a list of texts (one list a field).

    The values of the columns in `more` go to `make` beside the texts, a list each. Texts go to `make` in parts of at most `rows` values and about `size` bytes; what is kept passes through Arrow
    untouched, whatever its type and nulls.
    """
    small_batches(df.sparkSession)
    more = more or []
    plain = df.select(*[c.alias(f"c{k}") for k, c in enumerate(keep.values())], *[c.alias(f"m{k}") for k, c in enumerate(more)], text.alias("text"))
    n_kept = len(keep)
    types = [_TYPES[t] for t in fields.values()]

    def run(batches):
        for batch in batches:
            values = batch.column("text")
            sizes = pc.multiply(pc.list_value_length(values), 8) if pa.types.is_list(values.type) else pc.binary_length(values)
            sizes = pc.fill_null(sizes, 0).to_pylist()
            start, held = 0, 0
            for k, n in enumerate([*sizes, None]):
                if k > start and (n is None or k - start >= rows or held + n > size):
                    part = batch.slice(start, k - start)
                    new = make(part.column("text").to_pylist(), *[c.to_pylist() for c in part.columns[n_kept:-1]])
                    yield pa.RecordBatch.from_arrays([*part.columns[:n_kept], *[pa.array(v, t) for v, t in zip(new, types, strict=True)]], names=[*part.schema.names[:n_kept], *fields])
                    start, held = k, 0
                held += n or 0
        trim()

    old = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(plain.schema.fields[:n_kept]))
    done = plain.mapInArrow(run, ", ".join([old] * bool(old) + [f"{n} {t}" for n, t in fields.items()]))
    return done.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(keep)], *fields)
