"""Session helpers: table readers, shared scratch folders, bounded broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Measured bytes up to which a side may be broadcast.
BROADCAST_BYTES = 48 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application, so that functions sent to them can be loaded."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    name = os.path.join(tempfile.mkdtemp(prefix="loomtext-"), "loomtext.zip")
    with zipfile.ZipFile(name, "w") as z:
        for at, _, files in os.walk(home):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(at, f), os.path.join("loomtext", os.path.relpath(os.path.join(at, f), home)))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only a local session may go without, in a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomtext-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def _step_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/loomtext-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{_step_root(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete what this application materialized; for use between jobs, when no result that reads it is still wanted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_step_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _size(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in a row."""
    if isinstance(kind, T.StringType | T.BinaryType):
        own = F.octet_length(value).cast("long") + 8
    elif isinstance(kind, T.StructType):
        own = sum((_size(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.AtomicType) and not isinstance(kind.elementType, T.StringType | T.BinaryType):
            own = F.size(value).cast("long") * 8 + 16
        else:
            own = F.aggregate(value, F.lit(16).cast("long"), lambda s, x: s + _size(x, kind.elementType).cast("long"))
    else:
        own = F.lit(8)
    return F.coalesce(own.cast("long"), F.lit(8).cast("long"))


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows are measured here to take at most `most` bytes, else df as it is."""
    row = sum((_size(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("long"))
    held = df.agg(F.coalesce(F.sum(row), F.lit(0)).alias("b")).first()["b"]
    return F.broadcast(df) if held <= most else df
