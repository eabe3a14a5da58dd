"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import ship


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share (spark.checkpoint.dir).

    Where the session sets none, a temporary folder is chosen and set on one machine (tests); on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="framewright-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/framewright/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: this cuts the lineage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote, once nothing needs it, and let Spark drop shuffles that nothing refers to."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    release(spark)


def release(spark: SparkSession) -> None:
    """Shuffle files go when their last reference is collected; without this they stay until the driver's heap fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def rest(spark: SparkSession) -> None:
    """Executors collect their garbage, one short task a core: only a full collection makes a heap that grew give memory back."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def join_hot(rows: DataFrame, by_key: DataFrame, key: str, count: str, total: int, parts: int = 2000) -> DataFrame:
    """rows joined with by_key (one row per key; the column ``count`` tells how many rows hold it) without a hot task.

    At most ``parts`` keys can hold over a ``parts``-th of ``total`` rows each: these are broadcast, the others are
    shuffled. ``total`` is the number of rows, or a bound up to twice as large.
    """
    hot = by_key.where(F.col(count) > total // parts + 16).drop(count)
    rest = by_key.where(F.col(count) <= total // parts + 16).drop(count)
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    cold = marked.where(F.col("__hot").isNull()).select(*rows.columns).join(rest, key)
    return marked.where("__hot").drop("__hot").unionByName(cold)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with value computed once: inside a lambda a plain expression would be computed for each element."""
    return F.transform(F.array(value), fn)[0]


def hand_back() -> None:
    """Give memory that a task no longer needs back to the system: workers stay alive between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the C library that has it
        pass


def bound_batches(spark: SparkSession) -> None:
    """Batches to Python of at most 4 MB where the session leaves the size as it comes: both sides hold several of them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "67108864b") == "67108864b":  # a default of None would hide that of Spark
        spark.conf.set(name, str(4 << 20))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with the package at hand; a worker hands its memory back when its task ends."""
    ship(df.sparkSession)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            hand_back()

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null is empty."""
    return [x or "" for x in column.to_pylist()]
