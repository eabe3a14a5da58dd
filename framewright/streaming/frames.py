"""A folder of raw frames as a stream: each micro-batch runs the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import strips
from ..sources import media


def watch(spark: SparkSession, folder: str, width: int, height: int) -> DataFrame:
    """New frames as they arrive: image, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.nv12").load(folder)
    return rows.where(F.col("length") == width * height * 3 // 2).select(F.regexp_extract("path", "([^/]*)$", 1).alias("image"), "content")


def encode_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, width: int, height: int, distance: float = 1.0) -> StreamingQuery:
    """Append the first blocks of every new frame to a Parquet table; a batch that runs again replaces its own part."""

    def batch(frames: DataFrame, number: int) -> None:
        blocks = strips.frame_blocks(media.scanlines(frames, width, height), media.chroma_rows(frames, width, height), distance)
        blocks.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return watch(spark, folder, width, height).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
