"""Adapters that read driver tables as blocks and planes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

GRID = 8  # blocks side by side in the block view

#: SQL twins of the adapters.
PIXELS_SQL = """
pixels AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS e FROM embeddings)"""
PLANE_SQL = """
plane_size AS (SELECT 8 * ((count(*) + 7) // 8) AS h, count(*) AS n FROM embeddings),
plane_rows AS (SELECT y, least(y, (SELECT n - 1 FROM plane_size)) AS id FROM range((SELECT h FROM plane_size)) t(y)),
plane AS (SELECT y, x, least(greatest(round_even(60 + 1.5 * x + (CASE (y // 16 + x // 16) % 4 WHEN 0 THEN 0 WHEN 1 THEN 6 WHEN 2 THEN 48 ELSE 255 END) * e, 0), 0), 255) AS v, e
  FROM (SELECT y, unnest(range(64)) AS x, unnest(embedding)::DOUBLE AS e FROM embeddings JOIN plane_rows ON id = vec_id)),
chroma AS (SELECT a.cy, a.cx, least(greatest(round_even(128 + 40 * a.m, 0), 0), 255) AS cb, least(greatest(round_even(128 - 30 * b.m, 0), 0), 255) AS cr
  FROM (SELECT y // 2 AS cy, x // 2 AS cx, round(sum(e) / 4, 9) AS m FROM plane GROUP BY ALL) a
  JOIN (SELECT y // 2 AS cy, 31 - x // 2 AS cx, round(sum(e) / 4, 9) AS m FROM plane GROUP BY ALL) b USING (cy, cx))"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8x8 block per embedding: vec_id, label, by, bx, px (64 doubles, raster)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id", "label", F.floor(F.col("vec_id") / GRID).cast("int").alias("by"), (F.col("vec_id") % GRID).cast("int").alias("bx"), F.col("embedding").cast("array<double>").alias("px")
    )


def plane_height(spark: SparkSession, sf_dir: str) -> int:
    return 8 * -(-table(spark, sf_dir, "embeddings").count() // 8)


def _plane_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, e) of all vectors by number, the last one again up to a multiple of eight rows."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.col("embedding").cast("array<double>").alias("e"))
    n, height = table(spark, sf_dir, "embeddings").count(), plane_height(spark, sf_dir)
    if n == height:
        return rows
    more = rows.where(F.col("y") == n - 1).select(F.explode(F.sequence(F.lit(n).cast("long"), F.lit(height - 1).cast("long"))).alias("y"), "e")
    return rows.unionByName(more.select(F.col("y").cast(rows.schema["y"].dataType), "e"))


def scanlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64 pixel wide frame: image, y, luma (64 integers)."""
    rows = _plane_rows(spark, sf_dir)
    gain = F.array(*map(F.lit, (0.0, 6.0, 48.0, 255.0)))

    def pixel(e, x):
        g = F.get(gain, ((F.floor(F.col("y") / 16) + F.floor(x / 16)) % 4).cast("int"))
        return F.least(F.greatest(F.rint(60 + 1.5 * x + g * e), F.lit(0.0)), F.lit(255.0)).cast("int")

    return rows.select(F.lit("frame").alias("image"), F.col("y").cast("int").alias("y"), F.transform("e", pixel).alias("luma"))


def chroma_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half resolution: image, cy, cb, cr (32 integers each)."""
    lines = _plane_rows(spark, sf_dir).select(F.floor(F.col("y") / 2).cast("int").alias("cy"), (F.col("y") % 2).alias("odd"), "e")
    pair = lines.groupBy("cy").agg(F.max(F.when(F.col("odd") == 0, F.col("e"))).alias("a"), F.max(F.when(F.col("odd") == 1, F.col("e"))).alias("b"))

    def mean(c):
        return F.round((F.get("a", 2 * c) + F.get("a", 2 * c + 1) + F.get("b", 2 * c) + F.get("b", 2 * c + 1)) / 4, 9)

    clip = lambda v: F.least(F.greatest(F.rint(v), F.lit(0.0)), F.lit(255.0)).cast("int")
    cells = F.sequence(F.lit(0), F.lit(31))
    return pair.select(
        F.lit("frame").alias("image"), "cy", F.transform(cells, lambda c: clip(128 + 40 * mean(c))).alias("cb"), F.transform(cells, lambda c: clip(128 - 30 * mean(31 - c))).alias("cr")
    )
