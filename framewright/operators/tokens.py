"""Context tokens of quantised blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import tables
from ..functions.symbols import cluster, count_context, density_context, hybrid, pack_signed, predict_nonzeros


def block_context():
    """Columns c (0 X, 1 Y, 2 B) and side -> block context."""
    out = F.lit(0)
    for c in range(3):
        for side in tables.SIDES:
            out = F.when((F.col("c") == c) & (F.col("side") == side), tables.block_context(c, side)).otherwise(out)
    return out


def log2_covered():
    return F.when(F.col("side") == 16, 2).when(F.col("side") == 32, 4).otherwise(0)


def nonzero_grid(blocks: DataFrame) -> DataFrame:
    """Rows (image, by, bx, c, side, scanned) of first blocks -> nz, normalised, at every position that a block covers."""
    covered = F.call_function("shiftleft", F.lit(1), log2_covered())
    nz = F.size(F.filter(F.slice("scanned", covered + 1, F.size("scanned")), lambda v: v != 0))
    rows = blocks.select("image", "by", "bx", "c", "side", nz.alias("nz"), F.call_function("shiftright", nz + covered - 1, log2_covered()).alias("norm"))
    span = F.sequence(F.lit(0), (F.col("side") / 8 - 1).cast("int"))
    rows = rows.withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span))
    return rows.select("image", (F.col("by") + F.col("dy")).alias("by"), (F.col("bx") + F.col("dx")).alias("bx"), "c", "side", "nz", "norm", ((F.col("dy") == 0) & (F.col("dx") == 0)).alias("first"))


def predicted(grid: DataFrame) -> DataFrame:
    """Add the count predicted from the block above and the one to the left within the 32 x 32 group."""
    group = [F.floor(F.col("by") / 32), F.floor(F.col("bx") / 32)]
    left = F.lag("norm").over(W.partitionBy("image", "c", "by", group[1]).orderBy("bx"))
    top = F.lag("norm").over(W.partitionBy("image", "c", "bx", group[0]).orderBy("by"))
    return grid.withColumn("predicted", predict_nonzeros(left, top))


def tokenize(blocks: DataFrame) -> DataFrame:
    """Tokens in coding order within (image, group, by, bx, c): the count (k = -1), then coefficients up to the last non-zero.

    Out: image, gy, gx, by, bx, c, k, context, cluster, symbol, nbits, bits.
    """
    keys = ["image", "by", "bx", "c"]
    counts = predicted(nonzero_grid(blocks)).where("first").select(*keys, "nz", "predicted")
    rows = blocks.join(counts, keys).withColumns({"l2": log2_covered(), "ctx": block_context()})
    head = F.struct(F.lit(-1).alias("k"), count_context(F.col("predicted"), F.col("ctx")).alias("context"), F.col("nz").cast("long").alias("number"))
    covered = F.call_function("shiftleft", F.lit(1), F.col("l2"))
    last = F.size("scanned") - 1
    at = F.filter(F.when(F.col("nz") > 0, F.sequence(covered, last)).otherwise(F.array().cast("array<int>")), lambda k: F.get("scanned", k) != 0)
    first = F.when(F.col("nz") > F.col("side") * F.col("side") / 16, 0).otherwise(1)

    def run(end, i):
        """Tokens up to the i-th non-zero coefficient: what is left is the same for all; only the one after a non-zero has such a neighbour."""
        begin = F.when(i == 0, covered).otherwise(F.get("at", i - 1) + 1)

        def token(k):
            prev = F.when(k == covered, first).when(k == begin, 1).otherwise(0)
            context = density_context((F.col("nz") - i).cast("int"), k, F.col("l2"), prev, F.col("ctx"))
            return F.struct(k.alias("k"), context.alias("context"), pack_signed(F.get("scanned", k)).cast("long").alias("number"))

        return F.transform(F.sequence(begin, end), token)

    coded = rows.withColumn("at", at).select(*keys, F.explode(F.concat(F.array(head), F.flatten(F.transform("at", run)))).alias("t"))
    every = coded.select(*keys, "t.*").withColumn("h", hybrid(F.col("number")))
    return every.select("image", F.floor(F.col("by") / 32).alias("gy"), F.floor(F.col("bx") / 32).alias("gx"), "by", "bx", "c", "k", "context", cluster(F.col("context")).alias("cluster"), "h.*")
