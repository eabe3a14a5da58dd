"""Integer coding functions as column expressions, and their Python twins for packing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import tables


def pack_signed(v: Column) -> Column:
    """0, -1, 1, -2, ... -> 0, 1, 2, 3, ..."""
    return F.when(v >= 0, 2 * v).otherwise(-2 * v - 1)


def _floor_log2(v: Column) -> Column:
    return F.length(F.bin(v.cast("long"))) - 1


def hybrid(v: Column) -> Column:
    """struct(symbol, nbits, bits) of a number >= 0: up to 15 itself, else exponent and two mantissa bits in the symbol, the rest raw."""
    n = _floor_log2(v)
    shift = lambda x, k: F.call_function("shiftright", x.cast("long"), k)
    large = F.struct(
        (16 + 4 * (n - 4) + shift(v, n - 2).bitwiseAND(F.lit(3))).cast("int").alias("symbol"),
        (n - 2).cast("int").alias("nbits"),
        (v.cast("long") - F.call_function("shiftleft", shift(v, n - 2), n - 2)).alias("bits"),
    )
    small = F.struct(v.cast("int").alias("symbol"), F.lit(0).alias("nbits"), F.lit(0).cast("long").alias("bits"))
    return F.when(v < 16, small).otherwise(large)


def clamped_gradient(left: Column, top: Column, corner: Column) -> Column:
    low, high = F.least(left, top), F.greatest(left, top)
    return F.when(corner < low, high).when(corner > high, low).otherwise(left + top - corner)


def _band(v: Column, limits: tuple[int, ...]) -> Column:
    out = F.lit(len(limits))
    for i in reversed(range(len(limits))):
        out = F.when(v < limits[i], i).otherwise(out)
    return out


def cluster(context: Column) -> Column:
    """Context 0..7424 -> cluster 0..31: luma and chroma apart, by bands of predicted count or of density."""
    counts = tables.BLOCK_CONTEXT_COUNT * tables.NONZERO_BUCKETS
    by_count = F.when(context % tables.BLOCK_CONTEXT_COUNT < 7, 0).otherwise(4) + _band(F.floor(context / tables.BLOCK_CONTEXT_COUNT), tables.COUNT_BANDS)
    rel = context - counts
    by_density = 8 + F.when(F.floor(rel / tables.ZERO_DENSITY_COUNT) < 7, 0).otherwise(12) + _band(rel % tables.ZERO_DENSITY_COUNT, tables.DENSITY_BANDS)
    return F.when(context < counts, by_count).otherwise(by_density).cast("int")


def count_context(predicted: Column, block_context: Column) -> Column:
    nz = F.least(predicted, F.lit(64))
    return (F.when(nz < 8, nz).otherwise(4 + F.floor(nz / 2)) * tables.BLOCK_CONTEXT_COUNT + block_context).cast("int")


def density_context(left: Column, k: Column, log2_covered: Column, prev: Column, block_context: Column) -> Column:
    """left: non-zeros from here on; k: scan position; prev: whether the coefficient before was non-zero (0 or 1)."""
    covered = F.call_function("shiftleft", F.lit(1), log2_covered)
    a = F.call_function("shiftright", left + covered - 1, log2_covered)
    b = F.call_function("shiftright", k, log2_covered)
    lit = lambda values: F.array(*map(F.lit, values))
    within = (F.get(lit(tables.NONZERO_CONTEXTS), a) + F.get(lit(tables.FREQUENCY_CONTEXTS), b)) * 2 + prev
    return (tables.BLOCK_CONTEXT_COUNT * tables.NONZERO_BUCKETS + tables.ZERO_DENSITY_COUNT * block_context + within).cast("int")


def predict_nonzeros(left: Column, top: Column) -> Column:
    """Neighbours are null at the group's edge."""
    return F.coalesce(F.floor((top + left + 1) / 2), top, left, F.lit(32)).cast("int")
