"""Block operators on array columns: they stay in the JVM and need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import tables


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def matrix(rows) -> Column:
    return F.array(*[literal(r) for r in rows])


def dot(a: Column, b: Column) -> Column:
    """Ordered sum of products: the same for every partitioning."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def dct(px: Column, n: int) -> Column:
    """Separable transform of an n x n raster block; position fx * n + fy."""
    basis = matrix(tables.dct_basis(n))
    by_column = F.flatten(F.transform(basis, lambda b: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: dot(F.slice(px, r * n + 1, n), b))))
    return F.transform(F.array(by_column), lambda rows: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda fx: F.transform(basis, lambda b: dot(F.slice(rows, fx * n + 1, n), b)))))[0]


def quantize(coeff: Column, n: int, channel: int, strength: float) -> Column:
    """Round half to even of coefficient / step. Rounded to nine digits first, so that the last bit of a sum can't decide."""
    return F.zip_with(coeff, literal(tables.dequant(n, channel)), lambda c, w: F.rint(F.round(c * strength / w, 9)).cast("int"))


def dequantize(q: Column, n: int, channel: int, strength: float) -> Column:
    return F.zip_with(q, literal(tables.dequant(n, channel)), lambda v, w: v * w / strength)


def scan(coeff: Column, n: int) -> Column:
    """Raw order to scan order. The array is bound first: inside the inner lambda it would be computed for each element."""
    order = F.array(*[F.lit(int(i)) for i in tables.scan_order(n)])
    return F.transform(F.array(coeff), lambda c: F.transform(order, lambda i: F.get(c, i)))[0]


def nonzeros(scanned: Column, covered: int) -> Column:
    """Non-zero values from scan position ``covered`` on."""
    return F.size(F.filter(F.slice(scanned, covered + 1, F.size(scanned)), lambda v: v != 0))
