"""Interpolation join: values of one curve at the knots of another.

A curve is a bounded, sorted array of knots per key, so the join is an equi-join on the key, not a range join; the
segment is found inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def curves(points: DataFrame, by: list[str], x: str, y: str, name: str) -> DataFrame:
    """One row per key: sorted knots (x, y), with equal x merged to their mean y."""
    merged = points.groupBy(*by, F.col(x).alias("x")).agg(F.avg(y).alias("y"))
    return merged.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias(name))


def interpolate(knots: Column, at: Column) -> Column:
    """Linear between neighbouring knots, the knot's own value on a knot; null outside or with fewer than two knots."""
    below = F.filter(knots, lambda k: k["x"] <= at)
    above = F.filter(knots, lambda k: k["x"] >= at)
    p, q = F.get(below, F.size(below) - 1), F.get(above, F.lit(0))
    inside = (F.size(knots) >= 2) & (F.size(below) > 0) & (F.size(above) > 0)
    line = p["y"] + (q["y"] - p["y"]) * (at - p["x"]) / F.nullif(q["x"] - p["x"], F.lit(0.0))
    return F.when(inside, F.when(p["x"] == at, p["y"]).otherwise(line))
