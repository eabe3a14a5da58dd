"""Order-dependent operators. No operator moves a whole table, or all rows of one key, into one task: where a group may be
large its rows are dealt into chunks that follow the order, and a second, small step carries what each chunk needs from
those before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


CHUNK = 4096  # keys of the order in one chunk


def exclusive_scan(value: str, by: list[str], order: list[str]) -> Column:
    """Sum of the values before a row within its group; 0 for the first."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def scan_large(df: DataFrame, value: str, by: list[str], order: list[str], chunk: Column, start: str = "offset", total: str | None = None) -> DataFrame:
    """exclusive_scan for groups too large for a task: within chunks first, then over the chunks' sums. Chunks must follow the order. total: a column for the group's sum."""
    rows = df.withColumn("__chunk", chunk)
    inner = rows.withColumn("__in", exclusive_scan(value, [*by, "__chunk"], order))
    sums = rows.groupBy(*by, "__chunk").agg(F.sum(value).alias("__sum"))
    starts = sums.withColumn("__start", exclusive_scan("__sum", by, ["__chunk"]))
    if total:
        starts = starts.withColumn(total, F.sum("__sum").over(W.partitionBy(*by)))
    return inner.join(starts.drop("__sum"), [*by, "__chunk"]).withColumn(start, F.col("__start") + F.col("__in")).drop("__chunk", "__in", "__start")


def nearest_rank(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The element at index round-half-up(p (n - 1)) of each group's sorted values, for each name: p.

    Equal values are counted before the exchange. A group's values are counted by ranges of about a 256th of their size;
    only the distinct values of the range that holds a wanted index are ranked.
    """
    v = F.col(value)
    rows = df.where(v.isNotNull()).select(*by, value, F.floor(F.signum(v) * F.log1p(F.abs(v)) * 256).alias("__range"))
    fine = rows.groupBy(*by, "__range", value).agg(F.count(F.lit(1)).alias("__n"))
    coarse = fine.groupBy(*by, "__range").agg(F.sum("__n").alias("__n"))
    coarse = coarse.withColumn("__before", exclusive_scan("__n", by, ["__range"])).withColumn("__all", F.sum("__n").over(W.partitionBy(*by)))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.floor(F.lit(p) * (F.col("__all") - 1) + 0.5).alias("i")) for name, p in shares.items()]))
    wanted = coarse.withColumn("__w", asked).where((F.col("__w.i") >= F.col("__before")) & (F.col("__w.i") < F.col("__before") + F.col("__n")))
    wanted = wanted.select(*by, "__range", F.col("__w.name").alias("__name"), (F.col("__w.i") - F.col("__before")).alias("__i"))
    ranked = fine.join(wanted, [*by, "__range"]).withColumn("__lower", exclusive_scan("__n", [*by, "__name"], [value]))
    hit = ranked.where((F.col("__i") >= F.col("__lower")) & (F.col("__i") < F.col("__lower") + F.col("__n")))
    return hit.groupBy(*by).agg(*[F.max(F.when(F.col("__name") == name, v)).alias(name) for name in shares])


def dedupe_names(df: DataFrame, base: str, order: list[str], chunk: Column, name: str = "name") -> DataFrame:
    """The first of equal names stays, the n-th gets the suffix _n. Chunks must follow the order."""
    counted = scan_large(df.withColumn("__one", F.lit(1).cast("long")), "__one", [base], order, chunk, "__before").drop("__one")
    numbered = F.concat_ws("_", F.col(base), (F.col("__before") + 1).cast("string"))
    return counted.withColumn(name, F.when(F.col("__before") == 0, F.col(base)).otherwise(numbered)).drop("__before")


def move_to_front(df: DataFrame, by: list[str], order: str, symbol: str, kinds: int, chunk: Column) -> DataFrame:
    """code: how many symbols were seen since this one last was (before any was seen the smaller ones come first).

    The last place of each symbol before a chunk comes from the chunks' last places; inside a chunk from a window.
    """
    rows = df.withColumn("__chunk", chunk)
    at = [F.when(F.col(symbol) == k, F.col(order)) for k in range(kinds)]
    ends = rows.groupBy(*by, "__chunk").agg(*[F.max(at[k]).alias(f"__end{k}") for k in range(kinds)])
    earlier = W.partitionBy(*by).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*by, "__chunk", *[F.max(f"__end{k}").over(earlier).alias(f"__old{k}") for k in range(kinds)])
    before = W.partitionBy(*by, "__chunk").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    seen = rows.select("*", *[F.max(at[k]).over(before).alias(f"__new{k}") for k in range(kinds)]).join(ends, [*by, "__chunk"])
    places = F.array(*[F.coalesce(f"__new{k}", f"__old{k}", F.lit(-k - 1).cast("long")) for k in range(kinds)])
    own = F.get("__places", F.col(symbol))
    return seen.withColumn("__places", places).select(*df.columns, F.size(F.filter("__places", lambda p: p > own)).alias("code"))


def streaks(df: DataFrame, by: list[str], order: list[str], bad: Column, chunk: Column) -> DataFrame:
    """streak: number of a bad row within its run of consecutive bad rows; 0 for good rows. Chunks must follow the order.

    A chunk that begins with bad rows goes on counting from the bad rows that ended the one before, and from those of
    earlier chunks as far as all rows between are bad.
    """
    rows = df.withColumns({"__bad": bad, "__chunk": chunk})
    own = [*by, "__chunk"]
    rows = rows.withColumn("__run", F.count_if(~F.col("__bad")).over(W.partitionBy(*own).orderBy(*order)))
    rows = rows.withColumn("__n", F.count_if(F.col("__bad")).over(W.partitionBy(*own, "__run").orderBy(*order)))
    ends = rows.groupBy(*own).agg(F.max("__run").alias("__good"), F.max_by("__n", F.struct(*order)).alias("__tail"))
    stretch = F.count_if(F.col("__good") > 0).over(W.partitionBy(*by).orderBy("__chunk"))
    ends = ends.withColumn("__stretch", stretch).withColumn("__held", F.sum("__tail").over(W.partitionBy(*by, "__stretch").orderBy("__chunk")))
    ends = ends.select(*own, F.coalesce(F.lag("__held").over(W.partitionBy(*by).orderBy("__chunk")), F.lit(0)).alias("__before"))
    carried = F.when(F.col("__run") == 0, F.col("__before")).otherwise(0)
    return rows.join(ends, own).withColumn("streak", F.when(F.col("__bad"), F.col("__n") + carried).otherwise(0)).drop("__bad", "__chunk", "__run", "__n", "__before")
