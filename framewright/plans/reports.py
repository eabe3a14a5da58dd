"""Checks and report rows: worst quality per rung, verdicts, reuse, fixed-width lines, parsed reports, lookup failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..functions import text
from ..registry import ORACLES, query, table
from . import analysis, codec, corpus

#: Least quality that a rung may have, in decibels. Fixed values.
LEAST_PSNR = {"2160p": 31.4, "1080p": 28.99, "720p": 28.9}
#: Status and backend texts by code. Fixed values.
STATUS = ("ok", "not-implemented", "invalid-argument", "unsupported-resolution", "no-device", "internal-error", "buffer-too-small")


def _rung_sql(column: str) -> str:
    return f"CASE {column} % 3 WHEN 0 THEN '2160p' WHEN 1 THEN '1080p' ELSE '720p' END"


def rung_of(label: Column) -> Column:
    return F.when(label % 3 == 0, "2160p").when(label % 3 == 1, "1080p").otherwise("720p")


@query(
    f"""WITH measured AS ({ORACLES["psnr"]}), limits(rung, least) AS (VALUES {", ".join(f"('{r}', {v!r}::DOUBLE)" for r, v in LEAST_PSNR.items())}),
    worst AS (SELECT {_rung_sql("label")} AS rung, count(*) AS n, min(psnr) AS worst FROM measured JOIN embeddings USING (vec_id) GROUP BY ALL)
    SELECT rung, n, worst, least, worst >= least AS passed FROM worst JOIN limits USING (rung)"""
)
def worst_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst block of each rung against what it may be."""
    measured = codec.psnr(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    worst = measured.groupBy(rung_of(F.col("label")).alias("rung")).agg(F.count(F.lit(1)).alias("n"), F.min("psnr").alias("worst"))
    limits = F.broadcast(spark.createDataFrame(list(LEAST_PSNR.items()), "rung string, least double"))
    return worst.join(limits, "rung").select("rung", "n", "worst", "least", (F.col("worst") >= F.col("least")).alias("passed"))


@query(f"WITH checked AS ({ORACLES['budget_constraints']}) SELECT count(*) AS constraints, count(*) FILTER (WHERE passed) AS met, bool_and(passed) AS passed FROM checked")
def budget_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all constraints hold."""
    return analysis.budget_constraints(spark, sf_dir).agg(F.count(F.lit(1)).alias("constraints"), F.count_if("passed").alias("met"), F.bool_and("passed").alias("passed"))


@query(
    "WITH" + analysis._SWEEP + """, cached AS (SELECT * FROM sweep WHERE codec <> 'A' AND coded > 5)
    SELECT s.image, s.codec, s.param_value, c.bpp AS cached_bpp, CASE WHEN s.codec = 'A' THEN 'own' WHEN c.bpp IS NULL THEN 'made' ELSE 'reused' END AS state
    FROM sweep s LEFT JOIN cached c ON c.image = s.image AND c.codec = s.codec AND c.param_value = s.param_value"""
)
def reused_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep with a cache of other codecs' rows: the own codec is always measured, a cached row is reused, the rest is made anew."""
    rows = analysis.sweep(spark, sf_dir)
    keys = ["image", "codec", "param_value"]
    cached = rows.where((F.col("codec") != analysis.ANCHOR) & (F.col("coded") > 5)).select(*keys, F.col("bpp").alias("cached_bpp"))
    state = F.when(F.col("codec") == analysis.ANCHOR, "own").when(F.col("cached_bpp").isNull(), "made").otherwise("reused")
    return rows.select(*keys).join(cached, keys, "left").select(*keys, "cached_bpp", state.alias("state"))


def cached_rows(cache: DataFrame, own: str) -> DataFrame:
    """Rows of a sweep file that can be reused: other codecs'. A row without resolution is of an older form and an error."""
    rows = cache.where(F.col("codec") != own)
    why = F.concat(F.lit("row without resolution: "), F.concat_ws(" ", "image", "codec", "param"))
    return rows.withColumn("resolution", F.when(F.col("resolution").isNotNull(), F.col("resolution")).otherwise(F.raise_error(why).cast("string")))


_LINE = "format('{:<22} {:<9} {:<8} {:>10} {:>6.2f} {:>6.1f} {:>6.2f} {:>7.3f} {:>7.2f}', image[1:22], codec, param, bytes, bpp, ratio, psnr, butteraugli, ssimulacra2)"


@query(
    "WITH" + analysis._SWEEP + f""", rows_ AS (SELECT image, codec, concat('d=', param_value) AS param, coded * 1000 AS bytes, floor(bpp * 100) / 100 AS bpp, floor(240 / bpp) / 10 AS ratio, floor(psnr * 100) / 100 AS psnr,
      floor(butteraugli * 1000) / 1000 AS butteraugli, floor(ssimulacra2 * 100) / 100 AS ssimulacra2 FROM sweep)
    SELECT image, codec, param, {_LINE} AS line FROM rows_"""
)
def sweep_table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the sweep's fixed-width table (of numbers cut to what is shown, as engines break ties of a rounding unlike)."""
    from ..sources.reports import sweep_line

    cut = lambda v, n: F.floor(v * n) / n
    rows = analysis.sweep(spark, sf_dir).select(
        "image", "codec", F.concat(F.lit("d="), F.col("param_value").cast("string")).alias("param"), (F.col("coded") * 1000).alias("coded_bytes"), cut(F.col("bpp"), 100).alias("bpp"),
        (F.floor(240 / F.col("bpp")) / 10).alias("ratio"), cut(F.col("psnr"), 100).alias("psnr"), cut(F.col("butteraugli"), 1000).alias("butteraugli"), cut(F.col("ssimulacra2"), 100).alias("ssimulacra2"),
    )
    return rows.select("image", "codec", "param", sweep_line().alias("line"))


@query("WITH" + analysis._TIMING + " SELECT codec, CAST(3840 AS INTEGER) AS width, CAST(2160 AS INTEGER) AS height, n, total_us AS total, mean_us AS mean, fps, stddev_us AS stddev, min_us AS min, p50_us AS p50, p99_us AS p99, max_us AS max FROM timing")
def parse_bench_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timings written as text reports and read back by the reader of such reports."""
    from ..sources.media import parse_report

    s = analysis.timing_stats(spark, sf_dir)
    lines = [F.concat(F.lit("codec: "), "codec"), F.lit("size: 3840x2160")]
    fields = {"n": "n", "total": "total_us", "mean": "mean_us", "fps": "fps", "stddev": "stddev_us", "min": "min_us", "p50": "p50_us", "p99": "p99_us", "max": "max_us"}
    lines += [F.concat(F.lit(f"  {name}: "), F.col(c).cast("string")) for name, c in fields.items()]
    return parse_report(s.select(F.concat_ws("\n", *lines).alias("value")))


@query(
    f"""SELECT p_partkey AS id, p_size % 10 AS code, CASE {" ".join(f"WHEN p_size % 10 = {i} THEN '{s}'" for i, s in enumerate(STATUS))} ELSE 'internal-error' END AS status FROM part"""
)
def status_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of status codes; an unknown code is an internal error."""
    names = F.create_map(*[F.lit(x) for kv in enumerate(STATUS) for x in kv])
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 10).cast("int").alias("code"))
    return rows.select("id", "code", F.coalesce(F.try_element_at(names, F.col("code")), F.lit("internal-error")).alias("status"))


@query(
    """WITH asked AS (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN '2160p' WHEN 1 THEN '1080p' WHEN 2 THEN '720p' ELSE '480p' END AS rung FROM part),
    rungs(rung, factor, w, h) AS (VALUES ('2160p', 1, 3840, 2160), ('1080p', 2, 1920, 1080), ('720p', 3, 1280, 720))
    SELECT id, a.rung, factor, CASE WHEN factor IS NULL THEN concat('unsupported resolution: ', a.rung) END AS error FROM asked a LEFT JOIN rungs r ON r.rung = a.rung"""
)
def rung_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rungs by name; an unknown one carries its error (``checked_rung`` raises it)."""
    size = F.col("p_size") % 4
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(size == 0, "2160p").when(size == 1, "1080p").when(size == 2, "720p").otherwise("480p").alias("rung"))
    return with_rung(spark, asked).select("id", "rung", "factor", F.when(F.col("factor").isNull(), F.concat(F.lit("unsupported resolution: "), "rung")).alias("error"))


def with_rung(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows (rung, ...) with the rung's factor, width and height; null where there is no such rung."""
    return rows.join(F.broadcast(spark.createDataFrame(corpus.RUNGS, "rung string, factor int, rung_width int, rung_height int")), "rung", "left")


def checked_rung(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """with_rung, but an unknown rung is an error."""
    known = F.when(F.col("factor").isNotNull(), F.col("factor")).otherwise(F.raise_error(F.concat(F.lit("unsupported resolution: "), "rung")).cast("int"))
    return with_rung(spark, rows).withColumn("factor", known)


def checked_size(rows: DataFrame, width: int, height: int) -> DataFrame:
    """Frames of another size are an error that names both."""
    what = F.concat(F.lit(f"expected {width}x{height}, got "), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
    ok = (F.col("width") == width) & (F.col("height") == height)
    return rows.withColumn("width", F.when(ok, F.col("width")).otherwise(F.raise_error(what).cast("int")))


def failures(rows: DataFrame) -> None:
    """Raise all errors of rows (name, error) together, if there are any."""
    found = rows.where("error is not null").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "name", "error"))).alias("e")).first().e  # as many as fail
    if found:
        raise RuntimeError("failed:\n  " + "\n  ".join(found))


@query(
    f"""WITH cells AS (SELECT label AS tile, unnest(embedding[1:62])::DOUBLE AS x, unnest(embedding[2:63])::DOUBLE AS y, unnest(embedding[3:64])::DOUBLE AS b FROM embeddings),
    sums AS (SELECT tile, sum(x * y) AS xy, sum(y * y) AS yy, sum((b - {tables.BASE_B!r} * y) * y) AS dy FROM cells GROUP BY tile)
    SELECT tile, CAST(least(greatest(round_even(round(CASE WHEN yy > 0 THEN xy / yy ELSE 0 END * {tables.COLOR_FACTOR}, 9), 0), -128), 127) AS INTEGER) AS ytox,
      CAST(least(greatest(round_even(round(CASE WHEN yy > 0 THEN dy / yy ELSE 0 END * {tables.COLOR_FACTOR}, 9), 0), -128), 127) AS INTEGER) AS ytob FROM sums"""
)
def colour_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour factors of tiles from matched coefficients alone: regressions through the origin, partly summed before the exchange."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("tile"), F.col("embedding").cast("array<double>").alias("e"))
    part = lambda at: F.slice("e", at, 62)
    cells = e.select("tile", F.explode(F.arrays_zip(part(1).alias("x"), part(2).alias("y"), part(3).alias("b"))).alias("v")).select("tile", "v.*")
    return estimate(cells)


def estimate(cells: DataFrame) -> DataFrame:
    """tile, ytox, ytob from rows (tile, x, y, b); a tile without luma keeps the base factors."""
    s = cells.groupBy("tile").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum((F.col("b") - tables.BASE_B * F.col("y")) * F.col("y")).alias("dy"))
    factor = lambda top: F.least(F.greatest(F.rint(F.round(F.coalesce(F.try_divide(F.col(top), F.when(F.col("yy") > 0, F.col("yy"))), F.lit(0.0)) * tables.COLOR_FACTOR, 9)), F.lit(-128.0)), F.lit(127.0)).cast("int")
    return s.select("tile", factor("xy").alias("ytox"), factor("dy").alias("ytob"))


@query(
    """WITH firsts AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END AS side, (p_partkey * 4) % 96 AS bx, (p_partkey // 24) * 4 AS by_ FROM part),
    cells AS (SELECT id, side, bx, by_, unnest(range(side * side)) AS raw FROM firsts)
    SELECT id, count(*) AS n, CAST(min(slot) AS BIGINT) AS first, CAST(max(slot) AS BIGINT) AS last, CAST(sum(slot * (raw + 1)) AS BIGINT) AS checksum
    FROM (SELECT id, raw, ((by_ + (raw // 64) // (side // 8)) * 96 + bx + (raw // 64) % (side // 8)) * 64 + raw % 64 AS slot FROM cells) GROUP BY id"""
)
def slot_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a block's coefficients in a plane that keeps 64 for each 8x8 position: the blocks it covers, row by row."""
    size = F.col("p_size") % 3
    firsts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.when(size == 0, 8).when(size == 1, 16).otherwise(32).alias("side"), ((F.col("p_partkey") * 4) % 96).alias("bx"), (F.floor(F.col("p_partkey") / 24) * 4).alias("by")
    )
    slots = F.transform(F.sequence(F.lit(0), F.col("side") * F.col("side") - 1), lambda r: slot(F.col("side"), F.col("bx"), F.col("by"), F.lit(96), r))
    sums = firsts.withColumn("s", slots)
    checksum = F.aggregate(F.transform("s", lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return sums.select("id", F.size("s").cast("long").alias("n"), F.array_min("s").alias("first"), F.array_max("s").alias("last"), checksum.alias("checksum"))


def scattered(firsts: DataFrame, width: Column) -> DataFrame:
    """image, block, values (64) of each 8x8 position from first blocks (image, side, bx, by, coeff): a block's coefficients in the places of the blocks it covers."""
    m = F.floor(F.col("side") / 8)
    parts = firsts.select("image", "bx", "by", m.alias("m"), width.alias("w"), F.posexplode(F.transform(F.sequence(F.lit(0), m * m - 1), lambda q: F.slice("coeff", (q * 64 + 1).cast("int"), F.lit(64)))).alias("q", "values"))
    return parts.select("image", ((F.col("by") + F.floor(F.col("q") / F.col("m"))) * F.col("w") + F.col("bx") + F.col("q") % F.col("m")).alias("block"), "values")


def gathered(plane: DataFrame, firsts: DataFrame, width: Column) -> DataFrame:
    """The inverse: image, side, bx, by, coeff of first blocks (image, side, bx, by) from the positions' values."""
    m = F.floor(F.col("side") / 8)
    wanted = firsts.select("image", "side", "bx", "by", m.alias("m"), width.alias("w"), F.explode(F.sequence(F.lit(0).cast("long"), m * m - 1)).alias("q"))
    wanted = wanted.withColumn("block", (F.col("by") + F.floor(F.col("q") / F.col("m"))) * F.col("w") + F.col("bx") + F.col("q") % F.col("m"))
    parts = wanted.join(plane, ["image", "block"]).groupBy("image", "side", "bx", "by").agg(F.array_sort(F.collect_list(F.struct("q", "values"))).alias("p"))  # 16 at most
    return parts.select("image", "side", "bx", "by", F.flatten(F.col("p.values")).alias("coeff"))


@query(
    "WITH" + analysis._SWEEP + """, s AS (SELECT codec, param_value, round(avg(psnr) - 25, 6) AS change, round(stddev_samp(bpp), 6) AS spread FROM sweep GROUP BY ALL)
    SELECT codec, param_value, CASE WHEN change IS NULL THEN '-' ELSE concat(CASE WHEN change >= 0 THEN '+' ELSE '' END, format('{:.6f}', change)) END AS change, CASE WHEN spread IS NULL THEN '-' ELSE format('{:.6f}', spread) END AS spread FROM s"""
)
def signed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report cells: changes with their sign, '-' where there is no number."""
    s = analysis.sweep(spark, sf_dir).groupBy("codec", "param_value").agg(F.round(F.avg("psnr") - 25, 6).alias("change"), F.round(F.stddev_samp("bpp"), 6).alias("spread"))
    return s.select("codec", "param_value", text.signed(F.col("change"), 6).alias("change"), F.coalesce(F.format_string("%.6f", "spread"), F.lit("-")).alias("spread"))


def slot(side: Column, bx: Column, by: Column, width: Column, raw: Column) -> Column:
    """Place of coefficient ``raw`` of the block at (bx, by) in a plane of ``width`` blocks a row."""
    m, q = F.floor(side / 8), F.floor(raw / 64)
    return (((by + F.floor(q / m)) * width + bx + q % m) * 64 + raw % 64).cast("long")
