"""Block transforms, quantisation, planes and encoder configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixtures, tables
from ..functions.symbols import clamped_gradient
from ..operators import blocks as B
from ..params import calibrate
from ..registry import query, table

DISTANCE = 1.0
CAL = calibrate(DISTANCE)

_VALUES = ", ".join(f"({i}, {float(w)!r})" for i, w in enumerate(tables.dequant(8, 1)))
_ORDER = ", ".join(f"({k}, {i})" for k, i in enumerate(tables.scan_order(8).tolist()))

COEFF_SQL = (
    fixtures.PIXELS_SQL
    + """,
basis AS (SELECT k, t, CASE WHEN k = 0 THEN 0.125 ELSE sqrt(2) / 8 * cos(pi() * (t + 0.5) * k / 8) END AS w FROM range(8) a(k), range(8) b(t)),
row_pass AS (SELECT vec_id, label, k AS fx, i // 8 AS r, sum(e * w) AS s FROM pixels JOIN basis ON t = i % 8 GROUP BY ALL),
coeffs AS (SELECT vec_id, label, fx, k AS fy, sum(s * w) AS c FROM row_pass JOIN basis ON t = r GROUP BY ALL)"""
)
QUANT_SQL = (
    COEFF_SQL
    + f""",
weights(raw, w) AS (VALUES {_VALUES}),
scan_order(k, raw) AS (VALUES {_ORDER}),
quantized AS (SELECT vec_id, label, fx, fy, c, w, CAST(round_even(round(c * {CAL.uniform!r} / w, 9), 0) AS INTEGER) AS q FROM coeffs JOIN weights ON raw = fx * 8 + fy),
scanned AS (SELECT vec_id, label, k, q, vec_id // 8 AS by_, vec_id % 8 AS bx FROM quantized JOIN scan_order ON raw = fx * 8 + fy)"""
)


def quantized_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block view with coeff, q (raw order) and scanned (scan order), all in one projection of the scan."""
    rows = fixtures.blocks(spark, sf_dir).withColumn("coeff", B.dct(F.col("px"), 8))
    rows = rows.withColumn("q", B.quantize(F.col("coeff"), 8, 1, CAL.uniform))
    return rows.withColumn("scanned", B.scan(F.col("q"), 8))


@query("WITH" + COEFF_SQL + " SELECT vec_id, fx, fy, round(c, 6) AS coeff FROM coeffs")
def dct8_coeffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.blocks(spark, sf_dir).select("vec_id", F.posexplode(B.dct(F.col("px"), 8)).alias("i", "c"))
    return rows.select("vec_id", F.floor(F.col("i") / 8).alias("fx"), (F.col("i") % 8).alias("fy"), F.round("c", 6).alias("coeff"))


@query("WITH" + QUANT_SQL + f" SELECT vec_id, fx, fy, q, round(q * w / {CAL.uniform!r}, 6) AS restored FROM quantized")
def dct8_quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantized_blocks(spark, sf_dir).select("vec_id", F.posexplode(F.arrays_zip("q", B.dequantize(F.col("q"), 8, 1, CAL.uniform).alias("restored"))).alias("i", "v"))
    return rows.select("vec_id", F.floor(F.col("i") / 8).alias("fx"), (F.col("i") % 8).alias("fy"), F.col("v.q").alias("q"), F.round("v.restored", 6).alias("restored"))


@query(
    "WITH" + QUANT_SQL + """, counts AS (SELECT vec_id, label, count(*) FILTER (WHERE q <> 0 AND fx + fy > 0) AS nz, sum(c * c) AS energy FROM quantized GROUP BY ALL)
    SELECT label, nz, count(*) AS n, round(sum(energy), 6) AS energy FROM counts GROUP BY ALL"""
)
def dct8_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label: how many blocks have how many non-zero coefficients, and their energy."""
    rows = quantized_blocks(spark, sf_dir).select("label", B.nonzeros(F.col("scanned"), 1).alias("nz"), B.dot(F.col("coeff"), F.col("coeff")).alias("energy"))
    return rows.groupBy("label", "nz").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("energy"), 6).alias("energy"))


@query("WITH" + QUANT_SQL + " SELECT vec_id, k, q AS v FROM scanned")
def natural_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantized_blocks(spark, sf_dir).select("vec_id", F.posexplode("scanned").alias("k", "v"))


@query(
    "WITH" + QUANT_SQL + """, m AS (SELECT vec_id, avg(pow(c - q * w / """ + repr(CAL.uniform) + """, 2)) AS mse FROM quantized GROUP BY vec_id)
    SELECT vec_id, round(mse, 9) AS mse, CASE WHEN mse = 0 THEN 99.0 ELSE round(10 * log10(1.0 / mse), 4) END AS psnr FROM m"""
)
def psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of restored coefficients per block; 99 for none."""
    diff = F.zip_with("coeff", B.dequantize(F.col("q"), 8, 1, CAL.uniform), lambda a, b: a - b)
    mse = B.dot(F.col("d"), F.col("d")) / 64
    rows = quantized_blocks(spark, sf_dir).withColumn("d", diff).select("vec_id", mse.alias("m"))
    return rows.select("vec_id", F.round("m", 9).alias("mse"), F.when(F.col("m") == 0, 99.0).otherwise(F.round(10 * F.log10(F.try_divide(F.lit(1.0), F.col("m"))), 4)).alias("psnr"))


DC_SQL = (
    COEFF_SQL
    + """,
dc AS (SELECT vec_id // 8 AS by_, vec_id % 8 AS bx, vec_id // 2048 AS g, CAST(round_even(round(c * 4096, 6), 0) AS INTEGER) AS v FROM coeffs WHERE fx = 0 AND fy = 0),
near AS (SELECT *, lag(v) OVER (PARTITION BY by_ ORDER BY bx) AS w, lag(v) OVER (PARTITION BY g, bx ORDER BY by_) AS n FROM dc),
near2 AS (SELECT *, lag(n) OVER (PARTITION BY by_ ORDER BY bx) AS nw FROM near),
filled AS (SELECT *, coalesce(w, n, 0) AS l, coalesce(n, w, 0) AS t, CASE WHEN w IS NOT NULL AND n IS NOT NULL THEN nw ELSE coalesce(w, n, 0) END AS c FROM near2),
residuals AS (SELECT by_, bx, g, v, v - CASE WHEN c < least(l, t) THEN greatest(l, t) WHEN c > greatest(l, t) THEN least(l, t) ELSE l + t - c END AS residual FROM filled)"""
)


def dc_residuals(dc: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by..., by_, bx, v) of a DC group grid with the residual of the clamped gradient; neighbours outside the group don't exist."""
    row, column = W.partitionBy(*by, "by_").orderBy("bx"), W.partitionBy(*by, "bx").orderBy("by_")
    near = dc.withColumns({"w": F.lag("v").over(row), "n": F.lag("v").over(column)}).withColumn("nw", F.lag("n").over(row))
    left, top = F.coalesce("w", "n", F.lit(0)), F.coalesce("n", "w", F.lit(0))
    corner = F.when(F.col("w").isNotNull() & F.col("n").isNotNull(), F.col("nw")).otherwise(left)
    return near.withColumn("residual", F.col("v") - clamped_gradient(left, top, corner)).drop("w", "n", "nw")


def dc_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.blocks(spark, sf_dir).select(F.col("by").alias("by_"), "bx", F.floor(F.col("by") / 256).alias("g"), F.get(B.dct(F.col("px"), 8), F.lit(0)).alias("c"))
    return rows.select("by_", "bx", "g", F.rint(F.round(F.col("c") * 4096, 6)).cast("int").alias("v"))


@query("WITH" + DC_SQL + " SELECT * FROM residuals")
def dc_gradient_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc_residuals(dc_grid(spark, sf_dir), ["g"]).select("by_", "bx", "g", "v", "residual")


# Planes ---------------------------------------------------------------------------------------------------------------

XYB_SQL = (
    fixtures.PLANE_SQL
    + """,
taps AS (SELECT p.y, p.x, any_value(p.v) AS v, sum(wy.w * wx.w * c.cb) AS cb, sum(wy.w * wx.w * c.cr) AS cr
  FROM plane p, (SELECT unnest([0, 1]) AS far, unnest([0.75, 0.25]) AS w) wy, (SELECT unnest([0, 1]) AS far, unnest([0.75, 0.25]) AS w) wx, chroma c
  WHERE c.cy = least(greatest(p.y // 2 + wy.far * CASE WHEN p.y % 2 = 0 THEN -1 ELSE 1 END, 0), (SELECT h // 2 - 1 FROM plane_size))
    AND c.cx = least(greatest(p.x // 2 + wx.far * CASE WHEN p.x % 2 = 0 THEN -1 ELSE 1 END, 0), 31) GROUP BY p.y, p.x),
rgb AS (SELECT y, x, least(greatest(v / 255 + 1.5748 * (cr - 128) / 255, 0), 1) AS r, least(greatest(v / 255 - 0.1873242729 * (cb - 128) / 255 - 0.4681242729 * (cr - 128) / 255, 0), 1) AS g,
  least(greatest(v / 255 + 1.8556 * (cb - 128) / 255, 0), 1) AS b FROM taps),
lin AS (SELECT y, x, CASE WHEN r <= 0.04045 THEN r / 12.92 ELSE pow((r + 0.055) / 1.055, 2.4) END AS r, CASE WHEN g <= 0.04045 THEN g / 12.92 ELSE pow((g + 0.055) / 1.055, 2.4) END AS g,
  CASE WHEN b <= 0.04045 THEN b / 12.92 ELSE pow((b + 0.055) / 1.055, 2.4) END AS b FROM rgb),
lms AS (SELECT y, x, cbrt(0.30 * r + 0.622 * g + 0.078 * b + 0.0037930732552754493) - cbrt(0.0037930732552754493) AS l, cbrt(0.23 * r + 0.692 * g + 0.078 * b + 0.0037930732552754493) - cbrt(0.0037930732552754493) AS m,
  cbrt(0.24342268924547819 * r + 0.20476744424496821 * g + (1 - 0.24342268924547819 - 0.20476744424496821) * b + 0.0037930732552754493) - cbrt(0.0037930732552754493) AS s FROM lin),
xyb AS (SELECT y, x, (l - m) / 2 AS cx, (l + m) / 2 AS cy, s AS cb FROM lms)"""
)


@query("WITH" + XYB_SQL + " SELECT y, x, round(cb, 6) AS cb, round(cr, 6) AS cr FROM taps")
def plane_chroma_upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bilinear doubling of chroma: three quarters of the own cell, one quarter of the nearer neighbour, in both directions."""
    rows = fixtures.chroma_rows(spark, sf_dir)
    last = fixtures.plane_height(spark, sf_dir) // 2 - 1
    wide = rows.select("cy", *[_doubled(c).alias(c) for c in ("cb", "cr")])
    # each chroma line gives parts of four luma lines: its own two and the outer line of each neighbour
    y = F.col("cy") * 2
    parts = F.array(
        F.struct(y.alias("y"), F.lit(0.75).alias("w")), F.struct((y + 1).alias("y"), F.lit(0.75).alias("w")),
        F.struct((y - 1).alias("y"), F.lit(0.25).alias("w")), F.struct((y + 2).alias("y"), F.lit(0.25).alias("w")),
        F.struct(F.when(F.col("cy") == 0, 0).otherwise(-1).alias("y"), F.lit(0.25).alias("w")),
        F.struct(F.when(F.col("cy") == last, 2 * last + 1).otherwise(-1).alias("y"), F.lit(0.25).alias("w")),
    )
    cells = wide.withColumn("p", F.explode(parts))
    cells = cells.where((F.col("p.y") >= 0) & (F.col("p.y") <= 2 * last + 1)).select("p", F.posexplode(F.arrays_zip("cb", "cr")).alias("x", "v"))
    return cells.groupBy(F.col("p.y").alias("y"), "x").agg(F.round(F.sum(F.col("p.w") * F.col("v.cb")), 6).alias("cb"), F.round(F.sum(F.col("p.w") * F.col("v.cr")), 6).alias("cr"))


def _doubled(name: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda x: _near(F.col(name), x))


def _near(line: Column, x: Column) -> Column:
    own = F.floor(x / 2).cast("int")
    other = F.least(F.greatest(own + F.when(x % 2 == 0, -1).otherwise(1), F.lit(0)), F.size(line) - 1)
    return 0.75 * F.get(line, own) + 0.25 * F.get(line, other)


@query("WITH" + fixtures.PLANE_SQL + " SELECT y // 2 AS y, x // 2 AS x, CAST(round_even(avg(v), 0) AS INTEGER) AS v FROM plane GROUP BY ALL")
def box_downscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of 2x2 boxes, rounded half to even."""
    lines = fixtures.scanlines(spark, sf_dir).select(F.floor(F.col("y") / 2).alias("y"), F.posexplode("luma").alias("i", "v"))
    return lines.groupBy("y", F.floor(F.col("i") / 2).alias("x")).agg(F.rint(F.avg("v")).cast("int").alias("v"))


#: BT.709 full range, Kr = 0.2126 and Kb = 0.0722. Fixed values.
KR, KB = 0.2126, 0.0722
KG = 1 - KR - KB


def luma_of(r: Column, g: Column, b: Column) -> Column:
    return F.least(F.greatest(F.rint(F.round(KR * r + KG * g + KB * b, 9)), F.lit(0.0)), F.lit(255.0)).cast("int")


def chroma_of(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Cb and Cr around 128, not rounded."""
    y = KR * r + KG * g + KB * b
    return (b - y) / (2 * (1 - KB)) + 128, (r - y) / (2 * (1 - KR)) + 128


_RGB = """rgb AS (SELECT y, x, v AS r, 255 - v AS g, (3 * v) % 256 AS b FROM plane),
ycc AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS luma FROM rgb)"""


@query(
    "WITH" + fixtures.PLANE_SQL + "," + _RGB + """ SELECT y // 2 AS cy, x // 2 AS cx, sum(least(greatest(round_even(round(luma, 9), 0), 0), 255))::INTEGER AS luma_sum,
    least(greatest(round_even(round(avg((b - luma) / 1.8556 + 128), 9), 0), 0), 255)::INTEGER AS cb, least(greatest(round_even(round(avg((r - luma) / 1.5748 + 128), 9), 0), 0), 255)::INTEGER AS cr FROM ycc GROUP BY ALL"""
)
def rgb_to_ycbcr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An RGB plane as luma (summed over 2x2 here) and chroma means at half resolution."""
    px = fixtures.scanlines(spark, sf_dir).select("y", F.posexplode("luma").alias("x", "v"))
    r, g, b = F.col("v").cast("double"), (255 - F.col("v")).cast("double"), ((3 * F.col("v")) % 256).cast("double")
    cb, cr = chroma_of(r, g, b)
    clip = lambda v: F.least(F.greatest(F.rint(F.round(v, 9)), F.lit(0.0)), F.lit(255.0)).cast("int")
    return px.groupBy(F.floor(F.col("y") / 2).alias("cy"), F.floor(F.col("x") / 2).alias("cx")).agg(
        F.sum(luma_of(r, g, b)).cast("int").alias("luma_sum"), clip(F.avg(cb)).alias("cb"), clip(F.avg(cr)).alias("cr")
    )


# Configuration --------------------------------------------------------------------------------------------------------

_CONFIGS = """
configs AS (SELECT p_partkey AS id, CAST((p_partkey * 8 + CASE WHEN p_size % 7 = 0 THEN 4 ELSE 0 END) % 4096 AS BIGINT) AS width, CAST((p_partkey * 24) % 2304 AS BIGINT) AS height,
  CASE WHEN p_size % 11 = 0 THEN 0 ELSE p_size / 10e0 END AS distance, p_size AS capability FROM part),
grids AS (SELECT *, width // 8 AS bw, height // 8 AS bh, ((width // 8 + 31) // 32) * ((height // 8 + 31) // 32) AS ac_groups, ((width // 8 + 255) // 256) * ((height // 8 + 255) // 256) AS dc_groups FROM configs)"""


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part table read as encoder configurations, with their grids."""
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 8 + F.when(F.col("p_size") % 7 == 0, 4).otherwise(0)) % 4096).alias("width"), ((F.col("p_partkey") * 24) % 2304).alias("height"),
        F.when(F.col("p_size") % 11 == 0, 0.0).otherwise(F.col("p_size") / 10).alias("distance"), F.col("p_size").alias("capability"),
    )
    bw, bh = F.floor(F.col("width") / 8), F.floor(F.col("height") / 8)
    groups = lambda size: F.floor((bw + size - 1) / size) * F.floor((bh + size - 1) / size)
    return rows.withColumns({"bw": bw, "bh": bh, "ac_groups": groups(32), "dc_groups": groups(256)})


@query(
    "WITH" + _CONFIGS + """ SELECT id, CASE WHEN NOT (distance > 0) THEN 'invalid-argument' WHEN width = 0 OR height = 0 OR width % 8 <> 0 OR height % 8 <> 0 OR ac_groups <= 1 THEN 'unsupported-resolution' ELSE 'ok' END AS status FROM grids"""
)
def validate_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments first, then geometry."""
    d, w, h = F.col("distance"), F.col("width"), F.col("height")
    bad = ~(d > 0) | F.isnan(d) | (d == float("inf"))
    status = F.when(bad, "invalid-argument").when((w == 0) | (h == 0) | (w % 8 != 0) | (h % 8 != 0) | (F.col("ac_groups") <= 1), "unsupported-resolution").otherwise("ok")
    return configs(spark, sf_dir).select("id", status.alias("status"))


@query("WITH" + _CONFIGS + " SELECT id, 3 * bw * bh * 384 + 48 * bw * bh + (ac_groups + dc_groups) * 2048 + 16384 AS bytes FROM grids")
def max_output_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most bytes that a frame can take."""
    n = F.col("bw") * F.col("bh")
    return configs(spark, sf_dir).select("id", (n * (3 * 384 + 48) + (F.col("ac_groups") + F.col("dc_groups")) * 2048 + 16384).alias("bytes"))


@query("WITH" + _CONFIGS + " SELECT id, CASE WHEN capability + 40 >= 80 THEN 'fp16-tensor' WHEN capability + 40 >= 60 THEN 'fp32-simt' ELSE 'unknown' END AS backend FROM grids")
def backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backend by device capability (ten times major plus minor)."""
    c = F.col("capability") + 40
    return configs(spark, sf_dir).select("id", F.when(c >= 80, "fp16-tensor").when(c >= 60, "fp32-simt").otherwise("unknown").alias("backend"))
