"""Whole frames: colour, sharpening, adaptive quantisation, transform selection, colour factors, quantisation, coding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures, tables
from ..functions.symbols import hybrid, pack_signed
from ..operators import strips, tokens
from ..operators.windows import exclusive_scan
from ..params import calibrate, field_params
from ..registry import query
from .codec import CAL, DISTANCE, XYB_SQL, dc_residuals
from .entropy import _FREQ, _NZC, _PACK, _cluster_sql, _symbol, codes, pack_groups

_TOTAL = 1 + 4 * (strips.SHARPEN["r"] + strips.SHARPEN["d"] + strips.SHARPEN["R"] + strips.SHARPEN["D"] + 2 * strips.SHARPEN["L"])
_S = strips.SHARPEN
SHARP_SQL = (
    XYB_SQL
    + f""",
offsets AS (SELECT dy, dx, (CASE greatest(abs(dy), abs(dx)) * 10 + least(abs(dy), abs(dx)) WHEN 0 THEN 1.0 WHEN 10 THEN {_S['r']!r} WHEN 11 THEN {_S['d']!r} WHEN 20 THEN {_S['R']!r} WHEN 21 THEN {_S['L']!r} ELSE {_S['D']!r} END) / {_TOTAL!r} AS w
  FROM range(-2, 3) a(dy), range(-2, 3) b(dx)),
sharp AS (SELECT p.y, p.x, sum(o.w * q.cx) AS cx, sum(o.w * q.cy) AS cy, sum(o.w * q.cb) AS cb FROM plane p CROSS JOIN offsets o
  JOIN xyb q ON q.y = least(greatest(p.y + o.dy, 0), (SELECT h - 1 FROM plane_size)) AND q.x = least(greatest(p.x + o.dx, 0), 63) GROUP BY p.y, p.x)"""
)


def _ratio_sql(v: str, invert: bool) -> str:
    num = f"({strips.GAMMA_MUL2 * 18.6580932135 * strips.LOG2 * 3 * strips.GAMMA_MUL!r} * pow(greatest({v}, 0), 2) + 0.01)"
    den = f"({strips.LOG2 * strips.GAMMA_MUL!r} * pow(greatest({v}, 0), 3) + {strips.GAMMA_OFFSET * strips.LOG2 + 1e-2!r})"
    return f"{num} / {den}" if invert else f"{den} / {num}"


_FP = field_params(DISTANCE)
PRE_SQL = (
    XYB_SQL
    + f""",
reach AS (SELECT h, 32 * ((h + 31) // 32) AS tall FROM plane_size),
grid AS (SELECT gy, gx, h FROM reach, range((SELECT tall FROM reach)) a(gy), range(64) b(gx)),
cross_ AS (SELECT g.gy, g.gx, max(CASE WHEN o.dy = 0 AND o.dx = 0 THEN q.cy END) AS own, sum(CASE WHEN o.dy = 0 AND o.dx = 0 THEN 0 ELSE q.cy END) / 4 AS base
  FROM grid g CROSS JOIN (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(dy, dx) JOIN xyb q ON q.y = least(greatest(g.gy + o.dy, 0), g.h - 1) AND q.x = least(greatest(g.gx + o.dx, 0), 63) GROUP BY g.gy, g.gx),
diffs AS (SELECT gy, gx, least(pow({_ratio_sql('own + 0.019', False)} * (own - base), 2), 0.2) AS d FROM cross_),
pre AS (SELECT gy // 4 AS r, gx // 4 AS c, sum(0.25 * sqrt(d * {strips.SQRT_MUL ** 0.5!r} + {strips.SQRT_OFFSET!r})) / 4 AS v FROM diffs GROUP BY ALL),
near AS (SELECT a.r, a.c, b.v, row_number() OVER (PARTITION BY a.r, a.c ORDER BY b.v) AS i FROM pre a CROSS JOIN (SELECT dy, dx FROM range(-1, 2) s(dy), range(-1, 2) t(dx)) o
  JOIN pre b ON b.r = least(greatest(a.r + o.dy, a.r // 8 * 8), a.r // 8 * 8 + 7) AND b.c = least(greatest(a.c + o.dx, a.c // 8 * 8), a.c // 8 * 8 + 7)),
eroded AS (SELECT r, c, sum(v * CASE i WHEN 1 THEN {_FP.erosion[0]!r} WHEN 2 THEN {_FP.erosion[1]!r} WHEN 3 THEN {_FP.erosion[2]!r} ELSE {_FP.erosion[3]!r} END) AS v FROM near WHERE i <= 4 GROUP BY r, c)"""
)
_LIMIT = 0.027121074570634722
FIELD_SQL = (
    PRE_SQL
    + f""",
steps AS (SELECT y, x, cx, cy, cb, lead(cy) OVER (PARTITION BY y, x // 8 ORDER BY x) AS e, lead(cy) OVER (PARTITION BY x, y // 8 ORDER BY y) AS s FROM xyb),
sums AS (SELECT y // 8 AS by_, x // 8 AS bx, sum(CASE WHEN e IS NULL THEN 0 ELSE least(0.0206, abs(cy - e)) END + CASE WHEN s IS NULL THEN 0 ELSE least(0.0206, abs(cy - s)) END) AS hf,
  sum({_ratio_sql('(cy + 0.16 - cx)', True)} + {_ratio_sql('(cy + 0.16 + cx)', True)}) * 0.5 / 64 AS gamma,
  sum(CASE WHEN cb > cy + 0.084381641171960495 + abs(cx) THEN least(cb - (cy + 0.084381641171960495 + abs(cx)), {_LIMIT!r}) ELSE 0 END) AS blue FROM steps GROUP BY ALL),
aq AS (SELECT r // 2 AS by_, c // 2 AS bx, sum(v) AS aq FROM eroded GROUP BY ALL),
mixed AS (SELECT by_, bx, hf, gamma, least(CASE WHEN blue >= {32 * _LIMIT!r} THEN {64 * _LIMIT!r} - blue ELSE blue END, {15.398788439047934 * _LIMIT!r}) AS blue, greatest(aq * 0.80061762862741759, 0.001) AS v1 FROM sums JOIN aq USING (by_, bx)),
field AS (SELECT by_, bx, CAST(least(greatest(floor((exp(-0.7647 + 9.4708735624378946 / (v1 * v1 + {0.25 * 3.7179635626140772!r}) + 17.35036561631863 / (v1 + 302.59587815579727) + 6.7943250517376494 / (v1 * v1 + 3.7179635626140772)
  - 0.38 * hf + 0.42 + 0.1005613337192697 * log2(gamma) + 0.14207000358439159 * blue) * {_FP.mul!r} + {_FP.add!r}) * {CAL.inverse_scale!r} + 0.5), 1), 256) AS INTEGER) AS q FROM mixed)"""
)
_WEIGHTS = ", ".join(f"({i}, {float(w)!r})" for i, w in enumerate(tables.dequant(8, 1)))
SELECT_SQL = (
    SHARP_SQL
    + f""",
sides(n) AS (VALUES (8), (16), (32)),
basis AS (SELECT n, k, t, CASE WHEN k = 0 THEN 1.0 / n ELSE sqrt(2) / n * cos(pi() * (t + 0.5) * k / n) END AS w FROM sides, range(32) a(k), range(32) b(t) WHERE k < n AND t < n),
weights(raw, w) AS (VALUES {_WEIGHTS}),
rows_ AS (SELECT b.n, s.y // b.n AS r, s.x // b.n AS c, s.y % b.n AS dy, b.k AS fx, sum(s.cy * b.w) AS v FROM sharp s JOIN sides d ON (s.y // d.n + 1) * d.n <= (SELECT h FROM plane_size) JOIN basis b ON b.n = d.n AND b.t = s.x % d.n GROUP BY ALL),
cells AS (SELECT a.n, a.r, a.c, a.fx, b.k AS fy, sum(a.v * b.w) AS v FROM rows_ a JOIN basis b ON b.n = a.n AND b.t = a.dy GROUP BY ALL),
steps_ AS (SELECT e.*, w.w, round_even(v * {CAL.uniform!r} / w.w, 0) AS q FROM cells e JOIN weights w ON w.raw = least(7, floor(fx * 8 / n + 0.5)) * 8 + least(7, floor(fy * 8 / n + 0.5)) WHERE fx >= n // 8 OR fy >= n // 8),
costs AS (SELECT n AS side, r * n // 8 AS by_, c * n // 8 AS bx, n * n * sum(pow(q * w / {CAL.uniform!r} - v, 2)) + 0.0006 * sum(CASE WHEN q <> 0 THEN 1 + log2(1 + abs(q)) ELSE 0 END) AS cost FROM steps_ GROUP BY n, r, c),
quads AS (SELECT by_ // 2 AS qy, bx // 2 AS qx, sum(cost) AS small FROM costs WHERE side = 8 GROUP BY ALL),
halves AS (SELECT q.qy, q.qx, coalesce(c.cost <= q.small + 1e-6, false) AS sixteen, CASE WHEN c.cost <= q.small + 1e-6 THEN c.cost ELSE q.small END AS best FROM quads q LEFT JOIN costs c ON c.side = 16 AND c.by_ = 2 * q.qy AND c.bx = 2 * q.qx),
regions AS (SELECT qy // 2 AS ry, qx // 2 AS rx, sum(best) AS total FROM halves GROUP BY ALL),
picked AS (SELECT r.ry, r.rx, coalesce(c.cost <= r.total + 1e-6, false) AS whole FROM regions r LEFT JOIN costs c ON c.side = 32 AND c.by_ = 4 * r.ry AND c.bx = 4 * r.rx),
choices AS (SELECT c.side, c.by_, c.bx, c.cost, CASE c.side WHEN 32 THEN p.whole WHEN 16 THEN NOT p.whole AND h.sixteen ELSE NOT p.whole AND NOT h.sixteen END AS chosen
  FROM costs c JOIN picked p ON p.ry = c.by_ // 4 AND p.rx = c.bx // 4 JOIN halves h ON h.qy = c.by_ // 2 AND h.qx = c.bx // 2)"""
)


_ALL_WEIGHTS = ", ".join(f"({n}, {c}, {i}, {float(w)!r})" for n in tables.SIDES for c in range(3) for i, w in enumerate(tables.dequant(n, c)))
_RESAMPLED = ", ".join(f"({m}, {k}, {w!r})" for m, scale in tables.RESAMPLE.items() for k, w in enumerate(scale))
_STEPS = [inverse * CAL.dc_scale for inverse in tables.DC_INVERSE]
_EVEN = "CAST(round_even(round({0}, 9), 0) AS INTEGER)"
_FACTOR = "CAST(least(greatest(round_even(round(CASE WHEN yy > 0 THEN {0} / yy ELSE 0 END * " + str(tables.COLOR_FACTOR) + ", 9), 0), -128), 127) AS INTEGER)"
BLOCKS_SQL = (
    SELECT_SQL
    + FIELD_SQL[len(XYB_SQL) :]
    + f""",
firsts AS (SELECT side AS n, by_, bx, by_ * 8 // side AS r, bx * 8 // side AS c FROM choices WHERE chosen),
channels(ch) AS (VALUES (0), (1), (2)),
planes3 AS (SELECT y, x, ch, CASE ch WHEN 0 THEN cx WHEN 1 THEN cy ELSE cb END AS v FROM sharp CROSS JOIN channels),
wide_rows AS (SELECT d.n, s.y // d.n AS r, s.x // d.n AS c, s.ch, s.y % d.n AS dy, b.k AS fx, sum(s.v * b.w) AS v FROM planes3 s JOIN sides d ON (s.y // d.n + 1) * d.n <= (SELECT h FROM plane_size) JOIN basis b ON b.n = d.n AND b.t = s.x % d.n GROUP BY ALL),
squares AS (SELECT a.n, a.r, a.c, a.ch, a.fx, b.k AS fy, sum(a.v * b.w) AS v FROM wide_rows a JOIN basis b ON b.n = a.n AND b.t = a.dy GROUP BY ALL),
coefficients AS (SELECT f.n, f.by_, f.bx, s.ch, s.fx, s.fy, s.v FROM squares s JOIN firsts f ON f.n = s.n AND f.r = s.r AND f.c = s.c),
matched AS (SELECT n, by_, bx, fx, fy, max(CASE WHEN ch = 0 THEN v END) AS x, max(CASE WHEN ch = 1 THEN v END) AS y, max(CASE WHEN ch = 2 THEN v END) AS b FROM coefficients GROUP BY ALL),
tile_sums AS (SELECT by_ // 8 AS ty, bx // 8 AS tx, sum(x * y) AS xy, sum(y * y) AS yy, sum((b - {tables.BASE_B!r} * y) * y) AS dy FROM matched WHERE fx >= n // 8 OR fy >= n // 8 GROUP BY ALL),
tiles AS (SELECT ty, tx, {_FACTOR.format("xy")} AS ytox, {_FACTOR.format("dy")} AS ytob FROM tile_sums),
all_weights(n, ch, raw, w) AS (VALUES {_ALL_WEIGHTS}),
luma_q AS (SELECT m.*, t.ytox, t.ytob, q.q AS qf, q.q * {CAL.scale!r} AS strength, w.w AS wy, round_even(round(m.y * (q.q * {CAL.scale!r}) / w.w, 9), 0) AS qy FROM matched m JOIN tiles t ON t.ty = m.by_ // 8 AND t.tx = m.bx // 8
  JOIN field q ON q.by_ = m.by_ AND q.bx = m.bx JOIN all_weights w ON w.n = m.n AND w.ch = 1 AND w.raw = m.fx * m.n + m.fy WHERE m.fx >= m.n // 8 OR m.fy >= m.n // 8),
ac_q AS (SELECT l.n, l.by_, l.bx, l.qf, l.fx, l.fy, CAST(qy AS BIGINT) AS qy, {_EVEN.format(f"(x - ytox / {tables.COLOR_FACTOR} * (qy * wy / strength)) * strength / a.w")} AS qx,
  {_EVEN.format(f"(b - ({tables.BASE_B!r} + ytob / {tables.COLOR_FACTOR}) * (qy * wy / strength)) * strength / c.w")} AS qb
  FROM luma_q l JOIN all_weights a ON a.n = l.n AND a.ch = 0 AND a.raw = l.fx * l.n + l.fy JOIN all_weights c ON c.n = l.n AND c.ch = 2 AND c.raw = l.fx * l.n + l.fy),
ac_counts AS (SELECT n AS side, by_, bx, qf, ch AS c, count(*) FILTER (WHERE q <> 0) AS nz, CAST(sum(abs(q)) AS BIGINT) AS size
  FROM (SELECT n, by_, bx, qf, ch, CASE ch WHEN 0 THEN qx WHEN 1 THEN qy ELSE qb END AS q FROM ac_q CROSS JOIN channels) GROUP BY ALL),
resampled(m, k, w) AS (VALUES {_RESAMPLED}),
corner AS (SELECT n // 8 AS m, by_, bx, ch, fx, fy, v FROM coefficients WHERE fx < n // 8 AND fy < n // 8),
dc_terms AS (SELECT c.m, c.by_, c.bx, c.ch, r.r AS dy, o.o AS dx,
    c.m * c.v * a.w * b.w * sqrt(CASE WHEN c.fx = 0 THEN 1 ELSE 2 END / c.m) * cos(pi() * (o.o + 0.5) * c.fx / c.m) * sqrt(CASE WHEN c.fy = 0 THEN 1 ELSE 2 END / c.m) * cos(pi() * (r.r + 0.5) * c.fy / c.m) AS v
  FROM corner c JOIN resampled a ON a.m = c.m AND a.k = c.fx JOIN resampled b ON b.m = c.m AND b.k = c.fy JOIN range(4) r(r) ON r.r < c.m JOIN range(4) o(o) ON o.o < c.m),
dc_values AS (SELECT m, by_, bx, ch, dy, dx, sum(v) AS v FROM dc_terms GROUP BY m, by_, bx, ch, dy, dx),
dc_wide AS (SELECT m, by_, bx, dy, dx, max(CASE WHEN ch = 0 THEN v END) AS x, {_EVEN.format(f"max(CASE WHEN ch = 1 THEN v END) * {_STEPS[1]!r}")} AS qy, max(CASE WHEN ch = 2 THEN v END) AS b FROM dc_values GROUP BY m, by_, bx, dy, dx),
dc_q AS (SELECT m, by_, bx, dy, dx, ch, CASE ch WHEN 0 THEN {_EVEN.format(f"x * {_STEPS[0]!r}")} WHEN 1 THEN qy ELSE {_EVEN.format(f"(b - {tables.BASE_B!r} * qy / {_STEPS[1]!r}) * {_STEPS[2]!r}")} END AS v FROM dc_wide CROSS JOIN channels),
dc_lists AS (SELECT by_, bx, ch AS c, string_agg(CAST(v AS VARCHAR), ',' ORDER BY dy, dx) AS dc FROM dc_q GROUP BY ALL)"""
)
_SIGNED = "CASE WHEN {0} >= 0 THEN 2 * {0} ELSE -2 * {0} - 1 END"
_SYMBOL = "CAST(CASE WHEN p < 16 THEN p ELSE 16 + 4 * (CAST(floor(log2(p)) AS BIGINT) - 4) + (p // CAST(pow(2, CAST(floor(log2(p)) AS BIGINT) - 2) AS BIGINT)) % 4 END AS INTEGER)"


def frame(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fixtures.scanlines(spark, sf_dir), fixtures.chroma_rows(spark, sf_dir)


@query("WITH" + XYB_SQL + " SELECT y, x, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cb, 6) AS cb FROM xyb")
def plane_xyb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = strips.plane_rows(*frame(spark, sf_dir), "plain")
    return rows.select("y", "x", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "cb")])


@query("WITH" + SHARP_SQL + " SELECT y, x, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cb, 6) AS cb FROM sharp")
def plane_gaborish(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = strips.plane_rows(*frame(spark, sf_dir), "sharp")
    return rows.select("y", "x", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "cb")])


@query("WITH" + PRE_SQL + " SELECT r AS row, c AS col, round(v, 5) AS value FROM pre")
def aq_pre_erosion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strips.cell_rows(*frame(spark, sf_dir), "pre").select("row", "col", F.round("value", 5).alias("value"))


@query("WITH" + PRE_SQL + " SELECT r AS row, c AS col, round(v, 5) AS value FROM eroded")
def aq_erosion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strips.cell_rows(*frame(spark, sf_dir), "eroded").select("row", "col", F.round("value", 5).alias("value"))


@query("WITH" + FIELD_SQL + " SELECT by_, bx, q FROM field")
def aq_quant_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strips.cell_rows(*frame(spark, sf_dir), "field").select(F.col("row").alias("by_"), F.col("col").alias("bx"), F.col("value").cast("int").alias("q"))


@query("WITH" + SELECT_SQL + " SELECT side, by_, bx, round(cost, 6) AS cost, chosen FROM choices")
def transform_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strips.cost_rows(*frame(spark, sf_dir)).select("side", F.col("by").alias("by_"), "bx", F.round("cost", 6).alias("cost"), "chosen")


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strips.frame_blocks(*frame(spark, sf_dir), DISTANCE)


@query("WITH" + SELECT_SQL + " SELECT by_, bx, side FROM choices WHERE chosen")
def transform_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_of(spark, sf_dir).select(F.col("by").alias("by_"), "bx", "side")


@query("WITH" + SELECT_SQL + " SELECT side, count(*) AS n FROM choices WHERE chosen GROUP BY side")
def side_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_of(spark, sf_dir).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("WITH" + SELECT_SQL + " SELECT by_ // 256 AS gy, bx // 256 AS gx, count(*) AS n, CAST(sum(side * side // 64) AS BIGINT) AS covered FROM choices WHERE chosen GROUP BY ALL")
def first_block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First blocks of each DC group, and the 8x8 positions that they cover."""
    rows = blocks_of(spark, sf_dir)
    return rows.groupBy(F.floor(F.col("by") / 256).alias("gy"), F.floor(F.col("bx") / 256).alias("gx")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("side") * F.col("side") / 64)).alias("covered"))


@query("WITH" + BLOCKS_SQL + " SELECT 'frame' AS image, ty, tx, ytox, ytob FROM tiles")
def cfl_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour factors of tiles of 8x8 blocks."""
    rows = blocks_of(spark, sf_dir)
    return rows.select("image", F.floor(F.col("by") / 8).alias("ty"), F.floor(F.col("bx") / 8).alias("tx"), "ytox", "ytob").distinct()


@query("WITH" + BLOCKS_SQL + " SELECT by_ AS by, bx, side, qf, c, nz, size, dc FROM ac_counts JOIN dc_lists USING (by_, bx, c)")
def quantize_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-zero coefficients of each first block and channel, with the sum of their sizes, and its DC values."""
    rows = blocks_of(spark, sf_dir).select("by", "bx", "side", "qf", F.posexplode(F.arrays_zip("q", "dc")).alias("c", "v"))
    return rows.select(
        "by", "bx", "side", "qf", "c", F.size(F.filter("v.q", lambda x: x != 0)).alias("nz"), F.aggregate("v.q", F.lit(0).cast("long"), lambda a, x: a + F.abs(x)).alias("size"),
        F.concat_ws(",", F.transform("v.dc", lambda x: x.cast("string"))).alias("dc"),
    )


def channel_blocks(rows: DataFrame) -> DataFrame:
    """First blocks with one row per channel, for the tokeniser."""
    return rows.select("image", "by", "bx", "side", F.posexplode("q").alias("c", "scanned"))


def dc_positions(rows: DataFrame) -> DataFrame:
    """DC values at every covered position: image, gy, gx, c, by_, bx, v."""
    wide = rows.select("image", "by", "bx", F.floor(F.col("side") / 8).cast("int").alias("m"), F.posexplode("dc").alias("c", "values"))
    cells = wide.select("image", "by", "bx", "m", "c", F.posexplode("values").alias("i", "v"))
    return cells.select(
        "image", "c", (F.col("by") + F.floor(F.col("i") / F.col("m"))).cast("int").alias("by_"), (F.col("bx") + F.col("i") % F.col("m")).cast("int").alias("bx"), "v"
    ).withColumns({"gy": F.floor(F.col("by_") / 256), "gx": F.floor(F.col("bx") / 256)})


@query(
    "WITH" + BLOCKS_SQL + f""",
    placed AS (SELECT ch, by_ + dy AS y, bx + dx AS x, (by_ + dy) // 256 AS gy, (bx + dx) // 256 AS gx, v FROM dc_q),
    around AS (SELECT *, lag(v) OVER (PARTITION BY ch, gy, gx, y ORDER BY x) AS w, lag(v) OVER (PARTITION BY ch, gy, gx, x ORDER BY y) AS n FROM placed),
    corners AS (SELECT *, lag(n) OVER (PARTITION BY ch, gy, gx, y ORDER BY x) AS nw FROM around),
    guesses AS (SELECT gy, gx, v, coalesce(w, n, 0) AS l, coalesce(n, w, 0) AS t, CASE WHEN w IS NOT NULL AND n IS NOT NULL THEN nw ELSE coalesce(w, n, 0) END AS c FROM corners),
    rests AS (SELECT gy, gx, v - CASE WHEN c < least(l, t) THEN greatest(l, t) WHEN c > greatest(l, t) THEN least(l, t) ELSE l + t - c END AS d FROM guesses)
    SELECT gy, gx, {_SYMBOL} AS symbol, count(*) AS n FROM (SELECT gy, gx, {_SIGNED.format("d")} AS p FROM rests) GROUP BY ALL"""
)
def frame_dc_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual symbols of the DC values by DC group, channels pooled."""
    cells = dc_residuals(dc_positions(blocks_of(spark, sf_dir)), ["image", "gy", "gx", "c"])
    return cells.groupBy("gy", "gx", hybrid(pack_signed(F.col("residual")))["symbol"].alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH" + BLOCKS_SQL + f""",
    samples AS (SELECT f.by_ // 256 AS gy, f.bx // 256 AS gx, unnest([CASE n WHEN 16 THEN 4 WHEN 32 THEN 5 ELSE 0 END, q.q - 1]) AS v, 1 AS k FROM firsts f JOIN field q USING (by_, bx)
      UNION ALL SELECT ty // 32, tx // 32, unnest([ytox, ytob]), 1 FROM tiles UNION ALL SELECT by_ // 256, bx // 256, 0, n * n // 64 FROM firsts)
    SELECT gy, gx, {_SYMBOL} AS symbol, CAST(sum(k) AS BIGINT) AS n FROM (SELECT gy, gx, {_SIGNED.format("v")} AS p, k FROM samples) GROUP BY ALL"""
)
def acmeta_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of block kinds, field values, colour factors and a zero per position, by DC group."""
    rows = blocks_of(spark, sf_dir).withColumns({"gy": F.floor(F.col("by") / 256), "gx": F.floor(F.col("bx") / 256)})
    kind = F.when(F.col("side") == 16, 4).when(F.col("side") == 32, 5).otherwise(0)
    own = rows.select("gy", "gx", F.explode(F.array(kind, F.col("qf") - 1)).alias("v"), F.lit(1).alias("w"))
    tiles = rows.select("gy", "gx", F.floor(F.col("by") / 8).alias("ty"), F.floor(F.col("bx") / 8).alias("tx"), "ytox", "ytob").distinct()
    zeros = rows.select("gy", "gx", F.lit(0).alias("v"), F.floor(F.col("side") * F.col("side") / 64).cast("int").alias("w"))
    every = own.unionByName(tiles.select("gy", "gx", F.explode(F.array("ytox", "ytob")).alias("v"), F.lit(1).alias("w"))).unionByName(zeros)
    return every.groupBy("gy", "gx", hybrid(pack_signed(F.col("v")))["symbol"].alias("symbol")).agg(F.sum("w").alias("n"))


_ORDERS = ", ".join(f"({n}, {k}, {i})" for n in tables.SIDES for k, i in enumerate(tables.scan_order(n).tolist()))
_CONTEXTS = ", ".join(f"({n}, {c}, {tables.block_context(c, n)}, {2 * (n // 8 - 1).bit_length()})" for n in tables.SIDES for c in range(3))


@query(
    "WITH" + BLOCKS_SQL + f""",
    orders(n, k, raw) AS (VALUES {_ORDERS}), contexts(n, ch, ctx, l2) AS (VALUES {_CONTEXTS}),
    scans AS (SELECT a.n, a.by_, a.bx, ch, o.k, CASE ch WHEN 0 THEN qx WHEN 1 THEN qy ELSE qb END AS q FROM ac_q a JOIN orders o ON o.n = a.n AND o.raw = a.fx * a.n + a.fy CROSS JOIN channels),
    totals AS (SELECT n, by_, bx, ch, CAST(count(*) FILTER (WHERE q <> 0) AS INTEGER) AS nz FROM scans GROUP BY n, by_, bx, ch),
    spread AS (SELECT t.by_ + a.dy AS y, t.bx + b.dx AS x, t.ch, (t.nz + (1 << l2) - 1) >> l2 AS norm, a.dy = 0 AND b.dx = 0 AS first
      FROM totals t JOIN contexts c ON c.n = t.n AND c.ch = t.ch JOIN range(4) a(dy) ON a.dy < t.n // 8 JOIN range(4) b(dx) ON b.dx < t.n // 8),
    beside AS (SELECT *, lag(norm) OVER (PARTITION BY ch, y, x // 32 ORDER BY x) AS l, lag(norm) OVER (PARTITION BY ch, x, y // 32 ORDER BY y) AS t FROM spread),
    guessed AS (SELECT y AS by_, x AS bx, ch, least(CAST(coalesce((t + l + 1) // 2, t, l, 32) AS INTEGER), 64) AS p FROM beside WHERE first),
    run AS (SELECT s.n, s.by_, s.bx, s.ch, s.k, s.q, t.nz, t.nz - coalesce(count(*) FILTER (WHERE s.q <> 0) OVER (PARTITION BY s.by_, s.bx, s.ch ORDER BY s.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
      coalesce(lag(CASE WHEN s.q <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY s.by_, s.bx, s.ch ORDER BY s.k), CASE WHEN t.nz > s.n * s.n / 16 THEN 0 ELSE 1 END) AS prev
      FROM scans s JOIN totals t ON t.by_ = s.by_ AND t.bx = s.bx AND t.ch = s.ch),
    coded AS (SELECT (CASE WHEN p < 8 THEN p ELSE 4 + p // 2 END) * 15 + c.ctx AS context, t.nz AS n FROM totals t JOIN guessed g ON g.by_ = t.by_ AND g.bx = t.bx AND g.ch = t.ch JOIN contexts c ON c.n = t.n AND c.ch = t.ch
      UNION ALL SELECT 555 + 458 * c.ctx + ({_NZC}[((rest + (1 << l2) - 1) >> l2) + 1] + {_FREQ}[(k >> l2) + 1]) * 2 + prev, {_PACK.format(v="q")} FROM run r JOIN contexts c ON c.n = r.n AND c.ch = r.ch WHERE rest > 0)
    SELECT CAST({_cluster_sql("context")} AS INTEGER) AS cluster, CAST({_symbol("n")} AS INTEGER) AS symbol, count(*) AS n FROM (SELECT CAST(context AS BIGINT) AS context, CAST(n AS BIGINT) AS n FROM coded) GROUP BY 1, 2"""
)
def frame_ac_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenize(channel_blocks(blocks_of(spark, sf_dir))).groupBy("cluster", "symbol").agg(F.count(F.lit(1)).alias("n"))


@query()
def codestream_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The AC groups of a frame, packed: sizes, starts and hashes."""
    coded = tokens.tokenize(channel_blocks(blocks_of(spark, sf_dir)))
    packed = pack_groups(coded, codes(coded.groupBy("cluster", "symbol").agg(F.count(F.lit(1)).alias("n")))).withColumn("size", F.length("data"))
    return packed.select("image", "gy", "gx", "n_tokens", "n_bits", "size", exclusive_scan("size", ["image"], ["gy", "gx"]).alias("start"), F.sha2("data", 256).alias("sha256"))


@query(
    """WITH asked(distance) AS (VALUES (0.5::DOUBLE), (1), (1.5), (2), (3), (4)),
    a AS (SELECT distance, distance::FLOAT AS d, (0.725::FLOAT / distance::FLOAT)::FLOAT AS ac, (0.3::FLOAT * pow(((1::FLOAT / 0.3::FLOAT)::FLOAT * distance::FLOAT)::FLOAT, 0.83::FLOAT)::FLOAT)::FLOAT AS soft FROM asked),
    b AS (SELECT *, least((1.095924047623553::FLOAT / greatest((0.5::FLOAT * d)::FLOAT, least(d, soft)))::FLOAT, 50::FLOAT) AS dc FROM a),
    c AS (SELECT *, least(CAST(floor(least(greatest((65536::FLOAT * ac / 5::FLOAT)::FLOAT, 1), 32768)) AS INTEGER), greatest(1, CAST(floor((dc * 4096::FLOAT * 1.6::FLOAT)::FLOAT) AS INTEGER))) AS global_scale FROM b),
    e AS (SELECT *, (65536::FLOAT / global_scale::FLOAT)::FLOAT AS inverse FROM c)
    SELECT distance, global_scale, CAST(floor(least(65536, (dc * inverse + 0.5::FLOAT)::FLOAT)) AS INTEGER) AS quant_dc,
      CAST(least(greatest(floor((ac * inverse + 0.5::FLOAT)::FLOAT), 1), 256) AS INTEGER) AS raw_quant, round(inverse::DOUBLE, 5) AS inverse_scale FROM e"""
)
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiser state for the sweep's distances."""
    rows = [(d, c.global_scale, c.quant_dc, c.raw_quant, round(c.inverse_scale, 5)) for d in (0.5, 1.0, 1.5, 2.0, 3.0, 4.0) for c in [calibrate(d)]]
    return spark.createDataFrame(rows, "distance double, global_scale int, quant_dc int, raw_quant int, inverse_scale double")
