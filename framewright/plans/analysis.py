"""Rate/distortion sweeps, timing and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.interpolation import curves, interpolate
from ..operators.windows import nearest_rank
from ..registry import query, table

ANCHOR = "A"
#: Lower values are better for these. Fixed values.
LOWER_IS_BETTER = ("butteraugli",)
METRICS = ("psnr", "butteraugli", "ssimulacra2")

_SWEEP = """
sweep AS (
  SELECT l_returnflag AS codec, CAST(l_suppkey AS VARCHAR) AS image, l_discount AS param_value,
         round(avg(l_extendedprice) / 1e4, 9) AS bpp, round(avg(l_quantity), 9) AS psnr, round(avg(l_tax) * 100, 9) AS butteraugli,
         round(avg(l_quantity * (1 - l_discount)), 9) AS ssimulacra2, count(*) AS coded
  FROM lineitem GROUP BY ALL)"""

_POINTS = (
    _SWEEP
    + """,
points AS (
  SELECT codec, image, param_value, bpp, 'psnr' AS metric, psnr AS q FROM sweep UNION ALL
  SELECT codec, image, param_value, bpp, 'butteraugli', -butteraugli FROM sweep UNION ALL
  SELECT codec, image, param_value, bpp, 'ssimulacra2', ssimulacra2 FROM sweep)"""
)


def _deltas(x: str, y: str, delta: str) -> str:
    return f"""
knots AS (SELECT codec, image, metric, {x} AS x, avg({y}) AS y FROM points WHERE codec <> 'A' GROUP BY ALL),
segments AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lag(x) OVER w AS x_before FROM knots WINDOW w AS (PARTITION BY codec, image, metric ORDER BY x)),
pairs AS (SELECT DISTINCT codec AS other, image, metric FROM knots),
anchors AS (SELECT p.other, a.* EXCLUDE codec, a.{x} AS at FROM points a JOIN pairs p USING (image, metric) WHERE a.codec = 'A'),
hit AS (
  SELECT a.other, a.image, a.metric, a.param_value, a.bpp, a.q,
         max(CASE WHEN s.x = a.at AND (s.x1 IS NOT NULL OR s.x_before IS NOT NULL) THEN s.y
                  WHEN s.x < a.at AND a.at < s.x1 THEN s.y + (s.y1 - s.y) * (a.at - s.x) / (s.x1 - s.x) END) AS v
  FROM anchors a JOIN segments s ON s.codec = a.other AND s.image = a.image AND s.metric = a.metric
  GROUP BY ALL),
deltas AS (SELECT *, {delta} AS delta FROM hit)"""


_QUALITY = _POINTS + "," + _deltas("bpp", "q", "q - v")
_BPP = _POINTS + "," + _deltas("q", "bpp", "v - bpp")


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per codec, image and parameter: size and quality."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("codec"), F.col("l_suppkey").cast("string").alias("image"), F.col("l_discount").alias("param_value"))
        .agg(
            F.round(F.avg("l_extendedprice") / 1e4, 9).alias("bpp"),
            F.round(F.avg("l_quantity"), 9).alias("psnr"),
            F.round(F.avg("l_tax") * 100, 9).alias("butteraugli"),
            F.round(F.avg(F.col("l_quantity") * (1 - F.col("l_discount"))), 9).alias("ssimulacra2"),
            F.count(F.lit(1)).alias("coded"),
        )
    )


def points(rows: DataFrame) -> DataFrame:
    """Long form: one row per metric, oriented so that more is better."""
    long = rows.unpivot(["codec", "image", "param_value", "bpp"], list(METRICS), "metric", "q")
    return long.withColumn("q", F.when(F.col("metric").isin(*LOWER_IS_BETTER), -F.col("q")).otherwise(F.col("q")))


def compare(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Each anchor point against each other codec's curve on its image: v is the curve at the point's x, or null."""
    own = rows.where(F.col("codec") == ANCHOR).drop("codec")
    others = curves(rows.where(F.col("codec") != ANCHOR).withColumnRenamed("codec", "other"), ["other", "image", "metric"], x, y, "knots")
    return own.join(others, ["image", "metric"]).withColumn("v", interpolate(F.col("knots"), F.col(x))).drop("knots")


def quality_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(points(sweep(spark, sf_dir)), "bpp", "q").withColumn("delta", F.col("q") - F.col("v"))


def bpp_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(points(sweep(spark, sf_dir)), "q", "bpp").withColumn("delta", F.col("v") - F.col("bpp"))


@query("WITH" + _SWEEP + " SELECT codec, image, concat('d=', param_value) AS param, param_value, bpp, round(24 / bpp, 6) AS ratio, psnr, butteraugli, ssimulacra2 FROM sweep")
def sweep_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sweep(spark, sf_dir).withColumn("param", F.concat(F.lit("d="), F.col("param_value").cast("string")))
    parsed = rows.withColumn("param_value", F.split("param", "=", 2)[1].cast("double"))
    return parsed.select("codec", "image", "param", "param_value", "bpp", F.round(24 / F.col("bpp"), 6).alias("ratio"), *METRICS)


_DELTA_COLUMNS = "SELECT other, image, metric, param_value, round(v, 6) AS v, round(delta, 6) AS delta FROM deltas"


def _delta_columns(df: DataFrame) -> DataFrame:
    return df.select("other", "image", "metric", "param_value", F.round("v", 6).alias("v"), F.round("delta", 6).alias("delta"))


@query("WITH" + _QUALITY + _DELTA_COLUMNS)
def rd_quality_at_bpp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delta_columns(quality_deltas(spark, sf_dir))


@query("WITH" + _BPP + _DELTA_COLUMNS)
def rd_bpp_at_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delta_columns(bpp_deltas(spark, sf_dir))


_SUMMARY = """
  SELECT '{side}' AS side, other, metric, CASE WHEN grouping(param_value) = 1 THEN 'all' ELSE concat('d=', param_value) END AS param,
         round(avg(bpp), 6) AS bpp_mean, count(delta) AS n, count(*) - count(delta) AS skipped,
         count(*) FILTER (WHERE delta > 0) AS wins, round(avg(delta), 6) AS mean, round(median(delta), 6) AS median,
         round(stddev_samp(delta), 6) AS std, round(min(delta), 6) AS min_delta, round(max(delta), 6) AS max_delta,
         round(avg(delta / bpp * 100), 5) AS pct,
         CASE WHEN count(delta) = 0 THEN '-' ELSE concat(CAST(round_even(100.0 * count(*) FILTER (WHERE delta > 0) / count(delta), 0) AS INTEGER), '%') END AS win_rate
  FROM {deltas} GROUP BY other, metric, ROLLUP (param_value)"""


def _summary(df: DataFrame, side: str) -> DataFrame:
    wins = F.count_if(F.col("delta") > 0)
    grouped = df.groupingSets(
        [[F.col("other"), F.col("metric"), F.col("param_value")], [F.col("other"), F.col("metric")]], F.col("other"), F.col("metric"), F.col("param_value")
    ).agg(
        F.grouping("param_value").alias("total"),
        F.round(F.avg("bpp"), 6).alias("bpp_mean"),
        F.count("delta").alias("n"),
        (F.count(F.lit(1)) - F.count("delta")).alias("skipped"),
        wins.alias("wins"),
        F.round(F.avg("delta"), 6).alias("mean"),
        F.round(F.median("delta"), 6).alias("median"),
        F.round(F.stddev_samp("delta"), 6).alias("std"),
        F.round(F.min("delta"), 6).alias("min_delta"),
        F.round(F.max("delta"), 6).alias("max_delta"),
        F.round(F.avg(F.col("delta") / F.col("bpp") * 100), 5).alias("pct"),
        F.rint(F.try_divide(F.lit(100.0) * wins, F.count("delta"))).cast("int").alias("rate"),
    )
    return grouped.select(
        F.lit(side).alias("side"), "other", "metric",
        F.when(F.col("total") == 1, "all").otherwise(F.concat(F.lit("d="), F.col("param_value").cast("string"))).alias("param"),
        "bpp_mean", "n", "skipped", "wins", "mean", "median", "std", "min_delta", "max_delta", "pct",
        F.coalesce(F.concat(F.col("rate").cast("string"), F.lit("%")), F.lit("-")).alias("win_rate"),
    )


@query("WITH" + _QUALITY + _SUMMARY.format(side="quality", deltas="deltas"))
def rd_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per parameter and over all: the quality deltas' summary."""
    return _summary(quality_deltas(spark, sf_dir), "quality")


@query("WITH" + _BPP + _SUMMARY.format(side="bpp", deltas="deltas"))
def rd_bpp_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per parameter and over all: the size deltas' summary, with the mean change in per cent."""
    return _summary(bpp_deltas(spark, sf_dir), "bpp")


@query(
    "WITH" + _POINTS + """ SELECT codec, metric, param_value, round(avg(bpp), 6) AS bpp_mean, round(coalesce(stddev_samp(bpp), 0), 6) AS bpp_std,
    round(avg(q), 6) AS q_mean, round(coalesce(stddev_samp(q), 0), 6) AS q_std FROM points GROUP BY ALL"""
)
def rd_mean_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and spread per codec and parameter: the plotted aggregate."""
    return points(sweep(spark, sf_dir)).groupBy("codec", "metric", "param_value").agg(
        F.round(F.avg("bpp"), 6).alias("bpp_mean"), F.round(F.coalesce(F.stddev_samp("bpp"), F.lit(0.0)), 6).alias("bpp_std"),
        F.round(F.avg("q"), 6).alias("q_mean"), F.round(F.coalesce(F.stddev_samp("q"), F.lit(0.0)), 6).alias("q_std"),
    )


@query(
    "WITH" + _SWEEP + """, means AS (SELECT codec, param_value, avg(bpp) AS m, count(*) AS n FROM sweep GROUP BY ALL),
    images AS (SELECT codec, count(DISTINCT image) AS images FROM sweep GROUP BY ALL)
    SELECT codec, CAST(sum(n) AS BIGINT) AS n, any_value(images) AS images, count(*) AS params, round(min(m), 6) AS bpp_low, round(max(m), 6) AS bpp_high
    FROM means JOIN images USING (codec) GROUP BY codec"""
)
def dataset_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sweep(spark, sf_dir)
    means = rows.groupBy("codec", "param_value").agg(F.avg("bpp").alias("m"), F.count(F.lit(1)).alias("n"))
    images = rows.groupBy("codec").agg(F.countDistinct("image").alias("images"))
    return means.groupBy("codec").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("params"), F.round(F.min("m"), 6).alias("bpp_low"), F.round(F.max("m"), 6).alias("bpp_high")
    ).join(images, "codec")


@query(
    "WITH" + _SWEEP + """, wanted AS (SELECT i.image, c.codec, p.param_value FROM (SELECT DISTINCT image FROM sweep) i,
    (SELECT DISTINCT codec FROM sweep WHERE codec <> 'A') c, (SELECT DISTINCT param_value FROM sweep) p)
    SELECT w.* FROM wanted w ANTI JOIN (SELECT * FROM sweep WHERE coded > 5) s USING (image, codec, param_value)"""
)
def cached_rows_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted images x (codec, parameter) that the cache (here: rows with more than five samples) doesn't hold."""
    rows = sweep(spark, sf_dir)
    settings = rows.where(F.col("codec") != ANCHOR).select("codec").distinct().crossJoin(rows.select("param_value").distinct())  # codecs x parameters: both small by nature
    wanted = rows.select("image").distinct().crossJoin(F.broadcast(settings))
    return wanted.join(rows.where("coded > 5"), ["image", "codec", "param_value"], "left_anti").select("image", "codec", "param_value")


_TIMING = """
ranked AS (SELECT event_type AS codec, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM events WHERE value IS NOT NULL),
timing AS (
  SELECT codec, count(*) AS n, round(sum(value), 4) AS total_us, round(avg(value), 6) AS mean_us, round(1e6 * count(*) / sum(value), 4) AS fps,
         round(coalesce(stddev_samp(value), 0), 6) AS stddev_us, min(value) AS min_us, max(CASE WHEN i = floor(0.5 * (c - 1) + 0.5) THEN value END) AS p50_us,
         max(CASE WHEN i = floor(0.99 * (c - 1) + 0.5) THEN value END) AS p99_us, max(value) AS max_us FROM ranked GROUP BY codec)"""


@query("WITH" + _TIMING + " SELECT *, round(3840 * 2160 / 1e6 * fps, 3) AS megapixels_per_s FROM timing")
def timing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, spread and nearest-rank percentiles of samples per codec."""
    samples = table(spark, sf_dir, "events").select(F.col("event_type").alias("codec"), "value").where("value is not null")
    basic = samples.groupBy("codec").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total_us"), F.round(F.avg("value"), 6).alias("mean_us"),
        F.round(F.try_divide(F.lit(1e6) * F.count(F.lit(1)), F.sum("value")), 4).alias("fps"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("stddev_us"),
        F.min("value").alias("min_us"), F.max("value").alias("max_us"),
    )
    ranks = nearest_rank(samples, ["codec"], "value", {"p50_us": 0.5, "p99_us": 0.99})
    return basic.join(ranks, "codec").withColumn("megapixels_per_s", F.round(F.lit(3840 * 2160 / 1e6) * F.col("fps"), 3))


#: Quality-matched settings: (own, other). Fixed values.
PAIRS = [("click", "view"), ("purchase", "signup")]


@query(
    "WITH" + _TIMING + """, pairs(own, other) AS (VALUES ('click', 'view'), ('purchase', 'signup'))
    SELECT own, other, round(a.mean_us, 4) AS own_us, round(b.mean_us, 4) AS other_us, round(b.mean_us / nullif(a.mean_us, 0), 6) AS speedup,
    CASE WHEN a.mean_us <= 0 THEN 'unknown' WHEN b.mean_us / a.mean_us >= 1 THEN 'faster' ELSE 'slower' END AS verdict,
    round(CASE WHEN b.mean_us / nullif(a.mean_us, 0) >= 1 THEN b.mean_us / a.mean_us ELSE a.mean_us / nullif(b.mean_us, 0) END, 6) AS factor
    FROM pairs JOIN timing a ON a.codec = own JOIN timing b ON b.codec = other"""
)
def codec_pair_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(spark, sf_dir, "events").where("value is not null").groupBy(F.col("event_type").alias("codec")).agg(F.round(F.avg("value"), 6).alias("us"))
    pairs = spark.createDataFrame(PAIRS, "own string, other string")
    both = pairs.join(stats.select(F.col("codec").alias("own"), F.col("us").alias("a")), "own").join(stats.select(F.col("codec").alias("other"), F.col("us").alias("b")), "other")
    s = F.try_divide("b", "a")
    return both.select(
        "own", "other", F.round("a", 4).alias("own_us"), F.round("b", 4).alias("other_us"), F.round(s, 6).alias("speedup"),
        F.when(F.col("a") <= 0, "unknown").when(s >= 1, "faster").otherwise("slower").alias("verdict"),
        F.round(F.when(s >= 1, s).otherwise(F.try_divide("a", "b")), 6).alias("factor"),
    )


#: name, limit, whether the value must be at least the limit. Fixed values.
CONSTRAINTS = [("dram_bandwidth", 17e9, False), ("sm_time", 0.25, False), ("cpu_cores", 1.5, False), ("throughput", 15.0, True)]


def budget(stages: DataFrame, fps: float = 15.0, gpu_time: float = 1.0, cpu_time: float = 1.0, bandwidth: float = 1.0) -> DataFrame:
    """Totals of stage records (bytes_moved, gpu_us, cpu_us) against the constraints, one row each."""
    frame_us = 1e6 / fps
    total = stages.agg(F.sum("bytes_moved").alias("bytes"), F.sum("gpu_us").alias("gpu"), F.sum("cpu_us").alias("cpu"))
    value = {
        "dram_bandwidth": F.col("bytes") * bandwidth * fps,
        "sm_time": F.col("gpu") * gpu_time / frame_us,
        "cpu_cores": F.col("cpu") * cpu_time / frame_us,
        "throughput": F.lit(float(fps)),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("name"), value[n].alias("value"), F.lit(x).alias("limit_value"), F.lit(least).alias("least")) for n, x, least in CONSTRAINTS])
    each = total.select(F.explode(rows).alias("r")).select("r.*")
    ok = F.when(F.col("least"), F.col("value") >= F.col("limit_value")).otherwise(F.col("value") <= F.col("limit_value"))
    return each.select("name", F.round("value", 6).alias("value"), "limit_value", ok.alias("passed"))


@query(
    """WITH stages AS (SELECT count(*) * 1e6 AS bytes_moved, sum(value) AS gpu_us, sum(value) / 2 AS cpu_us FROM events GROUP BY event_type),
    t AS (SELECT sum(bytes_moved) AS bytes, sum(gpu_us) AS gpu, sum(cpu_us) AS cpu FROM stages),
    v AS (SELECT 'dram_bandwidth' AS name, bytes * 15e0 AS value, 17e9 AS limit_value, false AS least FROM t UNION ALL
          SELECT 'sm_time', gpu / (1e6 / 15), 0.25, false FROM t UNION ALL SELECT 'cpu_cores', cpu / (1e6 / 15), 1.5, false FROM t UNION ALL
          SELECT 'throughput', 15e0, 15.0, true FROM t),
    c AS (SELECT name, round(value, 6) AS value, CAST(limit_value AS DOUBLE) AS limit_value, CASE WHEN least THEN value >= limit_value ELSE value <= limit_value END AS passed FROM v)
    SELECT *, (SELECT bool_and(passed) FROM c) AS all_passed FROM c"""
)
def budget_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = table(spark, sf_dir, "events").groupBy("event_type").agg(
        (F.count(F.lit(1)) * 1e6).alias("bytes_moved"), F.sum("value").alias("gpu_us"), (F.sum("value") / 2).alias("cpu_us")
    )
    rows = budget(stages)
    return rows.join(F.broadcast(rows.agg(F.bool_and("passed").alias("all_passed"))))  # one row
