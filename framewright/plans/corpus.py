"""Corpus building: selection, names, manifests, attributions, download schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text
from ..operators.windows import CHUNK, dedupe_names, streaks
from ..registry import query, table

#: Limits of accepted images, inclusive; resolutions. Fixed values.
MIN_WIDTH, MIN_HEIGHT, MAX_WIDTH, MAX_HEIGHT = 3840, 2160, 8000, 8000
RUNGS = [("2160p", 1, 3840, 2160), ("1080p", 2, 1920, 1080), ("720p", 3, 1280, 720)]
BATCH = 50

_CATALOGUE = """
catalogue AS (
  SELECT p_partkey AS id, concat('File:', p_name, '.', CASE p_size % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'tif' ELSE 'webp' END) AS title,
         3000 + ((3 * p_partkey) % 6000) AS width, 2000 + ((7 * p_partkey) % 7000) AS height,
         CASE p_size % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/tiff' ELSE 'image/webp' END AS mime,
         CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS author, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END AS license
  FROM part),
chosen AS (
  SELECT * REPLACE (coalesce(nullif(license, ''), 'unknown') AS license, coalesce(author, '') AS author) FROM catalogue
  WHERE mime IN ('image/jpeg', 'image/png', 'image/tiff') AND width BETWEEN 3840 AND 8000 AND height BETWEEN 2160 AND 8000)"""


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part table read as a catalogue of files."""
    kind = F.col("p_size") % 4
    pick = lambda *v: F.when(kind == 0, v[0]).when(kind == 1, v[1]).when(kind == 2, v[2]).otherwise(v[3])
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("File:"), "p_name", F.lit("."), pick("jpg", "png", "tif", "webp")).alias("title"),
        (F.lit(3000) + (3 * F.col("p_partkey")) % 6000).alias("width"),
        (F.lit(2000) + (7 * F.col("p_partkey")) % 7000).alias("height"),
        pick("image/jpeg", "image/png", "image/tiff", "image/webp").alias("mime"),
        F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")).alias("author"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_type")).alias("license"),
    )


def candidates(files: DataFrame) -> DataFrame:
    """Accepted types and sizes; missing authors become '', missing licences 'unknown'."""
    return files.where(
        F.col("mime").isin(*text.EXTENSIONS) & F.col("width").between(MIN_WIDTH, MAX_WIDTH) & F.col("height").between(MIN_HEIGHT, MAX_HEIGHT)
    ).withColumns({"author": F.coalesce("author", F.lit("")), "license": F.coalesce(F.nullif("license", F.lit("")), F.lit("unknown"))})


@query("WITH" + _CATALOGUE + " SELECT id, title, width, height, mime, author, license FROM chosen ORDER BY title, id LIMIT 100")
def catalog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred accepted files by title."""
    return candidates(catalogue(spark, sf_dir)).orderBy("title", "id").limit(100)



@query(
    """WITH names AS (SELECT page_id, regexp_replace(substr(trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^File:', ''), '\\.[^.]*$', '')), '[^a-z0-9]+', '_', 'g'), '_'), 1, 64), '_+$', '') AS n FROM pages),
    based AS (SELECT page_id, CASE WHEN n = '' THEN 'file' ELSE n END AS base FROM names)
    SELECT page_id, base, CASE WHEN r = 1 THEN base ELSE concat(base, '_', r) END AS name FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY page_id) AS r FROM based)"""
)
def sanitize_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the pages' hosts, of which many are equal, numbered in page order."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", text.sanitize_name(host).alias("base"))
    return dedupe_names(pages, "base", ["page_id"], F.floor(F.col("page_id") / CHUNK)).select("page_id", "base", "name")


@query(
    "WITH" + _CATALOGUE + """, named AS (SELECT id, title, mime, regexp_replace(substr(trim(regexp_replace(lower(regexp_replace(regexp_replace(title, '^File:', ''), '\\.[^.]*$', '')), '[^a-z0-9]+', '_', 'g'), '_'), 1, 64), '_+$', '') AS b FROM chosen),
    based AS (SELECT id, title, mime, CASE WHEN b = '' THEN 'file' ELSE b END AS base FROM named),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY title, id) AS r FROM based)
    SELECT id, title, concat(CASE WHEN r = 1 THEN base ELSE concat(base, '_', r) END, '.', CASE mime WHEN 'image/jpeg' THEN 'jpg' WHEN 'image/png' THEN 'png' ELSE 'tif' END) AS file,
    concat(CASE WHEN r = 1 THEN base ELSE concat(base, '_', r) END, '_1080p.nv12') AS frame FROM numbered"""
)
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored names of accepted files and of their frames."""
    rows = candidates(catalogue(spark, sf_dir)).select("id", "title", "mime", text.sanitize_name(F.col("title")).alias("base"))
    return dedupe_names(rows, "base", ["title", "id"], F.struct("title", F.floor(F.col("id") / CHUNK))).select(
        "id", "title", F.concat_ws(".", "name", text.extension_of(F.col("mime"))).alias("file"), F.concat("name", F.lit("_1080p.nv12")).alias("frame")
    )


@query(
    """WITH cut AS (SELECT page_id, url, regexp_extract(url, '^([^?#]*)', 1) AS base, regexp_extract(url, '#(.*)$', 1) AS frag,
      list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]*=.+')) AS pairs FROM pages),
    decoded AS (SELECT page_id, url, base, frag, list_transform(pairs, lambda p: {'k': url_decode(replace(regexp_extract(p, '^([^=]*)=', 1), '+', ' ')), 'v': url_decode(replace(regexp_extract(p, '^[^=]*=(.*)$', 1), '+', ' '))}) AS pairs FROM cut),
    coded AS (SELECT page_id, url, base, frag, array_to_string(list_transform(list_filter(pairs, lambda p: NOT starts_with(p.k, 'utm_')),
      lambda p: replace(url_encode(p.k), '%20', '+') || '=' || replace(url_encode(p.v), '%20', '+')), '&') AS q FROM decoded)
    SELECT page_id, url, concat(lower(regexp_extract(base, '^[A-Za-z][A-Za-z0-9+.-]*:')), regexp_replace(base, '^[A-Za-z][A-Za-z0-9+.-]*:', ''), CASE WHEN q = '' THEN '' ELSE '?' || q END, CASE WHEN frag = '' THEN '' ELSE '#' || frag END) AS clean FROM coded"""
)
def strip_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", text.strip_tracking(F.col("url")).alias("clean"))


@query()
def strip_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text nodes, joined as they follow."""
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@query("SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256, n_chars FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"), "n_chars")


@query(
    """WITH old AS (SELECT d.doc_id, concat('doc_', d.doc_id) AS source, CASE WHEN l.quality = 1 THEN '1080p' ELSE '720p' END AS rung, sha256(d.text) AS sha256 FROM documents d JOIN labels l USING (doc_id)),
    fresh AS (SELECT doc_id, concat('doc_', doc_id) AS source, '1080p' AS rung, sha256(text) AS sha256 FROM documents),
    present AS (SELECT concat('doc_', doc_id) AS source FROM documents WHERE n_chars > 500),
    kept AS (SELECT o.source, o.rung, o.sha256, 'kept' AS state FROM old o SEMI JOIN present p USING (source) WHERE o.rung <> '1080p'),
    made AS (SELECT f.source, f.rung, f.sha256, CASE WHEN o.sha256 IS NULL THEN 'new' ELSE 'reused' END AS state
             FROM fresh f LEFT JOIN old o ON o.source = f.source AND o.rung = f.rung AND o.sha256 = f.sha256)
    SELECT * FROM kept UNION ALL SELECT * FROM made"""
)
def manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An old manifest and one rung's new assets: other rungs stay while their source is there; an asset with equal hash is reused."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source"), F.sha2("text", 256).alias("sha256"), "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "1080p").otherwise("720p").alias("rung"))
    old = docs.join(labels, "doc_id").select("source", "rung", "sha256")
    made = docs.select("source", F.lit("1080p").alias("rung"), "sha256")
    kept = old.where("rung <> '1080p'").join(docs.where("n_chars > 500").select("source"), "source", "left_semi").withColumn("state", F.lit("kept"))
    same = old.withColumn("__old", F.lit(True))
    state = made.join(same, ["source", "rung", "sha256"], "left").withColumn("state", F.when(F.col("__old"), "reused").otherwise("new")).drop("__old")
    return kept.unionByName(state)


@query("WITH" + _CATALOGUE + " SELECT id, concat(title, ': ', coalesce(nullif(author, ''), 'uncredited'), ', ', license, ', https://example.org/', id) AS line FROM chosen")
def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the credits file."""
    who = F.coalesce(F.nullif("author", F.lit("")), F.lit("uncredited"))
    return candidates(catalogue(spark, sf_dir)).select("id", F.format_string("%s: %s, %s, https://example.org/%d", "title", who, "license", "id").alias("line"))


_STREAK = """
marked AS (SELECT event_id, user_id, ts, event_type = 'error' AS bad, count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
streak AS (SELECT *, count(*) FILTER (WHERE bad) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS n FROM marked)"""


@query("WITH" + _STREAK + " SELECT event_id, user_id, bad, CASE WHEN bad THEN n ELSE 0 END AS streak, CASE WHEN bad AND n % 3 = 0 THEN 300 ELSE 0 END AS cooldown_s FROM streak")
def rate_limit_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third refused attempt in a row adds a cool-down."""
    rows = streaks(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", F.to_date("ts"))
    bad = F.col("event_type") == "error"
    return rows.select(
        "event_id", "user_id", bad.alias("bad"), F.when(bad, F.col("streak")).otherwise(0).alias("streak"), F.when(bad & (F.col("streak") % 3 == 0), 300).otherwise(0).alias("cooldown_s")
    )


@query(
    "WITH" + _STREAK + """ SELECT event_id, user_id, n - 1 AS attempt,
    least(greatest(CAST(event_id % 50 AS DOUBLE), 30e0 * pow(2, least(n - 1, 10))), 600e0) + CASE WHEN n % 3 = 0 THEN 300e0 ELSE 0e0 END AS delay_s FROM streak WHERE bad"""
)
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting times of refused attempts: the larger of what the server asks and a doubling delay, at most ten minutes, plus the cool-down."""
    rows = streaks(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", F.to_date("ts")).where("event_type = 'error'")
    attempt = F.col("streak") - 1
    asked = (F.col("event_id") % 50).cast("double")
    delay = F.least(F.greatest(asked, 30.0 * F.pow(F.lit(2.0), F.least(attempt, F.lit(10)))), F.lit(600.0))
    return rows.select("event_id", "user_id", attempt.alias("attempt"), (delay + F.when(F.col("streak") % 3 == 0, 300.0).otherwise(0.0)).alias("delay_s"))


@query(
    """SELECT part, batch, count(*) AS titles, string_agg(concat('Page ', page_id), '|' ORDER BY page_id) AS joined FROM (
    SELECT page_id, page_id // 500 AS part, (row_number() OVER (PARTITION BY page_id // 500 ORDER BY page_id) - 1) // 50 AS batch FROM pages) GROUP BY part, batch"""
)
def batch_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in request batches of fifty, within each listing page of five hundred."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.floor(F.col("page_id") / 500).alias("part"))
    n = F.row_number().over(W.partitionBy("part").orderBy("page_id")) - 1
    rows = pages.withColumn("batch", F.floor(n / BATCH))
    joined = F.concat_ws("|", F.transform(F.array_sort(F.collect_list("page_id")), lambda x: F.concat(F.lit("Page "), x.cast("string"))))
    return rows.groupBy("part", "batch").agg(F.count(F.lit(1)).alias("titles"), joined.alias("joined"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def events_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(
    "WITH" + _CATALOGUE + """ SELECT id, width, height, CASE WHEN width * 9 > height * 16 THEN CAST(round_even(height * 16 / 9, 0) AS BIGINT) ELSE width END AS crop_w,
    CASE WHEN width * 9 < height * 16 THEN CAST(round_even(width * 9 / 16, 0) AS BIGINT) ELSE height END AS crop_h,
    (width - CASE WHEN width * 9 > height * 16 THEN CAST(round_even(height * 16 / 9, 0) AS BIGINT) ELSE width END) // 2 AS left_edge,
    (height - CASE WHEN width * 9 < height * 16 THEN CAST(round_even(width * 9 / 16, 0) AS BIGINT) ELSE height END) // 2 AS top_edge FROM chosen"""
)
def centre_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest centred 16:9 rectangle."""
    w, h = F.col("width"), F.col("height")
    crop_w = F.when(w * 9 > h * 16, F.rint(h * 16 / 9).cast("long")).otherwise(w)
    crop_h = F.when(w * 9 < h * 16, F.rint(w * 9 / 16).cast("long")).otherwise(h)
    return candidates(catalogue(spark, sf_dir)).select(
        "id", "width", "height", crop_w.alias("crop_w"), crop_h.alias("crop_h"), F.floor((w - crop_w) / 2).alias("left_edge"), F.floor((h - crop_h) / 2).alias("top_edge")
    )


@query(
    "WITH" + _CATALOGUE + """, rungs(rung, factor, w, h) AS (VALUES ('2160p', 1, 3840, 2160), ('1080p', 2, 1920, 1080), ('720p', 3, 1280, 720))
    SELECT id, rung, w AS width, h AS height, CAST(w * h * 3 // 2 AS BIGINT) AS nv12_bytes FROM chosen, rungs"""
)
def ladder_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every accepted file at every resolution (a table of three rows)."""
    rungs = F.broadcast(spark.createDataFrame(RUNGS, "rung string, factor int, width int, height int"))
    return candidates(catalogue(spark, sf_dir)).select("id").crossJoin(rungs).select("id", "rung", "width", "height", F.floor(F.col("width") * F.col("height") * 3 / 2).alias("nv12_bytes"))
