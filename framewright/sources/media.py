"""Frames and records from files, and files from frames."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Schemas of documents that other tools exchange.
FILE = "name string, page string, url string, width int, height int, mime string, sha1 string, author string, license string"
SOURCES = f"generated string, constraints struct<category:string,min_width:int,min_height:int,max_width:int,max_height:int,mimes:array<string>>, files array<struct<{FILE.replace(' ', ':').replace(',:', ',')}>>"
ASSET = "source string, name string, rung string, width int, height int, nv12_bytes bigint, sha256 string"
MANIFEST = f"colorspace string, range string, format string, chroma string, assets array<struct<{ASSET.replace(' ', ':').replace(',:', ',')}>>"
SWEEP = "image string, resolution string, codec string, param string, coded_bytes bigint, bpp double, ratio double, psnr double, butteraugli double, ssimulacra2 double"
STAGES = "fps double, projection struct<gpu_time:double,cpu_time:double,bandwidth:double>, stages array<struct<name:string,bytes_moved:double,gpu_us:double,cpu_us:double>>"
INFO = (
    "struct<query:struct<pages:map<string,struct<title:string,imageinfo:array<struct<url:string,descriptionurl:string,width:int,height:int,mime:string,sha1:string,"
    "extmetadata:map<string,struct<value:string>>>>>>>>"
)


def read_nv12(spark: SparkSession, path: str, width: int, height: int, glob: str = "*.nv12") -> DataFrame:
    """Raw frames of a folder as (image, content), in the order of their paths. A file of another size is an error."""
    size = width * height * 3 // 2
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    if rows.select("path").isEmpty():
        raise FileNotFoundError(f"no {glob} in {path}")
    checked = F.when(F.col("length") == size, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("short frame: "), F.col("path"))).cast("binary"))
    return rows.select("path", checked.alias("content")).orderBy("path").select(F.regexp_extract("path", "([^/]*)$", 1).alias("image"), "content")


def _lines(frames: DataFrame, first: int, count: int, width: int) -> DataFrame:
    """(image, row, line) of whole lines of bytes, cut before anything is decoded: a row is one line, not a frame."""
    cut = frames.select("image", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("row"), "content")
    return cut.select("image", "row", F.substr("content", F.lit(first + 1) + F.col("row") * width, F.lit(width)).alias("line"))


def scanlines(frames: DataFrame, width: int, height: int) -> DataFrame:
    """(image, y, luma) of raw frames."""
    ship(frames.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"image": b["image"], "y": b["row"], "luma": [np.frombuffer(x, np.uint8).astype(np.int32) for x in b["line"]]})

    return _lines(frames, 0, height, width).mapInPandas(run, "image string, y int, luma array<int>")


def chroma_rows(frames: DataFrame, width: int, height: int) -> DataFrame:
    """(image, cy, cb, cr): even bytes are Cb, odd ones Cr."""
    ship(frames.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [np.frombuffer(x, np.uint8).astype(np.int32) for x in b["line"]]
            yield pd.DataFrame({"image": b["image"], "cy": b["row"], "cb": [v[0::2] for v in both], "cr": [v[1::2] for v in both]})

    return _lines(frames, width * height, height // 2, width).mapInPandas(run, "image string, cy int, cb array<int>, cr array<int>")


def synthetic_nv12(width: int, height: int) -> bytes:
    """A test frame of two ramps."""
    x = np.arange(width)
    luma, chroma = (x * a + np.arange(n)[:, None] * b for a, b, n in ((3, 5, height), (7, 11, height // 2)))
    return (luma & 255).astype(np.uint8).tobytes() + (chroma & 255).astype(np.uint8).tobytes()


def parse_imageinfo(responses: DataFrame) -> DataFrame:
    """Candidate files from API responses (column value: JSON). Only the first info of a page counts; missing fields get defaults."""
    pages = responses.select(F.explode(F.map_values(F.from_json("value", INFO)["query"]["pages"])).alias("p")).select("p.title", F.get("p.imageinfo", F.lit(0)).alias("i"))
    from ..plans.corpus import MAX_HEIGHT, MAX_WIDTH, MIN_HEIGHT, MIN_WIDTH
    from ..functions import text

    found = pages.where(F.col("i.mime").isin(*text.EXTENSIONS) & F.col("i.width").between(MIN_WIDTH, MAX_WIDTH) & F.col("i.height").between(MIN_HEIGHT, MAX_HEIGHT))
    meta = lambda key: F.coalesce(F.try_element_at(F.col("i.extmetadata"), F.lit(key))["value"], F.lit(""))
    return found.select(
        "title", F.col("i.descriptionurl").alias("page"), text.strip_tracking(F.col("i.url")).alias("url"), F.col("i.width").alias("width"), F.col("i.height").alias("height"),
        F.col("i.mime").alias("mime"), F.coalesce("i.sha1", F.lit("")).alias("sha1"), text.strip_html(meta("Artist")).alias("author"),
        F.coalesce(F.nullif(meta("LicenseShortName"), F.lit("")), F.lit("unknown")).alias("license"),
    )


def collect_pages(spark: SparkSession, fetch: Callable[[dict], str], wanted: int, category: str = "Category:Files") -> DataFrame:
    """Responses of a paged listing, page by page on the driver until enough candidates are there; fetch(params) returns JSON text.

    Whole listing pages are taken, titles go in batches of fifty. The driver only counts; the responses become rows.
    """
    responses: list[tuple[str]] = []
    token, found = None, 0
    while found < wanted:
        params = {"action": "query", "list": "categorymembers", "cmtitle": category, "cmtype": "file", "cmlimit": "500"} | ({"cmcontinue": token} if token else {})
        listing = json.loads(fetch(params))
        titles = [m["title"] for m in listing["query"]["categorymembers"]]
        fresh = [fetch({"action": "query", "prop": "imageinfo", "titles": "|".join(titles[i : i + 50])}) for i in range(0, len(titles), 50)]
        responses += [(x,) for x in fresh]
        found += sum(map(_candidates, fresh))
        token = listing.get("continue", {}).get("cmcontinue")
        if token is None:
            break
    return spark.createDataFrame(responses, "value string")


def _candidates(response: str) -> int:
    """How many pages of a response ``parse_imageinfo`` keeps."""
    from ..functions.text import EXTENSIONS
    from ..plans.corpus import MAX_HEIGHT, MAX_WIDTH, MIN_HEIGHT, MIN_WIDTH

    infos = [page["imageinfo"][0] for page in json.loads(response).get("query", {}).get("pages", {}).values() if page.get("imageinfo")]
    return sum(i.get("mime") in EXTENSIONS and MIN_WIDTH <= i.get("width", 0) <= MAX_WIDTH and MIN_HEIGHT <= i.get("height", 0) <= MAX_HEIGHT for i in infos)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A document file with a fixed schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def sources(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The files of a sources document, in order, the first ``limit`` of them."""
    rows = read_json(spark, path, SOURCES).select(F.posexplode("files").alias("pos", "f")).select("pos", "f.*")
    return rows if limit is None else rows.where(F.col("pos") < limit)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Assets of a manifest; none if there is no file."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], ASSET)
    return read_json(spark, path, MANIFEST).select(F.explode("assets").alias("a")).select("a.*")


def write_manifest(assets: DataFrame, path: str) -> None:
    """One document, assets by name, keys sorted. A manifest has a few rows per image and is one file by nature."""
    from .reports import manifest_document, write_json

    write_json(assets.sparkSession, path, manifest_document(assets), sort_keys=True)


def sweep_points(spark: SparkSession, path: str) -> DataFrame:
    """Records of a sweep file in long form: one row per metric, the parameter as a number, oriented so that more is better."""
    from ..plans.analysis import points

    rows = read_json(spark, path, SWEEP)
    return points(rows.select("codec", "image", F.split("param", "=", 2)[1].cast("double").alias("param_value"), "bpp", "psnr", "butteraugli", "ssimulacra2"))


def stage_records(spark: SparkSession, path: str) -> DataFrame:
    """Stages of a budget document, with its rate and factors in each row."""
    return read_json(spark, path, STAGES).select("fps", "projection", F.explode("stages").alias("s")).select("fps", "projection", "s.*")


def parse_report(reports: DataFrame) -> DataFrame:
    """Typed rows from text reports of the timing tool (column value). A field that is missing is an error."""

    def field(pattern: str, kind: str) -> Column:
        got = F.regexp_extract("value", pattern, 1)
        return F.when(got != "", got).otherwise(F.raise_error(F.lit(f"report has no {pattern}")).cast("string")).cast(kind)

    numbers = {"n": "long", "total": "double", "mean": "double", "fps": "double", "stddev": "double", "min": "double", "p50": "double", "p99": "double", "max": "double"}
    return reports.select(field(r"codec:\s*(\S+)", "string").alias("codec"), field(r"size:\s*(\d+)x", "int").alias("width"), field(r"size:\s*\d+x(\d+)", "int").alias("height"),
                          *[field(rf"(?m)^\s*{k}:\s*([-+.\deE]+)", t).alias(k) for k, t in numbers.items()])


def missing_rows(requested: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Requested settings without a cached row."""
    return requested.join(cached, keys, "left_anti")
