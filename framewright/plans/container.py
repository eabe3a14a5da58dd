"""Whole files: DC and metadata sections, code descriptions, headers and the container, joined in order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..operators import codestream, strips, tokens
from ..operators.huffman import BitWriter
from ..operators.windows import CHUNK, scan_large
from ..params import calibrate
from ..registry import query, table
from .frames import blocks_of, channel_blocks

DISTANCE = 1.0


def dc_sections(blocks: DataFrame) -> DataFrame:
    """(image, part, gy, gx, data) of the DC groups: at most 256 x 256 blocks in a task."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["by", "bx"])
        top, left = int(pdf["gy"].iloc[0]) * 256, int(pdf["gx"].iloc[0]) * 256
        sides = pdf["side"].to_numpy() // 8
        h, w = int((pdf["by"] + sides).max()) - top, int((pdf["bx"] + sides).max()) - left
        planes = np.zeros((3, h, w), np.int64)
        to_x, to_b = (np.zeros((-(-h // 8), -(-w // 8)), np.int64) for _ in range(2))
        for by, bx, m, x, b, dc in zip(pdf["by"] - top, pdf["bx"] - left, sides, pdf["ytox"], pdf["ytob"], pdf["dc"], strict=True):
            planes[:, by : by + m, bx : bx + m] = np.stack([np.asarray(v).reshape(m, m) for v in dc])
            to_x[by // 8, bx // 8], to_b[by // 8, bx // 8] = x, b
        data = codestream.dc_group(planes, to_x, to_b, list(zip(pdf["side"].tolist(), pdf["qf"].tolist(), strict=True)))
        return pd.DataFrame({"image": [pdf["image"].iloc[0]], "part": [1], "gy": [top // 256], "gx": [left // 256], "data": [data]})

    placed = blocks.select("image", "by", "bx", "side", "qf", "ytox", "ytob", "dc", F.floor(F.col("by") / 256).alias("gy"), F.floor(F.col("bx") / 256).alias("gx"))
    return placed.groupBy("image", "gy", "gx").applyInPandas(pack, "image string, part int, gy long, gx long, data binary")


def ac_plans(coded: DataFrame, n_groups: DataFrame) -> DataFrame:
    """(image, data, codes) of each frame's section before the AC groups: at most 32 clusters of 256 symbols."""

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: list[list[int]] = [[0] * 256 for _ in range(codestream.CLUSTERS)]
        for c, s, n in pdf[["cluster", "symbol", "n"]].itertuples(index=False):
            groups[c][s] += n
        data, codes = codestream.ac_global(groups, int(pdf["groups"].iloc[0]))
        flat = [(c, s, d, b) for c, code in enumerate(codes) for s, (d, b) in code.items()]
        return pd.DataFrame({"image": [pdf["image"].iloc[0]], "data": [data], "codes": [[dict(zip(("cluster", "symbol", "depth", "code"), x, strict=True)) for x in flat]]})

    counted = coded.groupBy("image", "cluster", "symbol").agg(F.count(F.lit(1)).alias("n")).join(n_groups, "image")
    return counted.groupBy("image").applyInPandas(plan, "image string, data binary, codes array<struct<cluster:int,symbol:int,depth:int,code:int>>")


def ac_sections(coded: DataFrame, plans: DataFrame) -> DataFrame:
    """(image, part, gy, gx, data) of the AC groups: at most 32 x 32 blocks of three channels in a task."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        w = BitWriter()
        for depth, code, nbits, bits in pdf.sort_values(["by", "bx", "place", "k"])[["depth", "code", "nbits", "bits"]].itertuples(index=False):
            w.put(depth, code)
            w.put(nbits, bits)
        return pd.DataFrame({"image": [pdf["image"].iloc[0]], "part": [3], "gy": [int(pdf["gy"].iloc[0])], "gx": [int(pdf["gx"].iloc[0])], "data": [w.bytes()]})

    codes = plans.select("image", F.explode("codes").alias("x")).select("image", "x.*")
    place = F.when(F.col("c") == 1, 0).when(F.col("c") == 0, 1).otherwise(2)  # channels are coded Y, X, B
    joined = coded.withColumn("place", place).join(codes, ["image", "cluster", "symbol"])
    return joined.groupBy("image", "gy", "gx").applyInPandas(pack, "image string, part int, gy long, gx long, data binary")


def files(blocks: DataFrame, distance: float = DISTANCE) -> DataFrame:
    """(image, width, height, sections, file): sections in order (DC globals, DC groups, AC globals, AC groups) behind the head, in a container. One frame in a task."""
    cal = calibrate(distance)
    coded = tokens.tokenize(channel_blocks(blocks))
    m = F.col("side") / 8
    size = blocks.groupBy("image").agg((F.max(F.col("bx") + m) * 8).cast("int").alias("width"), (F.max(F.col("by") + m) * 8).cast("int").alias("height"))
    n_groups = size.select("image", (F.ceil(F.col("width") / 256) * F.ceil(F.col("height") / 256)).alias("groups"))
    plans = ac_plans(coded, n_groups)
    one = lambda part, data: (F.col("image"), F.lit(part).alias("part"), F.lit(0).cast("long").alias("gy"), F.lit(0).cast("long").alias("gx"), data.alias("data"))
    start = size.select(*one(0, F.lit(codestream.dc_global(cal.global_scale, cal.quant_dc))))
    every = start.unionByName(dc_sections(blocks)).unionByName(plans.select(*one(2, F.col("data")))).unionByName(ac_sections(coded, plans))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [bytes(x) for x in pdf.sort_values(["part", "gy", "gx"])["data"]]
        width, height = int(pdf["width"].iloc[0]), int(pdf["height"].iloc[0])
        data = codestream.container(codestream.head(width, height, [len(x) for x in parts]) + b"".join(parts))
        return pd.DataFrame({"image": [pdf["image"].iloc[0]], "width": [width], "height": [height], "sections": [len(parts)], "file": [data]})

    return every.join(size, "image").groupBy("image").applyInPandas(join, "image string, width int, height int, sections int, file binary")


@query()
def jxl_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame's file: sections, size and hash. A test reads the file back to coefficients."""
    return files(blocks_of(spark, sf_dir)).select("image", "width", "height", "sections", F.length("file").alias("bytes"), F.sha2("file", 256).alias("sha256"))


@query()
def bytes_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file into buffers of several sizes: status, bytes needed, and the bytes where they fit."""
    whole = files(blocks_of(spark, sf_dir)).withColumn("n", F.length("file"))
    tried = whole.withColumn("capacity", F.explode(F.array(F.lit(0), F.col("n") - 1, F.col("n"), F.col("n") + 1)))
    return tried.select("image", "capacity", *buffered(F.col("file"), F.col("capacity"))).drop("data")


def buffered(data, capacity) -> list:
    """status, needed, data: the file if the buffer holds it, else what it would take."""
    fits = F.length(data) <= capacity
    return [
        F.when(data.isNull(), "invalid-argument").when(fits, "ok").otherwise("buffer-too-small").alias("status"),
        F.coalesce(F.length(data), F.lit(0)).alias("needed"), F.when(fits, data).alias("data"),
    ]


@query()
def variable_dct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of the coefficients of each first block, by channel and side: of quantised coefficients in scan order, and of DC values."""
    rows = blocks_of(spark, sf_dir).select("image", "by", "bx", "side", F.posexplode(F.arrays_zip("q", "dc")).alias("c", "v"))
    energy = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    return rows.groupBy("image", "side", "c").agg(F.count(F.lit(1)).alias("blocks"), F.sum(energy("v.q")).alias("ac_energy"), F.sum(energy("v.dc")).alias("dc_energy"))


# Fields ---------------------------------------------------------------------------------------------------------------


def _option_sql(value: str, options: tuple[tuple[int, int], ...]) -> str:
    fits = [f"CASE WHEN {value} >= {o} AND {value} < {o + (1 << b)} THEN {b * 4 + i} END" for i, (b, o) in enumerate(options)]
    return f"list_min([{', '.join(fits)}])"


def option(value, options: tuple[tuple[int, int], ...]):
    """struct(selector, bits, rest) of the cheapest option that holds the value, the first of equals."""
    fits = F.array(*[F.when((value >= o) & (value < o + (1 << b)), b * 4 + i) for i, (b, o) in enumerate(options)])
    best = F.array_min(fits)
    offset = F.get(F.array(*[F.lit(o) for _, o in options]), best % 4)
    return F.struct((best % 4).alias("selector"), F.floor(best / 4).cast("int").alias("bits"), (value - offset).cast("long").alias("rest"))


_SIZES = _option_sql("n", codestream.SECTION_SIZE)


@query(
    f"""WITH s AS (SELECT doc_id, n, {_SIZES} AS best FROM (SELECT doc_id, CAST(n_chars * n_chars AS BIGINT) AS n FROM documents))
    SELECT doc_id, n, CAST(best % 4 AS INTEGER) AS selector, CAST(best // 4 AS INTEGER) AS bits, CAST(n - [{", ".join(str(o) for _, o in codestream.SECTION_SIZE)}][best % 4 + 1] AS BIGINT) AS rest FROM s"""
)
def section_size_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The option that a section's size is stored by (here: squares of lengths, which reach all four)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars").cast("long") * F.col("n_chars")).alias("n"))
    return rows.withColumn("o", option(F.col("n"), codestream.SECTION_SIZE)).select("doc_id", "n", "o.selector", "o.bits", "o.rest")


@query(
    """WITH v AS (SELECT vec_id, i, e, abs(e) AS a FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS e FROM embeddings) WHERE abs(e) >= 6.103515625e-05 AND abs(e) < 65536),
    x AS (SELECT *, CAST(floor(log2(a)) AS INTEGER) AS g FROM v),
    y AS (SELECT *, CASE WHEN pow(2e0, g) > a THEN g - 1 WHEN pow(2e0, g + 1) <= a THEN g + 1 ELSE g END AS p FROM x)
    SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(CASE WHEN e < 0 THEN 32768 ELSE 0 END + (p + 15) * 1024 + floor((a / pow(2e0, p) - 1) * 1024) AS INTEGER) AS half FROM y"""
)
def half_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half precision patterns of numbers in its normal range, the mantissa cut off."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "e"))
    return rows.where(F.abs("e").between(2.0**-14, np.nextafter(65536.0, 0))).select("vec_id", "i", half(F.col("e")).alias("half"))


def half(v):
    a = F.abs(v)
    guess = F.floor(F.log2(a))
    p = F.when(F.pow(F.lit(2.0), guess) > a, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= a, guess + 1).otherwise(guess)
    return (F.when(v < 0, 32768).otherwise(0) + (p + 15) * 1024 + F.floor((a / F.pow(F.lit(2.0), p) - 1) * 1024)).cast("int")


@query(
    """WITH runs AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CASE WHEN q < 16 THEN 0 ELSE CAST(floor(log2(q)) AS BIGINT) - 2 END + 5 AS bits FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem))
    SELECT l_suppkey, l_orderkey, l_linenumber, bits, CAST(coalesce(sum(bits) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
      CAST((sum(bits) OVER (PARTITION BY l_suppkey) + 7) // 8 AS BIGINT) AS group_bytes FROM runs"""
)
def run_bit_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit offset of each run in its group, and the group's bytes: runs of a symbol of five bits and raw bits, scanned in two levels."""
    q = F.col("l_quantity").cast("long")
    bits = F.when(q < 16, 0).otherwise(F.length(F.bin(q)) - 3).cast("long") + 5
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", bits.alias("bits"))
    scanned = scan_large(rows, "bits", ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], F.floor(F.col("l_orderkey") / CHUNK), "start", "total")
    return scanned.select("l_suppkey", "l_orderkey", "l_linenumber", "bits", "start", F.floor((F.col("total") + 7) / 8).alias("group_bytes"))
