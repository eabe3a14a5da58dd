"""Prediction, tokens, histograms, prefix codes and packing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..functions.symbols import cluster, hybrid, pack_signed
from ..operators import huffman, tokens
from ..operators.codestream import CONTAINER_HEADER
from ..operators.windows import CHUNK, exclusive_scan, move_to_front, scan_large
from ..registry import query, table
from .codec import DC_SQL, QUANT_SQL, dc_grid, dc_residuals, quantized_blocks

_PACK = "CASE WHEN {v} >= 0 THEN 2 * {v} ELSE -2 * {v} - 1 END"


def _symbol(n: str) -> str:
    return f"CASE WHEN {n} < 16 THEN {n} ELSE 16 + 4 * (length(bin({n})) - 5) + (({n} >> (length(bin({n})) - 3)) & 3) END"


def _nbits(n: str) -> str:
    return f"CASE WHEN {n} < 16 THEN 0 ELSE length(bin({n})) - 3 END"


def block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block view as first blocks of one channel (Y), eight side by side."""
    return quantized_blocks(spark, sf_dir).select(F.lit("frame").alias("image"), "by", "bx", F.lit(1).alias("c"), F.lit(8).alias("side"), "scanned")


_LINES = "lines AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 7, 0) AS BIGINT) % 5000 - 2500 AS v FROM lineitem), numbers AS (SELECT *, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS n FROM lines)"


@query(f"WITH {_LINES} SELECT symbol, count(*) AS n, CAST(sum(nbits) AS BIGINT) AS raw_bits FROM (SELECT {_symbol('n')} AS symbol, {_nbits('n')} AS nbits FROM numbers) GROUP BY symbol")
def hybrid_uint_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.round(F.col("l_extendedprice") * 7, 0).cast("long") % 5000 - 2500
    rows = table(spark, sf_dir, "lineitem").select(hybrid(pack_signed(v)).alias("h"))
    return rows.groupBy("h.symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("h.nbits").cast("long").alias("raw_bits"))


@query(
    "WITH" + DC_SQL + f""", numbers AS (SELECT g, {_PACK.format(v='residual')} AS n FROM residuals)
    SELECT g, symbol, count(*) AS n FROM (SELECT g, {_symbol('n')} AS symbol FROM numbers) GROUP BY g, symbol"""
)
def dc_group_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dc_residuals(dc_grid(spark, sf_dir), ["g"]).select("g", hybrid(pack_signed(F.col("residual")))["symbol"].alias("symbol"))
    return rows.groupBy("g", "symbol").agg(F.count(F.lit(1)).alias("n"))


_GRID_SQL = (
    QUANT_SQL
    + """,
counts AS (SELECT by_, bx, count(*) FILTER (WHERE q <> 0 AND k > 0)::INTEGER AS nz FROM scanned GROUP BY ALL),
near AS (SELECT *, lag(nz) OVER (PARTITION BY by_, bx // 32 ORDER BY bx) AS l, lag(nz) OVER (PARTITION BY bx, by_ // 32 ORDER BY by_) AS t FROM counts),
predicted AS (SELECT by_, bx, nz, CAST(coalesce((t + l + 1) // 2, t, l, 32) AS INTEGER) AS predicted FROM near)"""
)


@query("WITH" + _GRID_SQL + " SELECT by_, bx, nz AS norm FROM counts")
def nz_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.nonzero_grid(block_rows(spark, sf_dir)).select(F.col("by").alias("by_"), "bx", "norm")


@query("WITH" + _GRID_SQL + " SELECT * FROM predicted")
def nz_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.predicted(tokens.nonzero_grid(block_rows(spark, sf_dir))).select(F.col("by").alias("by_"), "bx", "nz", "predicted")


_FREQ = "[" + ", ".join(map(str, tables.FREQUENCY_CONTEXTS)) + "]"
_NZC = "[" + ", ".join(map(str, tables.NONZERO_CONTEXTS)) + "]"


def _band_sql(v: str, limits: tuple[int, ...]) -> str:
    return "CASE " + " ".join(f"WHEN {v} < {x} THEN {i}" for i, x in enumerate(limits)) + f" ELSE {len(limits)} END"


def _cluster_sql(c: str) -> str:
    count = f"CASE WHEN {c} % 15 < 7 THEN 0 ELSE 4 END + {_band_sql(f'({c} // 15)', tables.COUNT_BANDS)}"
    density = f"8 + CASE WHEN ({c} - 555) // 458 < 7 THEN 0 ELSE 12 END + {_band_sql(f'(({c} - 555) % 458)', tables.DENSITY_BANDS)}"
    return f"CASE WHEN {c} < 555 THEN {count} ELSE {density} END"


_TOKENS_SQL = (
    _GRID_SQL
    + f""",
cells AS (SELECT s.by_, s.bx, s.k, s.q, p.nz, p.nz - coalesce(count(*) FILTER (WHERE s.q <> 0) OVER (PARTITION BY s.by_, s.bx ORDER BY s.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  coalesce(lag(CASE WHEN s.q <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY s.by_, s.bx ORDER BY s.k), CASE WHEN p.nz > 4 THEN 0 ELSE 1 END) AS prev
  FROM scanned s JOIN predicted p USING (by_, bx) WHERE s.k > 0),
numbers AS (
  SELECT by_, bx, -1 AS k, (CASE WHEN least(predicted, 64) < 8 THEN least(predicted, 64) ELSE 4 + least(predicted, 64) // 2 END) * 15 AS context, nz AS n FROM predicted UNION ALL
  SELECT by_, bx, k, 555 + ({_NZC}[rest + 1] + {_FREQ}[k + 1]) * 2 + prev, {_PACK.format(v='q')} FROM cells WHERE rest > 0),
tokens AS (SELECT by_, bx, k, CAST(context AS INTEGER) AS context, {_symbol('n')} AS symbol, {_nbits('n')} AS nbits FROM numbers)"""
)


@query("WITH" + _TOKENS_SQL + f" SELECT by_, bx, k, context, CAST({_cluster_sql('context')} AS INTEGER) AS cluster, CAST(symbol AS INTEGER) AS symbol, CAST(nbits AS INTEGER) AS nbits FROM tokens")
def ac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenize(block_rows(spark, sf_dir)).select(F.col("by").alias("by_"), "bx", "k", "context", "cluster", "symbol", "nbits")


@query("WITH" + _TOKENS_SQL + f" SELECT CAST({_cluster_sql('context')} AS INTEGER) AS cluster, CAST(symbol AS INTEGER) AS symbol, count(*) AS n FROM tokens GROUP BY ALL")
def ac_cluster_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial counts before the exchange, merged after it."""
    return tokens.tokenize(block_rows(spark, sf_dir)).groupBy("cluster", "symbol").agg(F.count(F.lit(1)).alias("n"))


@query("WITH" + _TOKENS_SQL + f" SELECT CAST({_cluster_sql('context')} AS INTEGER) AS cluster, CAST(max(symbol) + 1 AS INTEGER) AS alphabet, count(*) AS n FROM tokens GROUP BY ALL")
def alphabet_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ac_cluster_histogram(spark, sf_dir).groupBy("cluster").agg((F.max("symbol") + 1).alias("alphabet"), F.sum("n").alias("n"))


@query(f"SELECT CAST(c AS INTEGER) AS context, CAST({_cluster_sql('c')} AS INTEGER) AS cluster FROM range(7425) t(c)")
def context_cluster_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(tables.CONTEXT_COUNT).select(F.col("id").cast("int").alias("context"), cluster(F.col("id")).alias("cluster"))


@query(
    """WITH seq AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    last AS (SELECT a.user_id, a.i, a.event_id, a.v, v.u, max(b.i) AS seen FROM seq a CROSS JOIN (SELECT unnest(range(5)) AS u) v LEFT JOIN seq b ON b.user_id = a.user_id AND b.v = v.u AND b.i < a.i GROUP BY ALL)
    SELECT x.event_id, CAST(x.v AS INTEGER) AS v, CAST(count(*) FILTER (WHERE y.u <> x.v AND (coalesce(y.seen, -y.u - 1) > coalesce(x.seen, -x.u - 1))) AS INTEGER) AS code
    FROM last x JOIN last y ON y.user_id = x.user_id AND y.i = x.i WHERE x.u = x.v GROUP BY x.event_id, x.v"""
)
def mtf_context_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Move-to-front codes of each user's event kinds."""
    kinds = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    place = F.array_position(kinds, F.col("event_type")) - 1
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(place >= 0, place).otherwise(4).cast("int").alias("v"))
    return move_to_front(rows, ["user_id"], "event_id", "v", 5, F.floor(F.col("event_id") / CHUNK)).select("event_id", "v", "code")


@query(
    """SELECT l_suppkey, l_orderkey, l_linenumber, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
    CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_suppkey) AS BIGINT) AS total FROM lineitem"""
)
def group_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start of each section within its group, and the group's size."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("bytes"))
    scanned = scan_large(rows, "bytes", ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], F.floor(F.col("l_orderkey") / CHUNK), "start", "total")
    return scanned.select("l_suppkey", "l_orderkey", "l_linenumber", "start", "total")


def codes(histogram: DataFrame, by: str = "cluster") -> DataFrame:
    """(by, symbol, depth, code) from (by, symbol, n): one prefix code per group of at most a few hundred symbols."""
    kind = dict(histogram.dtypes)[by]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        depth = huffman.depths(dict(zip(pdf["symbol"].tolist(), pdf["n"].tolist(), strict=True)))
        code = huffman.canonical(depth)
        symbols = sorted(depth)
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(symbols), "symbol": symbols, "depth": [depth[s] for s in symbols], "code": [code[s] for s in symbols]})

    return histogram.select(by, "symbol", "n").groupBy(by).applyInPandas(build, f"`{by}` {kind}, symbol int, depth int, code int")


@query()
def huffman_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes(ac_cluster_histogram(spark, sf_dir))


def pack_groups(coded: DataFrame, table_: DataFrame) -> DataFrame:
    """(image, gy, gx, n_tokens, n_bits, data) from tokens and codes. A group is at most 32 x 32 blocks of three channels, so it fits a task."""
    joined = coded.join(F.broadcast(table_), ["cluster", "symbol"])  # at most 32 clusters of a few hundred symbols

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["by", "bx", "p", "k"])
        w = huffman.BitWriter()
        for depth, code, nbits, bits in pdf[["depth", "code", "nbits", "bits"]].itertuples(index=False):
            w.put(depth, code)
            w.put(nbits, bits)
        n = int(pdf["depth"].sum() + pdf["nbits"].sum())
        return pd.DataFrame({"image": [pdf["image"].iloc[0]], "gy": [int(pdf["gy"].iloc[0])], "gx": [int(pdf["gx"].iloc[0])], "n_tokens": [len(pdf)], "n_bits": [n], "data": [w.bytes()]})

    place = F.when(F.col("c") == 1, 0).when(F.col("c") == 0, 1).otherwise(2)  # channels are coded Y, X, B
    return joined.withColumn("p", place).groupBy("image", "gy", "gx").applyInPandas(pack, "image string, gy long, gx long, n_tokens long, n_bits long, data binary")


@query()
def ac_group_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed sections with their offsets. Tokens are made twice (histogram, packing), which needs no copy of them that someone must release."""
    coded = tokens.tokenize(block_rows(spark, sf_dir))
    packed = pack_groups(coded, codes(coded.groupBy("cluster", "symbol").agg(F.count(F.lit(1)).alias("n"))))
    sized = packed.withColumn("size", F.length("data"))
    return sized.select("image", "gy", "gx", "n_tokens", "n_bits", F.sha2("data", 256).alias("sha256"), exclusive_scan("size", ["image"], ["gy", "gx"]).alias("start"), "size")


@query(
    """SELECT doc_id, concat('0000000c4a584c200d0a870a00000014667479706a786c20000000006a786c20', lpad(lower(to_hex(strlen(text) + 8)), 8, '0'), '6a786c63') AS head, 40 + strlen(text) AS bytes FROM documents"""
)
def container_framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes before a codestream (here: a text's bytes); 64-bit sizes from 2^32 - 8 bytes on."""
    n = F.octet_length("text").cast("long")
    small = F.concat(F.lpad(F.hex(n + 8), 8, "0"), F.lit("6A786C63"))
    large = F.concat(F.lit("00000001" + "6A786C63"), F.lpad(F.hex(n + 16), 16, "0"))
    head = F.lower(F.concat(F.lit(CONTAINER_HEADER.hex()), F.when(n >= (1 << 32) - 8, large).otherwise(small)))
    return table(spark, sf_dir, "documents").select("doc_id", head.alias("head"), (F.length(head) / 2 + n).cast("long").alias("bytes"))
