"""Documents and text tables that other tools and people read. Each is one small file by nature: some rows per image or setting."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.analysis import CONSTRAINTS
from ..plans.corpus import MAX_HEIGHT, MAX_WIDTH, MIN_HEIGHT, MIN_WIDTH
from ..functions.text import EXTENSIONS

#: Fields of a frame corpus. Fixed values.
CORPUS = {"chroma": "420", "colorspace": "bt709", "format": "nv12", "range": "full"}


def put(spark: SparkSession, path: str, text: str) -> None:
    """A text file at a path of any file system, whole or not at all."""
    jvm = spark.sparkContext._jvm
    place, part = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".part"))
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(place, False)
    fs.rename(part, place)


def today() -> str:
    return datetime.date.today().isoformat()


def _rows(df: DataFrame, *order: str) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]


def sources_document(records: DataFrame, category: str, generated: str | None = None, limit: int | None = None) -> dict:
    """The files found, by name, with the constraints they satisfy."""
    files = _rows(records, "name")[:limit]
    limits = {"category": category, "min_width": MIN_WIDTH, "min_height": MIN_HEIGHT, "max_width": MAX_WIDTH, "max_height": MAX_HEIGHT, "mimes": list(EXTENSIONS)}
    return {"generated": generated or today(), "constraints": limits, "files": files}


def manifest_document(assets: DataFrame, sources: dict | None = None, versions: dict | None = None) -> dict:
    extra = {k: v for k, v in (("sources", sources), ("versions", versions)) if v is not None}
    return CORPUS | extra | {"assets": _rows(assets, "name")}


def budget_document(stages: list[dict]) -> dict:
    """Stage records with the rate that their times allow; 0 without any time."""
    total = sum(s["gpu_us"] + s["cpu_us"] for s in stages)
    return {"fps": 1e6 / total if total > 0 else 0.0, "projection": {"gpu_time": 1.0, "cpu_time": 1.0, "bandwidth": 1.0}, "stages": stages}


def comparison_document(pairs: list[tuple[dict, dict]]) -> list[dict]:
    """Timings (other codec, own codec) with the other's mean time as a multiple of the own."""
    return [{"other": a, "own": b, "speedup": a["mean_us"] / b["mean_us"]} for a, b in pairs]


def write_json(spark: SparkSession, path: str, document: object, sort_keys: bool = False) -> None:
    put(spark, path, json.dumps(document, indent=2, ensure_ascii=False, sort_keys=sort_keys) + "\n")


def write_sweep(rows: DataFrame, path: str) -> None:
    """Sweep rows as one JSON array."""
    write_json(rows.sparkSession, path, _rows(rows, "resolution", "image", "codec", "param"))


def write_attributions(entries: DataFrame, path: str) -> None:
    """One line per file by name: who made it, its licence and page."""
    who = F.coalesce(F.nullif("author", F.lit("")), F.lit("uncredited"))
    lines = entries.orderBy("name").select(F.format_string("%s: %s, %s, %s", "name", who, "license", "page").alias("line"))
    put(entries.sparkSession, path, "\n".join(r.line for r in lines.collect()) + "\n")


# Text tables ----------------------------------------------------------------------------------------------------------


def fixed(value: Column, decimals: int, width: int) -> Column:
    """A number with decimals, right-aligned; never cut."""
    text = F.format_string(f"%.{decimals}f", value)
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit(" "))


def left(value: Column, width: int) -> Column:
    return F.rpad(value, F.greatest(F.length(value), F.lit(width)), F.lit(" "))


def sweep_line() -> Column:
    """A line of the sweep's table."""
    cells = [
        left(F.substring("image", 1, 22), 22), left(F.col("codec"), 9), left(F.col("param"), 8), F.lpad(F.col("coded_bytes").cast("string"), F.greatest(F.length(F.col("coded_bytes").cast("string")), F.lit(10)), F.lit(" ")),
        fixed(F.col("bpp"), 2, 6), fixed(F.col("ratio"), 1, 6), fixed(F.col("psnr"), 2, 6), fixed(F.col("butteraugli"), 3, 7), fixed(F.col("ssimulacra2"), 2, 7),
    ]
    return F.concat_ws(" ", *cells)


SWEEP_HEAD = f"{'image':<22} {'codec':<9} {'param':<8} {'bytes':>10} {'bpp':>6} {'ratio':>6} {'psnr':>6} {'butter':>7} {'ssim2':>7}"


def sweep_table(rows: DataFrame) -> str:
    lines = [r.line for r in rows.select("image", "codec", "param", sweep_line().alias("line")).orderBy("image", "codec", "param").collect()]
    return "\n".join([SWEEP_HEAD, "-" * len(SWEEP_HEAD), *lines])


def text_table(head: list[str], rows: list[list[str]]) -> str:
    """Columns as wide as their longest cell, two spaces apart."""
    wide = [max(map(len, column)) for column in zip(head, *rows, strict=True)]
    return "\n".join("  ".join(c.ljust(n) for c, n in zip(r, wide, strict=True)) for r in [head, *rows])


def budget_table(checked: DataFrame) -> str:
    """Lines of constraints (name, value, limit_value, passed) and the verdict over all."""
    units = {"dram_bandwidth": "B/s", "sm_time": "fraction", "cpu_cores": "cores", "throughput": "fps"}
    at_least = {n for n, _, least in CONSTRAINTS if least}
    rows = {r.name: r for r in checked.collect()}
    wide = max(map(len, rows))
    mark = lambda ok: "PASS" if ok else "FAIL"
    lines = [f"[{mark(rows[n].passed)}] {n:<{wide}}  {rows[n].value:.4g} {'>=' if n in at_least else '<='} {rows[n].limit_value:.4g} {units[n]}" for n, *_ in CONSTRAINTS if n in rows]
    return "\n".join([*lines, f"overall: {mark(all(r.passed for r in rows.values()))}"])


def comparison_table(pairs: list[tuple[dict, dict]]) -> str:
    """Two lines of timings a pair, and which is faster by what factor."""
    head = f"{'codec':9} {'setting':8} {'mean_us':>9} {'p50_us':>9} {'p99_us':>9} {'fps':>7} {'MP/s':>8}"
    lines = [head, "-" * len(head)]
    for other, own in pairs:
        lines += [f"{s['codec']:9} {s['setting']:8} {s['mean_us']:9.0f} {s['p50_us']:9.0f} {s['p99_us']:9.0f} {s['fps']:7.1f} {s['megapixels_per_s']:8.1f}" for s in (other, own)]
        ratio = other["mean_us"] / own["mean_us"] if own["mean_us"] > 0 else float("nan")
        winner, factor = (own, ratio) if ratio >= 1 else (other, 1 / ratio)
        lines += [f"  -> {other['setting']} vs {own['setting']}: {winner['codec']} faster by {factor:.2f}x", ""]
    return "\n".join(lines).rstrip()


# Plots ----------------------------------------------------------------------------------------------------------------

#: Colours of curves in order. Fixed values.
COLOURS = ("#1b6ca8", "#c8553d", "#3a7d44", "#7b5ea7", "#8a6d1d", "#4a4e69")


def curves_svg(rows: list[dict], title: str, x: str = "bpp_mean", y: str = "q_mean", spread: str = "q_std", size: tuple[int, int] = (720, 440)) -> str:
    """A curve per codec through its means in the order of param_value, with bars of the spread: rows of ``rd_mean_curve`` of one metric."""
    from xml.sax.saxutils import escape

    w, h = size
    left, right, top, bottom = 64, w - 20, 36, h - 48
    lows, highs = [r[y] - r[spread] for r in rows], [r[y] + r[spread] for r in rows]
    x0, x1 = (min((r[x] for r in rows), default=0.0), max((r[x] for r in rows), default=1.0))
    y0, y1 = min(lows, default=0.0), max(highs, default=1.0)
    at = lambda v, a, b, low, high: low + (high - low) * ((v - a) / (b - a) if b > a else 0.5)
    px = lambda v: f"{at(v, x0, x1, left + 8, right - 8):.1f}"
    py = lambda v: f"{at(v, y0, y1, bottom - 8, top + 8):.1f}"
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}" font-family="sans-serif" font-size="12"><rect width="{w}" height="{h}" fill="white"/>']
    out.append(f'<text x="{left}" y="22" font-size="15">{escape(title)}</text><path d="M{left} {top}V{bottom}H{right}" fill="none" stroke="#555"/>')
    for k in range(5):
        u, v = x0 + (x1 - x0) * k / 4, y0 + (y1 - y0) * k / 4
        out.append(f'<text x="{px(u)}" y="{bottom + 18}" text-anchor="middle">{u:.3g}</text><text x="{left - 6}" y="{py(v)}" text-anchor="end">{v:.3g}</text>')
    out.append(f'<text x="{(left + right) / 2}" y="{h - 10}" text-anchor="middle">{escape(x)}</text>')
    for i, codec in enumerate(sorted({r["codec"] for r in rows})):
        own = sorted((r for r in rows if r["codec"] == codec), key=lambda r: r["param_value"])
        colour = COLOURS[i % len(COLOURS)]
        out.append(f'<polyline fill="none" stroke="{colour}" stroke-width="2" points="{" ".join(f"{px(r[x])},{py(r[y])}" for r in own)}"/>')
        out += [f'<path d="M{px(r[x])} {py(r[y] - r[spread])}V{py(r[y] + r[spread])}" stroke="{colour}"/><circle cx="{px(r[x])}" cy="{py(r[y])}" r="3" fill="{colour}"/>' for r in own]
        out.append(f'<text x="{right - 90}" y="{top + 16 * (i + 1)}" fill="{colour}">{escape(str(codec))}</text>')
    return "".join(out) + "</svg>"


def write_plots(curves: DataFrame, folder: str) -> list[str]:
    """A drawing per metric of rows (codec, metric, param_value, means and spreads): some dozens of rows each."""
    by_metric: dict[str, list[dict]] = {}
    for r in _rows(curves, "metric", "codec", "param_value"):
        by_metric.setdefault(r["metric"], []).append(r)
    for metric, rows in by_metric.items():
        put(curves.sparkSession, f"{folder}/{metric}.svg", curves_svg(rows, metric))
    return [f"{folder}/{m}.svg" for m in sorted(by_metric)]
