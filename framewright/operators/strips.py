"""Frames in strips: the unit of work of everything that needs neighbouring pixels.

A strip is 64 pixel rows of one image with a halo of three rows, so colour tiles, selection regions and erosion tiles
never cross it. A scanline goes to its own strip and, near an edge, to the neighbour's: one shuffle by (image, strip),
after which stencils, transforms, selection, regression and quantisation need no other rows. A strip's size depends on
the image's width alone. The kernels are numpy in double precision: a 21-candidate transform search per region is
matrix work that array expressions would interpret cell by cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables
from ..params import calibrate, field_params

STRIP, HALO = 64, 3

# Colour conversion and sharpening.
CR_R, CB_G, CR_G, CB_B = 1.5748, 0.1873242729, 0.4681242729, 1.8556
MIX = np.array([[0.30, 0.622, 0.078], [0.23, 0.692, 0.078], [0.24342268924547819, 0.20476744424496821, 1 - 0.24342268924547819 - 0.20476744424496821]])
BIAS = 0.0037930732552754493
SHARPEN = {"r": -0.09495815671340026, "d": -0.041031725066768575, "R": 0.013710004822696948, "L": 0.006510206083837737, "D": -0.0014789063378272242}
# Masking.
GAMMA_MUL, GAMMA_MUL2, LOG2, GAMMA_OFFSET = 226.77216153508914, 1 / 73.377132366608819, 0.693147181, 7.7825991679894591
MATCH_OFFSET, DIFF_LIMIT = 0.019, 0.2
SQRT_OFFSET, SQRT_MUL = 27.505837037000106, 211.66567973503678e8
LAMBDA, EPS = 6e-4, 1e-6


def upsample(plane: np.ndarray, rows: np.ndarray, first: int, height: int, width: int) -> np.ndarray:
    """Chroma at luma rows; plane holds chroma rows from ``first`` on. Three quarters own cell, one quarter the nearer neighbour."""

    def taps(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        own = at // 2
        return own, np.clip(own + np.where(at % 2 == 0, -1, 1), 0, size - 1)

    own, other = taps(rows, height // 2)
    tall = 0.75 * plane[own - first] + 0.25 * plane[other - first]
    own, other = taps(np.arange(width), width // 2)
    return 0.75 * tall[:, own] + 0.25 * tall[:, other]


def to_xyb(luma: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """(3, rows, width) opponent planes X, Y, B of full-range samples."""
    y, b, r = luma / 255, (cb - 128) / 255, (cr - 128) / 255
    rgb = np.clip(np.stack([y + CR_R * r, y - CB_G * b - CR_G * r, y + CB_B * b]), 0, 1)
    linear = np.where(rgb <= 0.04045, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4)
    lms = np.cbrt(np.maximum(np.tensordot(MIX, np.clip(linear, 0, 1), 1) + BIAS, 0)) - np.cbrt(BIAS)
    return np.stack([(lms[0] - lms[1]) / 2, (lms[0] + lms[1]) / 2, lms[2]])


def sharpen(p: np.ndarray, rows: np.ndarray, first: int, height: int) -> np.ndarray:
    """5x5 symmetric sharpening at ``rows`` of planes that begin at row ``first``; edges are clamped."""
    width = p.shape[-1]
    weight = {(1, 0): "r", (1, 1): "d", (2, 0): "R", (2, 1): "L", (2, 2): "D"}
    total = 1 + 4 * (SHARPEN["r"] + SHARPEN["d"] + SHARPEN["R"] + SHARPEN["D"] + 2 * SHARPEN["L"])
    out = np.zeros((p.shape[0], len(rows), width))
    columns = np.arange(width)
    for dy in range(-2, 3):
        for dx in range(-2, 3):
            a, b = max(abs(dy), abs(dx)), min(abs(dy), abs(dx))
            w = 1.0 if not a else SHARPEN[weight[a, b]]
            out += w / total * p[:, np.clip(rows + dy, 0, height - 1) - first][:, :, np.clip(columns + dx, 0, width - 1)]
    return out


def gamma_ratio(v: np.ndarray, invert: bool) -> np.ndarray:
    v = np.maximum(v, 0)
    num = GAMMA_MUL2 * 18.6580932135 * LOG2 * 3 * GAMMA_MUL * v * v + 1e-2
    den = LOG2 * GAMMA_MUL * v**3 + GAMMA_OFFSET * LOG2 + 1e-2
    return num / den if invert else den / num


def mask_of(v: np.ndarray) -> np.ndarray:
    v1 = np.maximum(v * 0.80061762862741759, 1e-3)
    return -0.7647 + 9.4708735624378946 / (v1 * v1 + 0.25 * 3.7179635626140772) + 17.35036561631863 / (v1 + 302.59587815579727) + 6.7943250517376494 / (v1 * v1 + 3.7179635626140772)


def pre_erosion(y: np.ndarray, tops: np.ndarray, first: int, height: int, cells: int) -> np.ndarray:
    """Quarter sums of masked differences over 4x4 cells whose first rows are ``tops``."""
    width = y.shape[1]
    rows, columns = (tops[:, None] + np.arange(4)).ravel(), np.arange(4 * cells)
    at = lambda r, c: y[np.clip(r, 0, height - 1) - first][:, np.clip(c, 0, width - 1)]
    own = at(rows, columns)
    # a cell beyond the image repeats its edge, and so do its neighbours
    base = 0.25 * (at(rows + 1, columns) + at(rows - 1, columns) + at(rows, columns - 1) + at(rows, columns + 1))
    diff = np.minimum((gamma_ratio(own + MATCH_OFFSET, False) * (own - base)) ** 2, DIFF_LIMIT)
    root = 0.25 * np.sqrt(diff * np.sqrt(SQRT_MUL) + SQRT_OFFSET)
    return 0.25 * root.reshape(len(tops), 4, cells, 4).sum((1, 3))


def erode(pre: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    """Weighted sum of the four smallest of 3x3 cells, clamped to tiles of 8x8 cells (the shape is a multiple of 8)."""
    h, w = pre.shape
    t = pre.reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2)
    padded = np.pad(t, ((0, 0), (0, 0), (1, 1), (1, 1)), mode="edge")
    near = np.stack([padded[:, :, dy : dy + 8, dx : dx + 8] for dy in range(3) for dx in range(3)])
    low = np.sort(near, 0)[:4]
    return np.tensordot(np.array(weights), low, 1).swapaxes(1, 2).reshape(h, w)


def quant_field(xyb: np.ndarray, eroded: np.ndarray, distance: float) -> np.ndarray:
    """Integer field of 8x8 blocks from unsharpened planes (rows and columns multiples of 8) and eroded cells of at least that extent."""
    fp, cal = field_params(distance), calibrate(distance)
    bh, bw = xyb.shape[1] // 8, xyb.shape[2] // 8
    tiles = xyb.reshape(3, bh, 8, bw, 8).swapaxes(2, 3)
    x, y, b = tiles
    hf = np.minimum(0.0206, np.abs(np.diff(y, axis=3))).sum((2, 3)) + np.minimum(0.0206, np.abs(np.diff(y, axis=2))).sum((2, 3))
    gamma = (gamma_ratio(y + 0.16 - x, True) + gamma_ratio(y + 0.16 + x, True)).sum((2, 3)) * (0.5 / 64)
    limit = 0.027121074570634722
    over = b - (y + 0.084381641171960495 + np.abs(x))
    blue = np.where(over > 0, np.minimum(over, limit), 0).sum((2, 3))
    blue = np.where(blue >= 32 * limit, 64 * limit - blue, blue)
    blue = np.minimum(blue, 15.398788439047934 * limit)
    aq = eroded[: 2 * bh, : 2 * bw].reshape(bh, 2, bw, 2).sum((1, 3))
    value = mask_of(aq) + hf * -0.38 + 0.42 + 0.1005613337192697 * np.log2(gamma) + blue * 0.14207000358439159
    return np.clip(np.floor((np.exp(value) * fp.mul + fp.add) * cal.inverse_scale + 0.5), 1, 256).astype(int)


def transform(block: np.ndarray) -> np.ndarray:
    """[fx, fy] coefficients of a square raster block."""
    basis = tables.dct_basis(len(block))
    return basis @ block.T @ basis.T


def cost(block: np.ndarray, strength: float) -> float:
    """Rate/distortion proxy of one transform block; the low-frequency corner goes with the DC."""
    n = len(block)
    c = transform(block)
    f = np.minimum(np.floor(np.arange(n) * 8 / n + 0.5).astype(int), 7)
    w = tables.dequant(8, 1).reshape(8, 8)[f][:, f]
    q = np.rint(c * strength / w)
    keep = np.ones((n, n), bool)
    keep[: n // 8, : n // 8] = False
    error = ((q * w / strength - c) ** 2)[keep].sum()
    rate = (1 + np.log2(1 + np.abs(q[keep & (q != 0)]))).sum()
    return n * n * error + LAMBDA * rate


def select(y: np.ndarray, strength: float) -> tuple[np.ndarray, dict[tuple[int, int, int], float]]:
    """Sides of first blocks (0: covered) by regions of 4x4 blocks, and the costs (side, by, bx) that were compared."""
    bh, bw = y.shape[0] // 8, y.shape[1] // 8
    side = np.zeros((bh, bw), int)
    costs: dict[tuple[int, int, int], float] = {}

    def price(n: int, by: int, bx: int) -> float:
        costs[n, by, bx] = cost(y[by * 8 : by * 8 + n, bx * 8 : bx * 8 + n], strength)
        return costs[n, by, bx]

    for ry in range(0, bh, 4):
        for rx in range(0, bw, 4):
            chosen, total = {}, 0.0
            for by in (ry, ry + 2):
                for bx in (rx, rx + 2):
                    inner = [(a, b) for a in (by, by + 1) for b in (bx, bx + 1) if a < bh and b < bw]
                    if not inner:
                        continue
                    small = sum(price(8, a, b) for a, b in inner)
                    large = price(16, by, bx) if len(inner) == 4 else np.inf
                    if large <= small + EPS:
                        chosen[by, bx] = 16
                        total += large
                    else:
                        chosen.update(dict.fromkeys(inner, 8))
                        total += small
            if ry + 4 <= bh and rx + 4 <= bw and price(32, ry, rx) <= total + EPS:
                chosen = {(ry, rx): 32}
            for (a, b), n in chosen.items():
                side[a, b] = n
    return side, costs


def dc_of(corner: np.ndarray) -> np.ndarray:
    """DC values [row, column] of the covered blocks from the low-frequency corner [fx, fy]."""
    m = len(corner)
    k, t = np.arange(m)[:, None], np.arange(m)[None, :]
    ortho = np.sqrt(np.where(k == 0, 1, 2) / m) * np.cos(np.pi * (t + 0.5) * k / m)
    scale = np.array(tables.RESAMPLE[m])
    return m * (ortho.T @ (corner * scale[:, None] * scale[None, :]) @ ortho).T


def half_even(v: np.ndarray) -> np.ndarray:
    return np.rint(np.round(v, 9)).astype(int)


def encode_strip(xyb: np.ndarray, sharp: np.ndarray, field: np.ndarray, distance: float) -> list[dict]:
    """First blocks of a strip with sides, colour factors, quantised coefficients in scan order and DC values."""
    cal = calibrate(distance)
    side, _ = select(sharp[1], cal.uniform)
    firsts = [(int(a), int(b), int(side[a, b])) for a, b in zip(*np.nonzero(side), strict=True)]
    coeff = {(a, b): np.stack([transform(p[a * 8 : a * 8 + n, b * 8 : b * 8 + n]) for p in sharp]) for a, b, n in firsts}
    sums: dict[tuple[int, int], np.ndarray] = {}
    for a, b, n in firsts:
        keep = np.ones((n, n), bool)
        keep[: n // 8, : n // 8] = False
        x, y, bl = (c[keep] for c in coeff[a, b])
        sums[a // 8, b // 8] = sums.get((a // 8, b // 8), np.zeros(3)) + np.array([(x * y).sum(), (y * y).sum(), ((bl - tables.BASE_B * y) * y).sum()])
    factor = {t: tuple(int(np.clip(half_even(np.array(s[i] / s[1] if s[1] > 0 else 0.0) * tables.COLOR_FACTOR), -128, 127)) for i in (0, 2)) for t, s in sums.items()}
    out = []
    for a, b, n in firsts:
        m = n // 8
        to_x, to_b = factor[a // 8, b // 8]
        strength = field[a, b] * cal.scale
        w = [tables.dequant(n, c).reshape(n, n) for c in range(3)]
        cx, cy, cb = coeff[a, b]
        q = np.zeros((3, n, n), int)
        q[1] = half_even(cy * strength / w[1])
        back = q[1] * w[1] / strength
        q[0] = half_even((cx - to_x / tables.COLOR_FACTOR * back) * strength / w[0])
        q[2] = half_even((cb - (tables.BASE_B + to_b / tables.COLOR_FACTOR) * back) * strength / w[2])
        q[:, :m, :m] = 0
        step = np.array(tables.DC_INVERSE) * cal.dc_scale
        dx, dy, db = (dc_of(c[:m, :m]) for c in (cx, cy, cb))
        qy = half_even(dy * step[1])
        dc = np.stack([half_even(dx * step[0]), qy, half_even((db - tables.BASE_B * qy / step[1]) * step[2])])
        order = tables.scan_order(n)
        out.append({"by": a, "bx": b, "side": n, "qf": int(field[a, b]), "ytox": to_x, "ytob": to_b, "q": q.reshape(3, -1)[:, order].tolist(), "dc": dc.reshape(3, -1).tolist()})
    return out


def assemble(luma: DataFrame, chroma: DataFrame) -> DataFrame:
    """Rows (image, strip, height, y, luma, cb, cr): every scanline with the strips that need it; chroma lines have luma null."""
    size = luma.groupBy("image").agg((F.max("y") + 1).alias("height"))
    lines = luma.join(size, "image")
    strips = lambda low, high: F.sequence(F.greatest(F.floor(low / STRIP), F.lit(0)).cast("int"), F.floor(high / STRIP).cast("int"))
    none = F.lit(None).cast("array<int>")
    a = lines.select("image", "height", F.explode(strips(F.col("y") - HALO, F.col("y") + HALO)).alias("strip"), "y", "luma", none.alias("cb"), none.alias("cr"))
    near = chroma.join(size, "image").select("image", "height", F.explode(strips(2 * F.col("cy") - HALO - 2, 2 * F.col("cy") + HALO + 3)).alias("strip"), F.col("cy").alias("y"), none.alias("luma"), "cb", "cr")
    return a.unionByName(near).where(F.col("strip") * STRIP < F.col("height"))


def planes_of(pdf: pd.DataFrame) -> tuple[str, int, int, int, np.ndarray, np.ndarray]:
    """image, strip, height, first row held, rows of the strip, XYB planes with halo."""
    image, strip, height = str(pdf["image"].iloc[0]), int(pdf["strip"].iloc[0]), int(pdf["height"].iloc[0])
    luma = pdf[pdf["luma"].notna()].sort_values("y")
    chroma = pdf[pdf["luma"].isna()].sort_values("y")
    rows = luma["y"].to_numpy()
    samples = np.stack(luma["luma"].to_list()).astype(float)
    width = samples.shape[1]
    first = int(chroma["y"].iloc[0])
    cb, cr = (upsample(np.stack(chroma[c].to_list()).astype(float), rows, first, height, width) for c in ("cb", "cr"))
    own = np.arange(strip * STRIP, min(height, (strip + 1) * STRIP))
    return image, strip, height, int(rows[0]), own, to_xyb(samples, cb, cr)


def strip_state(pdf: pd.DataFrame, distance: float) -> dict:
    image, strip, height, first, own, xyb = planes_of(pdf)
    width = xyb.shape[2]
    cells = -(-width // 32) * 8
    tops = np.arange(strip * STRIP, strip * STRIP + -(-len(own) // 32) * 32, 4)
    pre = pre_erosion(xyb[1], tops, first, height, cells)
    eroded = erode(pre, field_params(distance).erosion)
    plain = xyb[:, own - first]
    return {
        "image": image, "strip": strip, "own": own, "plain": plain, "sharp": sharpen(xyb, own, first, height), "pre": pre, "eroded": eroded,
        "field": quant_field(plain, eroded, distance),
    }


def frame_blocks(luma: DataFrame, chroma: DataFrame, distance: float = 1.0) -> DataFrame:
    """First blocks of frames: image, by, bx, side, qf, ytox, ytob, q (three arrays in scan order), dc (three arrays)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = strip_state(pdf, distance)
        rows = encode_strip(s["plain"], s["sharp"], s["field"], distance)
        for r in rows:
            r["image"] = s["image"]
            r["by"] += s["strip"] * STRIP // 8
        return pd.DataFrame(rows)[["image", "by", "bx", "side", "qf", "ytox", "ytob", "q", "dc"]]

    return assemble(luma, chroma).groupBy("image", "strip").applyInPandas(
        run, "image string, by int, bx int, side int, qf int, ytox int, ytob int, q array<array<int>>, dc array<array<int>>"
    )


def plane_rows(luma: DataFrame, chroma: DataFrame, which: str, distance: float = 1.0) -> DataFrame:
    """image, y, x and three values of a plane: 'plain' or 'sharp'."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = strip_state(pdf, distance)
        h, w = s[which].shape[1:]
        y, x = np.repeat(s["own"], w), np.tile(np.arange(w), h)
        a, b, c = s[which].reshape(3, -1)
        return pd.DataFrame({"image": s["image"], "y": y, "x": x, "cx": a, "cy": b, "cb": c})

    return assemble(luma, chroma).groupBy("image", "strip").applyInPandas(run, "image string, y int, x int, cx double, cy double, cb double")


def cell_rows(luma: DataFrame, chroma: DataFrame, which: str, distance: float = 1.0) -> DataFrame:
    """image, row, column, value of a grid: 'pre', 'eroded' (cells of 4x4 pixels) or 'field' (blocks)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = strip_state(pdf, distance)
        g = s[which]
        per = STRIP // (8 if which == "field" else 4)
        return pd.DataFrame({"image": s["image"], "row": np.repeat(np.arange(len(g)) + s["strip"] * per, g.shape[1]), "col": np.tile(np.arange(g.shape[1]), len(g)), "value": g.ravel().astype(float)})

    return assemble(luma, chroma).groupBy("image", "strip").applyInPandas(run, "image string, row int, col int, value double")


def cost_rows(luma: DataFrame, chroma: DataFrame, distance: float = 1.0) -> DataFrame:
    """image, side, by, bx, cost of every candidate that was compared, and whether it was chosen."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = strip_state(pdf, distance)
        side, costs = select(s["sharp"][1], calibrate(distance).uniform)
        top = s["strip"] * STRIP // 8
        return pd.DataFrame([(s["image"], n, a + top, b, c, bool(side[a, b] == n)) for (n, a, b), c in costs.items()], columns=["image", "side", "by", "bx", "cost", "chosen"])

    return assemble(luma, chroma).groupBy("image", "strip").applyInPandas(run, "image string, side int, by int, bx int, cost double, chosen boolean")
