"""Images and frames as rows of one image's bytes: decoding, 4:2:0 frames and back, planar files, PNG files.

A row holds one image (a 3840 x 2160 frame has 12 MB), and all work on it is one numpy pass inside an Arrow batch.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

# Full range BT.709, rows Y, Cb, Cr; and the size of a master image.
YCBCR = ((0.2126, 0.7152, 0.0722), (-0.114572, -0.385428, 0.5), (0.5, -0.454153, -0.045847))
MASTER = (3840, 2160)
RGB = "image string, width int, height int, rgb binary"
NV12 = "image string, width int, height int, nv12 binary"


def read_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(image, width, height, rgb) of a folder's images in the order of their paths, decoded by the engine's own reader. A folder without any is an error."""
    ship(spark)
    rows = spark.read.format("image").option("pathGlobFilter", glob).load(path).select("image.*")
    if rows.isEmpty():
        raise FileNotFoundError(f"no images in {path}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for origin, w, h, n, data in b[["origin", "width", "height", "nChannels", "data"]].itertuples(index=False):
                p = np.frombuffer(data, np.uint8).reshape(h, w, n)  # blue, green, red (and alpha), or grey
                out.append((origin.rsplit("/", 1)[1], w, h, np.ascontiguousarray(p[:, :, 2::-1] if n >= 3 else np.repeat(p, 3, 2)).tobytes()))
            yield pd.DataFrame(out, columns=["image", "width", "height", "rgb"])

    return rows.orderBy("origin").mapInPandas(run, RGB)


def mapped(rows: DataFrame, value: str, fn: Callable[[np.ndarray], tuple[int, int, bytes]], to: str) -> DataFrame:
    """Each image by fn(height x width x 3 array, or bytes of a frame with its size) -> (width, height, bytes)."""
    ship(rows.sparkSession)
    name = to.split()[-2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for image, w, h, data in b[["image", "width", "height", value]].itertuples(index=False):
                got = fn(np.frombuffer(data, np.uint8).reshape(h, w, 3)) if value == "rgb" else fn(np.frombuffer(data, np.uint8), w, h)
                yield pd.DataFrame([(image, *got)], columns=["image", "width", "height", name])

    return rows.mapInPandas(run, to)


def even(v: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(v), 0, 255).astype(np.uint8)


def boxed(v: np.ndarray, factor: int) -> np.ndarray:
    """Means of squares of ``factor`` pixels."""
    h, w = v.shape[:2]
    if h % factor or w % factor:
        raise ValueError(f"{w}x{h} is no multiple of {factor}")
    return v.reshape(h // factor, factor, w // factor, factor, -1).mean((1, 3)).reshape(h // factor, w // factor, *v.shape[2:])


def downscale(rows: DataFrame, factor: int) -> DataFrame:
    def run(p: np.ndarray) -> tuple[int, int, bytes]:
        small = p if factor == 1 else even(boxed(p.astype(float), factor))
        return small.shape[1], small.shape[0], np.ascontiguousarray(small).tobytes()

    return mapped(rows, "rgb", run, RGB)


def interleave(cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """Chroma lines of a frame: Cb and Cr in turn."""
    return np.stack([cb, cr], -1).reshape(cb.shape[0], -1)


def nv12_of(rgb: np.ndarray) -> bytes:
    y, cb, cr = np.moveaxis(rgb.astype(float) @ np.array(YCBCR).T, 2, 0)
    return even(y).tobytes() + interleave(even(boxed(cb + 128, 2)), even(boxed(cr + 128, 2))).tobytes()


def to_nv12(rows: DataFrame) -> DataFrame:
    return mapped(rows, "rgb", lambda p: (p.shape[1], p.shape[0], nv12_of(p)), NV12)


def doubled(plane: np.ndarray) -> np.ndarray:
    """Twice the size by linear weights 3/4 and 1/4 of the nearest two samples, those at the edge held."""
    out = plane.astype(float)
    for axis in (0, 1):
        edge = [(int(a == axis),) * 2 for a in (0, 1)]
        wide = np.pad(out, edge, mode="edge")
        n = out.shape[axis]
        middle, before, after = (np.take(wide, np.arange(n) + k, axis) for k in (1, 0, 2))
        both = np.stack([0.75 * middle + 0.25 * before, 0.75 * middle + 0.25 * after], axis + 1)
        out = both.reshape([2 * n if a == axis else s for a, s in enumerate(out.shape)])
    return out


def rgb_of(frame: np.ndarray, width: int, height: int) -> np.ndarray:
    """RGB of a frame's bytes: chroma doubled linearly, the inverse of the matrix, rounded."""
    y = frame[: width * height].reshape(height, width).astype(float)
    chroma = frame[width * height :].reshape(height // 2, width // 2, 2)
    cb, cr = doubled(chroma[:, :, 0]) - 128, doubled(chroma[:, :, 1]) - 128
    return even(np.stack([y, cb, cr], -1) @ np.linalg.inv(np.array(YCBCR)).T)


def to_rgb(rows: DataFrame) -> DataFrame:
    return mapped(rows, "nv12", lambda f, w, h: (w, h, rgb_of(f, w, h).tobytes()), RGB)


def crop_box(width: int, height: int) -> tuple[int, int, int, int]:
    """left, top, width, height of the largest centred 16:9 rectangle."""
    w, h = width, height
    if width * 9 > height * 16:
        w = round(height * 16 / 9)
    elif width * 9 < height * 16:
        h = round(width * 9 / 16)
    return (width - w) // 2, (height - h) // 2, w, h


def lanczos(v: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Resampled along an axis by windowed sinc of three lobes, widened when shrinking, weights normalised."""
    n = v.shape[axis]
    scale = max(1.0, n / size)
    centre = (np.arange(size) + 0.5) * n / size - 0.5
    reach = int(np.ceil(3 * scale)) + 1
    at = np.floor(centre).astype(int)[:, None] + np.arange(-reach, reach + 1)[None, :]
    x = (at - centre[:, None]) / scale
    weight = np.where((np.abs(x) < 3) & (at >= 0) & (at < n), np.sinc(x) * np.sinc(x / 3), 0.0)
    weight /= weight.sum(1, keepdims=True)
    matrix = np.zeros((size, n))
    np.add.at(matrix, (np.repeat(np.arange(size), at.shape[1]), np.clip(at, 0, n - 1).ravel()), weight.ravel())
    return np.moveaxis(np.tensordot(matrix, np.moveaxis(v, axis, 0), 1), 0, axis)


def masters(rows: DataFrame, size: tuple[int, int] = MASTER) -> DataFrame:
    """Cropped to 16:9 and resampled to the master size."""

    def run(p: np.ndarray) -> tuple[int, int, bytes]:
        left, top, w, h = crop_box(p.shape[1], p.shape[0])
        v = p[top : top + h, left : left + w].astype(float)
        v = even(lanczos(v, size[0], 1)).astype(float) if w != size[0] else v
        v = even(lanczos(v, size[1], 0)) if h != size[1] else even(v)
        return size[0], size[1], np.ascontiguousarray(v).tobytes()

    return mapped(rows, "rgb", run, RGB)


def png_of(rgb: np.ndarray) -> bytes:
    """A PNG file of 8-bit RGB without filters."""
    h, w, _ = rgb.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, 3 * w)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def to_png(rows: DataFrame) -> DataFrame:
    return mapped(rows, "rgb", lambda p: (p.shape[1], p.shape[0], png_of(p)), "image string, width int, height int, png binary")


def write_files(rows: DataFrame, value: str, folder: str, suffix: str) -> int:
    """One file per row, ``image`` without its ending plus suffix, written whole by the executors through the engine's file systems. Returns the number."""
    ship(rows.sparkSession)
    conf = rows.sparkSession.sparkContext._jsc.hadoopConfiguration()
    jvm = rows.sparkSession.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    fs.mkdirs(root)
    if fs.getScheme() == "file":
        local = root.toUri().getPath()

        def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import os

            for b in batches:
                for image, data in b[["image", value]].itertuples(index=False):
                    place = os.path.join(local, image.rsplit(".", 1)[0] + suffix)
                    with open(place + ".part", "wb") as f:
                        f.write(data)
                    os.replace(place + ".part", place)
                yield pd.DataFrame({"n": [len(b)]})

        return int(rows.select("image", value).mapInPandas(put, "n long").agg(F.sum("n")).first()[0] or 0)
    n = 0
    for r in rows.select("image", value).toLocalIterator():  # a store without local paths: one row at a time through the driver
        out = fs.create(jvm.org.apache.hadoop.fs.Path(root, r.image.rsplit(".", 1)[0] + suffix), True)
        out.write(bytearray(r[value]))
        out.close()
        n += 1
    return n


def assets(frames: DataFrame, rung: str) -> DataFrame:
    """Manifest rows of frames (image, width, height, nv12)."""
    stem = F.regexp_replace("image", r"\.[^.]*$", "")
    return frames.select(
        F.col("image").alias("source"), F.concat(stem, F.lit(f"_{rung}.nv12")).alias("name"), F.lit(rung).alias("rung"), "width", "height",
        F.length("nv12").cast("long").alias("nv12_bytes"), F.sha2("nv12", 256).alias("sha256"),
    )


def read_planar(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """(image, c, y, values) of files of three planes of little-endian single precision numbers. A file of another size is an error."""
    ship(spark)
    size = 12 * width * height

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in b.itertuples(index=False):
                if len(data) != size:
                    raise ValueError(f"{name} has {len(data)} bytes, not {size}")
                planes = np.frombuffer(data, "<f4").reshape(3, height, width)
                for c in range(3):
                    yield pd.DataFrame({"image": name, "c": c, "y": np.arange(height), "values": list(planes[c].astype(float))})

    rows = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]*)$", 1).alias("image"), "content")
    return rows.mapInPandas(run, "image string, c int, y int, values array<double>")


def to_planar(lines: DataFrame) -> DataFrame:
    """(image, planar): the bytes of such a file from rows (image, c, y, values); one image in a task."""
    ship(lines.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["c", "y"])
        return pd.DataFrame({"image": [pdf["image"].iloc[0]], "planar": [np.concatenate([np.asarray(v, "<f4") for v in ordered["values"]]).tobytes()]})

    return lines.groupBy("image").applyInPandas(run, "image string, planar binary")
