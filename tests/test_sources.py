"""Fetching with retries and a verified cache, images and frames, documents and text tables."""

import hashlib
import json
import random

import numpy as np
import pytest

from framewright.plans import analysis, reports as checks
from framewright.sources import fetch, images, media, reports


class Remote:
    """Answers in turn; exceptions are raised. Notes the waits."""

    def __init__(self, *answers):
        self.answers, self.waits, self.asked = list(answers), [], []

    def __call__(self, what):
        self.asked.append(what)
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a


def policy(remote, **more):
    return fetch.Policy(**({"sleep": remote.waits.append} | more))


def test_listing_retries():
    lag = json.dumps({"error": {"code": "maxlag", "info": "slow"}})
    r = Remote(fetch.HttpStatus(429, 7.0), fetch.HttpStatus(503), TimeoutError(), lag, '{"ok": 1}')
    got = fetch.json_fetcher(r, policy(r))({"a": 1})
    assert json.loads(got) == {"ok": 1} and r.waits == [7.0, 10.0, 4.0, 8.0, 1.0]
    assert r.asked[0] == {"a": 1, "format": "json", "maxlag": "5"}
    for answers in ([fetch.HttpStatus(404)], [fetch.HttpStatus(503)] * 5, [OSError("down")] * 5, [json.dumps({"error": {"code": "bad", "info": "no"}})], [lag] * 5):
        r = Remote(*answers)
        with pytest.raises(RuntimeError, match="request failed"):
            fetch.json_fetcher(r, policy(r))({})


def entry(name, data=b"x", **more):
    return {"name": name, "mime": "image/png", "url": f"http://h/{name}", "sha1": hashlib.sha1(data).hexdigest()} | more


def test_downloads(tmp_path):
    r = Remote(fetch.HttpStatus(429, 100.0), fetch.HttpStatus(429), fetch.HttpStatus(503), b"x")
    client = fetch.Client(policy(r, pause=60.0, base=30.0, most=600.0, streak=3, cooldown=300.0))
    place = fetch.download(entry("a"), tmp_path, r, client)
    assert place.read_bytes() == b"x" and place.name == "a.png" and r.waits == [100.0, 60.0, 120.0 + 300.0, 60.0]
    assert fetch.download(entry("a"), tmp_path, r, client) == place and not r.answers  # cached
    place.write_bytes(b"spoilt")
    r.answers = [b"x"]
    assert fetch.download(entry("a"), tmp_path, r, client).read_bytes() == b"x"  # fetched anew
    r.answers = [b"other"]
    with pytest.raises(RuntimeError, match="sha1 mismatch"):
        fetch.download(entry("b"), tmp_path, r, client)
    assert not list(tmp_path.glob("b*"))
    r.answers = [b"y"]
    assert fetch.download(entry("c", sha1=""), tmp_path, r, client).read_bytes() == b"y"
    r.answers = [fetch.HttpStatus(404), b"x", b"bad"]
    with pytest.raises(RuntimeError) as e:
        fetch.download_all([entry("d"), entry("e"), entry("f")], tmp_path, r, policy(r))
    assert "d: request failed" in str(e.value) and "f: sha1 mismatch" in str(e.value) and (tmp_path / "e.png").exists()


def test_verified(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"x")
    (tmp_path / "b.png").write_bytes(b"no")
    rows = [entry("a"), entry("b"), entry("c"), entry("b", sha1="")]
    df = spark.createDataFrame([(e["name"], e["mime"], e["sha1"]) for e in rows], "name string, mime string, sha1 string")
    assert sorted((r.name, r.state) for r in fetch.verified(spark, str(tmp_path), df).collect()) == [("a", "cached"), ("b", "cached"), ("b", "mismatch"), ("c", "missing")]


def picture(w, h, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3)).astype(np.uint8)


def rows_of(spark, *pictures):
    return spark.createDataFrame([(f"p{i}.png", p.shape[1], p.shape[0], bytearray(p.tobytes())) for i, p in enumerate(pictures)], images.RGB)


def test_png_files_are_read_back(spark, tmp_path):
    a, b = picture(12, 8), picture(6, 10, 2)
    assert images.write_files(images.to_png(rows_of(spark, a, b)), "png", str(tmp_path / "out"), ".png") == 2
    got = images.read_images(spark, str(tmp_path / "out")).collect()
    assert [(r.image, r.width, r.height) for r in got] == [("p0.png", 12, 8), ("p1.png", 6, 10)]
    assert bytes(got[0].rgb) == a.tobytes() and bytes(got[1].rgb) == b.tobytes()
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception):  # noqa: B017
        images.read_images(spark, str(tmp_path / "none"))


def test_frames(spark, tmp_path):
    """Pixel by pixel against the formulas; a grey picture comes back as it was; files hold what the manifest says."""
    a = picture(16, 8)
    frame = images.to_nv12(rows_of(spark, a)).first()
    y = bytes(frame.nv12)
    p = a.astype(float)
    for j in range(8):
        for i in range(16):
            r, g, b = p[j, i]
            assert y[j * 16 + i] == round(0.2126 * r + 0.7152 * g + 0.0722 * b)
    for j in range(4):
        for i in range(8):
            r, g, b = p[2 * j : 2 * j + 2, 2 * i : 2 * i + 2].mean((0, 1))
            cb, cr = y[128 + j * 16 + 2 * i], y[128 + j * 16 + 2 * i + 1]
            assert (cb, cr) == (min(255, round(128 - 0.114572 * r - 0.385428 * g + 0.5 * b)), min(255, round(128 + 0.5 * r - 0.454153 * g - 0.045847 * b)))
    grey = np.repeat(picture(16, 8, 3)[:, :, :1], 3, 2)
    back = images.to_rgb(images.to_nv12(rows_of(spark, grey))).first()
    assert bytes(back.rgb) == grey.tobytes()
    plane = np.array([[0.0, 100.0], [40.0, 80.0]])
    assert images.doubled(plane)[0].tolist() == [0, 25, 75, 100] and images.doubled(plane)[1].tolist() == [10, 0.75 * 25 + 0.25 * 50, 0.75 * 75 + 0.25 * 70, 95]
    frames = images.to_nv12(rows_of(spark, a, grey))
    assert images.write_files(frames, "nv12", str(tmp_path), "_720p.nv12") == 2
    for r in images.assets(frames, "720p").collect():
        data = (tmp_path / r.name).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r.nv12_bytes, r.sha256)
    assert media.read_nv12(spark, str(tmp_path), 16, 8).count() == 2
    with pytest.raises(Exception, match="no .*nv12"):
        media.read_nv12(spark, str(tmp_path), 16, 8, "*.none.nv12")


def test_downscale_and_masters(spark):
    a = picture(32, 18)
    half = images.downscale(rows_of(spark, a), 2).first()
    want = np.rint(a.astype(float).reshape(9, 2, 16, 2, 3).mean((1, 3))).astype(np.uint8)
    assert (half.width, half.height, bytes(half.rgb)) == (16, 9, want.tobytes())
    same = images.masters(rows_of(spark, a), (32, 18)).first()
    assert bytes(same.rgb) == a.tobytes()  # its own size: nothing is resampled
    wide = images.masters(rows_of(spark, picture(50, 18)), (16, 9)).first()
    assert (wide.width, wide.height, len(wide.rgb)) == (16, 9, 16 * 9 * 3)
    flat = images.masters(rows_of(spark, np.full((40, 33, 3), 77, np.uint8)), (64, 36)).first()
    assert set(bytes(flat.rgb)) == {77}
    assert images.crop_box(50, 18) == (9, 0, 32, 18) and images.crop_box(32, 40) == (0, 11, 32, 18)


def test_planar(spark, tmp_path):
    v = np.random.default_rng(3).normal(size=(3, 4, 5)).astype("<f4")
    (tmp_path / "a.f32").write_bytes(v.tobytes())
    lines = images.read_planar(spark, str(tmp_path), 5, 4)
    assert bytes(images.to_planar(lines).first().planar) == v.tobytes()
    with pytest.raises(Exception, match="bytes, not"):
        images.read_planar(spark, str(tmp_path), 6, 4).collect()


def test_documents(spark, tmp_path):
    path = str(tmp_path / "d/sources.json")
    records = spark.createDataFrame([("b", "p", "u", 4000, 3000, "image/png", "s", "", "CC0"), ("a", "p2", "u", 4000, 3000, "image/png", "s", "Me", "CC0")], media.FILE)
    reports.write_json(spark, path, reports.sources_document(records, "Category:X", "2026-01-02", 1))
    assert [r.name for r in media.sources(spark, path).collect()] == ["a"]
    assert json.loads((tmp_path / "d/sources.json").read_text())["constraints"]["min_width"] == 3840 and len(reports.today()) == 10
    reports.write_attributions(records, str(tmp_path / "ATTRIBUTIONS.txt"))
    assert (tmp_path / "ATTRIBUTIONS.txt").read_text() == "a: Me, CC0, p2\nb: uncredited, CC0, p\n"
    stages = [{"name": "x", "bytes_moved": 1.0, "gpu_us": 30.0, "cpu_us": 10.0}, {"name": "y", "bytes_moved": 0.0, "gpu_us": 10.0, "cpu_us": 0.0}]
    assert reports.budget_document([])["fps"] == 0.0
    reports.write_json(spark, str(tmp_path / "b.json"), reports.budget_document(stages))
    got = media.stage_records(spark, str(tmp_path / "b.json")).collect()
    assert [(r.name, r.fps) for r in got] == [("x", 20000.0), ("y", 20000.0)]
    sweep = spark.createDataFrame([("i", "1080p", "own", "d=1.5", 100, 0.5, 9.0, 40.0, 1.5, 80.0)], media.SWEEP)
    reports.write_sweep(sweep, str(tmp_path / "s.json"))
    points = {r.metric: (r.param_value, r.q) for r in media.sweep_points(spark, str(tmp_path / "s.json")).collect()}
    assert points == {"psnr": (1.5, 40.0), "butteraugli": (1.5, -1.5), "ssimulacra2": (1.5, 80.0)}
    manifest = reports.manifest_document(spark.createDataFrame([("b", "b", "720p", 1, 1, 1, "x"), ("a", "a", "720p", 1, 1, 1, "x")], media.ASSET), {"n": 1})
    assert [a["name"] for a in manifest["assets"]] == ["a", "b"] and manifest["format"] == "nv12" and manifest["sources"] == {"n": 1}


def test_tables(spark):
    row = ("x" * 30, "1080p", "own", "d=1.5", 123456, 0.517, 9.04, 40.25, 1.5, 80.0)
    assert reports.sweep_table(spark.createDataFrame([row], media.SWEEP)).split("\n")[2] == f"{'x' * 22} {'own':<9} {'d=1.5':<8} {123456:>10} {0.517:>6.2f} {9.04:>6.1f} {40.25:>6.2f} {1.5:>7.3f} {80.0:>7.2f}"
    assert reports.text_table(["a", "long"], [["xyz", "-"]]) == "a    long\nxyz  -   "
    checked = analysis.budget(spark.createDataFrame([(1e6, 6000.0, 1500.0)], "bytes_moved double, gpu_us double, cpu_us double"))
    table = reports.budget_table(checked)
    assert table.split("\n")[0].startswith("[PASS] dram_bandwidth  1.5e+07 <= 1.7e+10 B/s") and table.endswith("overall: PASS")
    own = {"codec": "own", "setting": "d=1.0", "mean_us": 100.0, "p50_us": 99.0, "p99_us": 120.0, "fps": 10.0, "megapixels_per_s": 83.0}
    other = own | {"codec": "other", "setting": "q=90", "mean_us": 250.0}
    assert "q=90 vs d=1.0: own faster by 2.50x" in reports.comparison_table([(other, own)])
    assert "q=90 vs d=1.0: other faster by 2.50x" in reports.comparison_table([(other | {"mean_us": 100.0}, own | {"mean_us": 250.0})])
    assert reports.comparison_document([(other, own)])[0]["speedup"] == 2.5


def test_guards(spark):
    frames = spark.createDataFrame([(16, 8)], "width int, height int")
    assert checks.checked_size(frames, 16, 8).count() == 1
    with pytest.raises(Exception, match="expected 32x8, got 16x8"):
        checks.checked_size(frames, 32, 8).collect()
    with pytest.raises(Exception, match="unsupported resolution: 480p"):
        checks.checked_rung(spark, spark.createDataFrame([("480p",)], "rung string")).collect()
    checks.failures(spark.createDataFrame([("a", None)], "name string, error string"))
    with pytest.raises(RuntimeError, match="a: x\n  b: y"):
        checks.failures(spark.createDataFrame([("b", "y"), ("a", "x"), ("c", None)], "name string, error string"))
    cache = spark.createDataFrame([("i", None, "old", "d=1", "x"), ("j", None, "own", "d=1", "x")], "image string, resolution string, codec string, param string, y string")
    assert checks.cached_rows(cache, "old").count() == 1
    with pytest.raises(Exception, match="row without resolution: i old d=1"):
        checks.cached_rows(cache, "own").collect()


def test_standalone_colour_factors(spark):
    rng = random.Random(2)
    y = [rng.gauss(0, 1) for _ in range(50)]
    cells = [(0, 0.25 * v, v, 1.5 * v) for v in y] + [(1, v, 0.0, v) for v in y] + [(2, 9 * v, v, -9 * v) for v in y]
    got = {r.tile: (r.ytox, r.ytob) for r in checks.estimate(spark.createDataFrame(cells, "tile int, x double, y double, b double")).collect()}
    assert got == {0: (21, 42), 1: (0, 0), 2: (127, -128)}


def test_slots(spark):
    """The blocks of one region fill its places once each."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(16, 0, 0), (8, 2, 0), (8, 3, 0), (8, 2, 1), (8, 3, 1), (32, 4, 0), (16, 0, 2), (16, 2, 2)], "side int, bx int, by int")
    each = rows.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("side") * F.col("side") - 1)))
    slots = [r.s for r in each.select(checks.slot(F.col("side"), F.col("bx"), F.col("by"), F.lit(8), F.col("r")).alias("s")).collect()]
    assert sorted(slots) == list(range(8 * 4 * 64))


def test_scatter_and_gather(spark):
    """Coefficients scattered over a plane come back, each in the place that slot names."""
    from pyspark.sql import functions as F

    layout = [(16, 0, 0), (8, 2, 0), (8, 3, 0), (8, 2, 1), (8, 3, 1), (32, 4, 0), (16, 0, 2), (16, 2, 2)]
    rows = spark.createDataFrame([("i", n, x, y, [float(n * 10_000 + x * 1000 + y * 100_000 + k) for k in range(n * n)]) for n, x, y in layout], "image string, side int, bx int, by int, coeff array<double>")
    plane = checks.scattered(rows, F.lit(8))
    held = {(r.block * 64 + i): v for r in plane.collect() for i, v in enumerate(r["values"])}
    each = rows.select("side", "bx", "by", F.posexplode("coeff").alias("r", "v")).select(checks.slot(F.col("side"), F.col("bx"), F.col("by"), F.lit(8), F.col("r")).alias("s"), "v")
    assert held == {r.s: r.v for r in each.collect()}
    back = checks.gathered(plane, rows.drop("coeff"), F.lit(8))
    assert back.exceptAll(rows.select(*back.columns)).count() == rows.count() - back.count() == 0


def test_plots(spark, tmp_path):
    """A drawing per metric is well formed and holds each codec's curve and each point."""
    import xml.etree.ElementTree as tree

    rows = [(c, m, p, p + k, 0.1, 10 * p + k, 0.5) for k, c in enumerate("A<") for m in ("psnr", "other") for p in (1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "codec string, metric string, param_value double, bpp_mean double, bpp_std double, q_mean double, q_std double")
    made = reports.write_plots(df, str(tmp_path))
    assert [m.rsplit("/", 1)[1] for m in made] == ["other.svg", "psnr.svg"]
    root = tree.parse(made[0]).getroot()
    kinds = [e.tag.rsplit("}", 1)[1] for e in root]
    assert kinds.count("polyline") == 2 and kinds.count("circle") == 6
    for e in root:
        if e.tag.endswith("polyline"):
            points = [tuple(map(float, p.split(","))) for p in e.attrib["points"].split()]
            assert points == sorted(points) and [y for _, y in points] == sorted((y for _, y in points), reverse=True)
    tree.fromstring(reports.curves_svg([], "empty"))
