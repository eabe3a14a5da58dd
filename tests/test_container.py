"""Files read back to what they were made of, and fields against hand-derived values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from framewright import tables
from framewright.operators import codestream, tokens
from framewright.operators.huffman import BitWriter
from framewright.params import calibrate
from framewright.plans import container
from framewright.plans.frames import blocks_of, channel_blocks
from jxl_reader import Bits, Code, Stream, read_code, read_file


def test_file_reads_back(spark):
    """Size, quantiser, DC values, colour factors, kinds, field values and all AC tokens of a frame come back from the file."""
    blocks = blocks_of(spark, DATA)
    rows = sorted(blocks.collect(), key=lambda r: (r.by, r.bx))
    made = container.files(blocks).collect()[0]
    got = read_file(bytes(made.file), tables.CONTEXT_COUNT)
    cal = calibrate(1.0)
    assert (got["width"], got["height"], got["scale"], got["dc"]) == (made.width, made.height, cal.global_scale, cal.quant_dc)
    (planes, (to_x, to_b, kinds, zeros)) = got["groups"][0]
    assert not zeros.any() and kinds.shape[1] == len(rows)
    for i, r in enumerate(rows):
        m = r.side // 8
        for c, p in zip((1, 0, 2), planes):
            assert p[r.by : r.by + m, r.bx : r.bx + m].ravel().tolist() == list(r.dc[c])
        assert (to_x[r.by // 8, r.bx // 8], to_b[r.by // 8, r.bx // 8]) == (r.ytox, r.ytob)
        assert (kinds[0, i], kinds[1, i] + 1) == ({8: 0, 16: 4, 32: 5}[r.side], r.qf)
    coded = tokens.tokenize(channel_blocks(blocks)).collect()
    order = {1: 0, 0: 1, 2: 2}
    by_group = {}
    for t in sorted(coded, key=lambda t: (t.gy, t.gx, t.by, t.bx, order[t.c], t.k)):
        by_group.setdefault((t.gy, t.gx), []).append(t)
    assert len(by_group) == len(got["sections"])
    for (_, own), data in zip(sorted(by_group.items()), got["sections"]):
        got["ac"].b = Bits(data)
        for t in own:
            v = got["ac"].read(t.context)
            assert v == (t.symbol if t.symbol < 16 else ((4 | (t.symbol - 16) % 4) << t.nbits | t.bits))
        got["ac"].b.align()
        assert got["ac"].b.at == got["ac"].b.n


@pytest.mark.parametrize("counts", [[5], [0, 0, 7], [1, 1], [0, 3, 0, 9], [5, 1, 1], [1, 1, 5], [1, 5, 1], [1, 2, 4, 8], [8, 1, 4, 1], [3, 3, 3, 3], list(range(1, 30)), [1 << min(i, 30) for i in range(40)], [0] * 50 + [1, 2, 3, 4, 5, 6] + [0] * 10 + [9]])
def test_stored_codes(counts):
    """A stored code reads back with the same lengths; symbols coded by it come back."""
    w = BitWriter()
    code = codestream.store_code(w, counts)
    size = w.bits
    rng = random.Random(len(counts))
    present = [s for s, n in enumerate(counts) if n]
    sent = [rng.choice(present) for _ in range(60)]
    for s in sent:
        w.put(*code[s])
    b = Bits(w.bytes())
    back = read_code(b, len(counts)) if len(counts) > 1 else Code({0: 0})
    if len(counts) > 1:
        assert b.at == size
    else:
        b.at = size
    assert [back.read(b) for _ in sent] == sent


@pytest.mark.parametrize("clusters, form", [(1, "plain"), (2, "plain"), (8, "plain"), (8, "front"), (30, "coded"), (30, "front")])
def test_context_maps(clusters, form):
    """The shortest form is taken and reads back."""
    rng = random.Random(clusters)
    runs = form == "front" or clusters == 30
    contexts = [v for c in range(clusters) for v in [c] * (40 if form == "front" else 3)] if runs and form != "coded" else [rng.choice([0, 0, 0, rng.randrange(clusters)]) if clusters == 30 else rng.randrange(clusters) for _ in range(300)]
    contexts += list(range(clusters))
    w = BitWriter()
    assert codestream.store_context_map(w, contexts, clusters) == form
    sizes = [codestream._coded_map(contexts, f).bits for f in (False, True)] + ([codestream._plain_map(contexts, clusters).bits] if clusters <= 8 else [])
    assert w.bits == min(sizes)
    from jxl_reader import read_map

    assert read_map(Bits(w.bytes()), len(contexts))[0] == contexts


def test_fields():
    for value in [0, 1, 16, 17, 272, 273, 274, 4368, 4369, 1 << 20, (1 << 32) + 5, (1 << 64) - 1]:
        w = BitWriter()
        codestream.wide(w, value)
        b = Bits(w.bytes())
        assert b.u64() == value and b.at == w.bits
    for value, bits in [(0, 12), (1023, 12), (1024, 16), (17407, 16), (17408, 24), (4211712, 32)]:
        w = BitWriter()
        codestream.selected(w, codestream.SECTION_SIZE, value)
        assert w.bits == bits and Bits(w.bytes()).pick((10, 0), (14, 1024), (22, 17408), (30, 4211712)) == value
    w = BitWriter()
    codestream.selected(w, codestream.QUANT_DC, 16)
    assert w.bits == 2  # the exact value before the range that holds it too
    with pytest.raises(ValueError):
        codestream.selected(BitWriter(), codestream.FRAME_TYPE, 4)


def test_half_bits(spark):
    v = np.array([0.0, -0.0, 1.0, -2.5, 65504.0, 2.0**-14, 0.1, 1 / 3], np.float32)
    got = codestream.half_bits(v)
    back = got.view(np.float16).astype(np.float64)
    assert got[0] == 0 and got[1] == 0x8000 and (np.abs(back) <= np.abs(v)).all() and np.allclose(back, v, rtol=2**-10)
    with pytest.raises(ValueError):
        codestream.half_bits(np.array([1e-6]))
    rows = spark.createDataFrame([(float(x),) for x in v if x], "v double").select("v", container.half(F.col("v")).alias("h")).collect()
    assert [r.h for r in rows] == codestream.half_bits(np.array([r.v for r in rows])).tolist()


def test_hybrid_kinds():
    """Numbers with three settings come back from a stream of one context."""
    for kind in (codestream.Hybrid(), codestream.Hybrid(2, 0, 1), codestream.Hybrid(4, 1, 1), codestream.Hybrid(15)):
        values = [*range(40), 255, 256, 1000, 32767]
        counts = codestream._counted(values, kind)
        w = BitWriter()
        code = codestream.store_histograms(w, [counts], [0], kind)[0]
        codestream.emit(w, values, code, kind)
        s = Stream(Bits(w.bytes()), 1)
        assert [s.read() for _ in values] == values


def test_container_and_buffer():
    assert codestream.container(b"abc")[32:] == (11).to_bytes(4, "big") + b"jxlcabc"
    assert codestream.into_buffer(b"abc", 3) == ("ok", 3, b"abc") and codestream.into_buffer(b"abc", 2) == ("buffer-too-small", 3, None)
    assert codestream.into_buffer(None, 2)[0] == "invalid-argument"


def test_gradient_plane():
    from framewright.plans.codec import dc_residuals  # noqa: F401  (the DataFrame form; the file's test compares both)

    p = np.array([[3, 5, 4], [2, 9, 1]])
    assert codestream.gradient_residuals(p).tolist() == [[3, 2, -1], [-1, 5, -7]]
