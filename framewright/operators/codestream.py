"""Headers, stored prefix codes, context maps and sections of a codestream.

Each part is at most some thousand symbols of one frame or group, so these run on the driver's side of a group: inside
the task that packs it, or for the frame's head in the task that joins its sections.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np

from .. import tables
from .huffman import BitWriter, canonical, depths

Code = dict[int, tuple[int, int]]  # symbol -> (depth, bits)
Option = tuple[int, int]  # (bits, offset): the values offset .. offset + 2^bits - 1

# The four options of each selected field.
DIMENSION: tuple[Option, ...] = ((9, 1), (13, 1), (18, 1), (30, 1))
SECTION_SIZE: tuple[Option, ...] = ((10, 0), (14, 1024), (22, 17408), (30, 4211712))
GLOBAL_SCALE: tuple[Option, ...] = ((11, 1), (11, 2049), (12, 4097), (16, 8193))
QUANT_DC: tuple[Option, ...] = ((0, 16), (5, 1), (8, 1), (16, 1))
USED_ORDERS: tuple[Option, ...] = ((0, 0x5F), (0, 0x13), (0, 0), (13, 0))
ENUM: tuple[Option, ...] = ((0, 0), (0, 1), (4, 2), (6, 18))
FRAME_TYPE: tuple[Option, ...] = ((0, 0), (0, 1), (0, 2), (0, 3))
UPSAMPLING: tuple[Option, ...] = ((0, 1), (0, 2), (0, 4), (0, 8))
PASSES: tuple[Option, ...] = ((0, 1), (0, 2), (0, 3), (3, 4))
BLEND_MODE: tuple[Option, ...] = ((0, 0), (0, 1), (0, 2), (2, 3))
NAME_LENGTH: tuple[Option, ...] = ((0, 0), (4, 0), (5, 16), (10, 48))
# Order in which the lengths of the code-length code are stored, and the code of each length (bits, value).
LENGTH_ORDER = (1, 2, 3, 4, 0, 5, 17, 6, 16, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTH_CODE = ((2, 0), (4, 7), (3, 3), (2, 2), (2, 1), (4, 15))
# Signature, contexts of a one-leaf tree, predictors, transform kinds by side.
SIGNATURE = b"\xff\x0a"
TREE_CONTEXTS = 6
ZERO, GRADIENT = 0, 5
KINDS = {8: 0, 16: 4, 32: 5}
CLUSTERS = 32


def ceil_log2(n: int) -> int:
    return (n - 1).bit_length() if n > 1 else 0


def selected(w: BitWriter, options: Sequence[Option], value: int) -> None:
    """Two bits for the cheapest option that holds the value (the first of equals), then its place in the option."""
    fits = [(bits, i) for i, (bits, offset) in enumerate(options) if offset <= value < offset + (1 << bits)]
    if not fits:
        raise ValueError(f"no option holds {value}")
    bits, i = min(fits)
    w.put(2, i)
    w.put(bits, value - options[i][1])


def wide(w: BitWriter, value: int) -> None:
    """A number below 2^64: 0; 1..16; 17..272; above, twelve bits and then bytes behind a bit each (four bits from 2^60 on)."""
    if value < 273:
        kind = 0 if value == 0 else 1 if value <= 16 else 2
        w.put(2, kind)
        w.put((0, 4, 8)[kind], value - (0, 1, 17)[kind])
        return
    w.put(2, 3)
    rest = value - 273
    w.put(12, rest)
    rest >>= 12
    for bits in (8,) * 6 + (4,):
        w.put(1, int(rest > 0))
        if not rest:
            return
        w.put(bits, rest)
        rest >>= bits


def half_bits(v: np.ndarray) -> np.ndarray:
    """Half precision patterns of numbers in its normal range (or 0), the mantissa cut off."""
    bits = np.asarray(v, np.float32).view(np.uint32)
    exponent = ((bits >> 23) & 0xFF).astype(np.int64) - 112
    zero = (bits & 0x7FFFFFFF) == 0
    if ((exponent < 1) | (exponent > 30))[~zero].any():
        raise ValueError("out of the range of normal half precision numbers")
    return (((bits >> 16) & 0x8000) | np.where(zero, 0, exponent << 10 | (bits >> 13) & 0x3FF)).astype(np.uint16)


@dataclass(frozen=True)
class Hybrid:
    """Numbers as symbols with raw bits: below 2^split themselves, else exponent, ``high`` leading and ``low`` last bits in the symbol."""

    split: int = 4
    high: int = 2
    low: int = 0

    def of(self, value: int) -> tuple[int, int, int]:
        """symbol, raw bits, their value."""
        if value < 1 << self.split:
            return value, 0, 0
        n = value.bit_length() - 1
        raw = n - self.high - self.low
        lead = (value >> (n - self.high)) & ((1 << self.high) - 1)
        last = value & ((1 << self.low) - 1)
        symbol = (1 << self.split) + ((n - self.split) << (self.high + self.low)) + (lead << self.low) + last
        return symbol, raw, (value >> self.low) & ((1 << raw) - 1)

    def store(self, w: BitWriter, alphabet_bits: int = 15) -> None:
        w.put(ceil_log2(alphabet_bits + 1), self.split)
        if self.split != alphabet_bits:
            w.put(ceil_log2(self.split + 1), self.high)
            w.put(ceil_log2(self.split - self.high + 1), self.low)


def signed(v: int) -> int:
    return 2 * v if v >= 0 else -2 * v - 1


# Prefix codes ---------------------------------------------------------------------------------------------------------


def by_depth(symbols: list[int], depth: dict[int, int]) -> list[int]:
    """Up to four symbols by depth. Exchanges decide the order of equal depths, which readers of the format expect."""
    out = list(symbols)
    for i in range(len(out)):
        for j in range(i + 1, len(out)):
            if depth[out[j]] < depth[out[i]]:
                out[i], out[j] = out[j], out[i]
    return out


def _store_lengths(w: BitWriter, lengths: list[int]) -> None:
    """Code lengths of symbols 0, 1, ... up to the last that has one, by a code of their own of at most five bits."""
    counts: dict[int, int] = {}
    for x in lengths:
        counts[x] = counts.get(x, 0) + 1
    depth = depths(counts, 5)
    stored = [depth.get(x, 0) for x in LENGTH_ORDER]
    end = len(stored)
    while len(depth) > 1 and not stored[end - 1]:
        end -= 1
    skip = 0 if stored[0] or stored[1] else 2 if stored[2] else 3
    w.put(2, skip)
    for x in stored[skip:end]:
        w.put(*LENGTH_CODE[x])
    if len(depth) > 1:
        code = canonical(depth)
        for x in lengths:
            w.put(depth[x], code[x])


def store_code(w: BitWriter, counts: Sequence[int]) -> Code:
    """The prefix code of symbols 0 .. len - 1, and its description: none for a single symbol, a list of up to four, or lengths."""
    present = [s for s, n in enumerate(counts) if n]
    place = (len(counts) - 1).bit_length()
    if len(present) <= 1:
        w.put(4, 1)
        w.put(place, present[0] if present else 0)
        return {s: (0, 0) for s in present}
    depth = depths(dict(enumerate(counts)))
    code = canonical(depth)
    if len(present) <= 4:
        w.put(2, 1)
        w.put(2, len(present) - 1)
        order = by_depth(present, depth)
        for s in order:
            w.put(place, s)
        if len(present) == 4:
            w.put(1, int(depth[order[0]] == 1))
    else:
        _store_lengths(w, [depth.get(s, 0) for s in range(present[-1] + 1)])
    return {s: (depth[s], code[s]) for s in present}


def _store_length(w: BitWriter, n: int) -> None:
    w.put(1, int(n > 0))
    if n:
        bits = n.bit_length() - 1
        w.put(4, bits)
        w.put(bits, n - (1 << bits))


def trimmed(counts: Iterable[int]) -> list[int]:
    """Up to the last symbol that occurs; one symbol at least."""
    out = list(counts)
    while len(out) > 1 and not out[-1]:
        out.pop()
    return out or [0]


def store_histograms(w: BitWriter, groups: list[list[int]], contexts: list[int], kind: Hybrid) -> list[Code]:
    """Codes of the groups that the contexts are mapped to, with all that a reader needs. A map to one group alone is implied."""
    w.put(1, 0)  # no back references
    if len(contexts) > 1:
        store_context_map(w, contexts, len(groups))
    w.put(1, 1)  # prefix codes
    for _ in groups:
        kind.store(w)
    groups = [trimmed(g) for g in groups]
    for g in groups:
        _store_length(w, len(g) - 1)
    return [store_code(w, g) if len(g) > 1 else dict.fromkeys([s for s, n in enumerate(g) if n], (0, 0)) for g in groups]


def move_to_front(values: Sequence[int]) -> list[int]:
    front = list(range(256))
    out = []
    for v in values:
        at = front.index(v)
        out.append(at)
        front.insert(0, front.pop(at))
    return out


def _plain_map(contexts: Sequence[int], clusters: int) -> BitWriter:
    w, bits = BitWriter(), ceil_log2(clusters)
    w.put(1, 1)
    w.put(2, bits)
    for c in contexts:
        w.put(bits, c)
    return w


def _coded_map(contexts: Sequence[int], front: bool) -> BitWriter:
    w, kind = BitWriter(), Hybrid(2, 0, 1)
    w.put(1, 0)
    w.put(1, int(front))
    coded = [kind.of(v) for v in (move_to_front(contexts) if front else contexts)]
    counts = [0] * (max(s for s, *_ in coded) + 1)
    for s, *_ in coded:
        counts[s] += 1
    code = store_histograms(w, [counts], [0], kind)[0]
    for s, raw, bits in coded:
        w.put(*code[s])
        w.put(raw, bits)
    return w


def store_context_map(w: BitWriter, contexts: list[int], clusters: int) -> str:
    """The shortest of three forms: coded, coded after move-to-front (if shorter), plain (if no longer and of at most eight groups). Returns its name."""
    if clusters == 1:
        w.put(1, 1)
        w.put(2, 0)
        return "plain"
    coded, front = _coded_map(contexts, False), _coded_map(contexts, True)
    best, name = (front, "front") if front.bits < coded.bits else (coded, "coded")
    if clusters <= 8:
        plain = _plain_map(contexts, clusters)
        if plain.bits <= best.bits:
            best, name = plain, "plain"
    w.append(best)
    return name


# Sections -------------------------------------------------------------------------------------------------------------


def modular_header(w: BitWriter, counts: list[int], predictor: int) -> Code:
    """Channels with a tree of one leaf: no global tree, default weights, no transforms, the tree, the code of the residuals."""
    w.put(1, 0)
    w.put(1, 1)
    w.put(2, 0)
    leaf = [0, predictor, 0, 0, 0]  # no property, predictor, offset 0, multiplier 1
    tree = [leaf.count(s) for s in range(max(leaf) + 1)]
    code = store_histograms(w, [tree], [0] * TREE_CONTEXTS, Hybrid())[0]
    for t in leaf:
        w.put(*code[t])
    return store_histograms(w, [counts], [0], Hybrid())[0]


def dc_global(global_scale: int, quant_dc: int) -> bytes:
    w = BitWriter()
    w.put(1, 1)  # default DC steps
    selected(w, GLOBAL_SCALE, global_scale)
    selected(w, QUANT_DC, quant_dc)
    w.put(1, 1)  # default block contexts
    w.put(1, 1)  # default colour correlation
    w.put(1, 0)  # no global tree
    return w.bytes()


def ac_clusters() -> list[int]:
    """Cluster of each context: luma and chroma apart, by bands of predicted count or of density."""
    counts = tables.BLOCK_CONTEXT_COUNT * tables.NONZERO_BUCKETS
    c = np.arange(tables.CONTEXT_COUNT)
    rel = np.maximum(c - counts, 0)
    by_count = np.where(c % tables.BLOCK_CONTEXT_COUNT < 7, 0, 4) + np.searchsorted(tables.COUNT_BANDS, c // tables.BLOCK_CONTEXT_COUNT, "right")
    by_density = 8 + np.where(rel // tables.ZERO_DENSITY_COUNT < 7, 0, 12) + np.searchsorted(tables.DENSITY_BANDS, rel % tables.ZERO_DENSITY_COUNT, "right")
    return np.where(c < counts, by_count, by_density).tolist()


def ac_global(groups: list[list[int]], n_ac_groups: int) -> tuple[bytes, list[Code]]:
    """The section before the AC groups, and the codes of their clusters."""
    w = BitWriter()
    w.put(1, 1)  # default weights
    w.put(ceil_log2(n_ac_groups), 0)  # one set of histograms
    selected(w, USED_ORDERS, 0)
    codes = store_histograms(w, groups, ac_clusters(), Hybrid())
    return w.bytes(), codes


def emit(w: BitWriter, values: Iterable[int], code: Code, kind: Hybrid) -> None:
    for v in values:
        symbol, raw, bits = kind.of(v)
        w.put(*code[symbol])
        w.put(raw, bits)


def _counted(values: Iterable[int], kind: Hybrid) -> list[int]:
    out: list[int] = [0]
    for v in values:
        s = kind.of(v)[0]
        out += [0] * (s + 1 - len(out))
        out[s] += 1
    return out


def gradient_residuals(plane: np.ndarray) -> np.ndarray:
    """Values less the clamped gradient of their left, upper and upper left neighbours inside the plane."""
    up, left = np.zeros_like(plane), np.zeros_like(plane)
    up[1:] = plane[:-1]
    left[:, 1:] = plane[:, :-1]
    left[1:, 0] = plane[:-1, 0]
    up[0, 1:] = plane[0, :-1]
    corner = left.copy()
    corner[1:, 1:] = plane[:-1, :-1]
    guess = np.clip(left + up - corner, np.minimum(left, up), np.maximum(left, up))
    return plane - guess


def dc_group(planes: np.ndarray, to_x: np.ndarray, to_b: np.ndarray, firsts: Sequence[tuple[int, int]]) -> bytes:
    """A DC group's section: DC values (X, Y, B; coded Y, X, B), then colour factors of tiles, kinds and field values of the first blocks, a zero a block.

    firsts: (side, field value) of the first blocks in raster order.
    """
    kind, w = Hybrid(), BitWriter()
    residuals = [signed(int(v)) for c in (1, 0, 2) for v in gradient_residuals(planes[c]).ravel()]
    w.put(2, 0)  # no extra precision
    emit(w, residuals, modular_header(w, _counted(residuals, kind), GRADIENT), kind)
    n = planes.shape[1] * planes.shape[2]
    meta = [signed(int(v)) for v in (*to_x.ravel(), *to_b.ravel(), *(KINDS[s] for s, _ in firsts), *(q - 1 for _, q in firsts))] + [0] * n
    w.put(ceil_log2(n), len(firsts) - 1)
    emit(w, meta, modular_header(w, _counted(meta, kind), ZERO), kind)
    return w.bytes()


def head(width: int, height: int, sizes: Sequence[int]) -> bytes:
    """Signature, size, metadata, frame header and the sections' sizes."""
    w = BitWriter()
    for b in SIGNATURE:
        w.put(8, b)
    small = width % 8 == height % 8 == 0 and width <= 256 and height <= 256
    w.put(1, int(small))
    for i, n in enumerate((height, width)):
        if i:
            w.put(3, 0)  # no fixed ratio
        if small:
            w.put(5, n // 8 - 1)
        else:
            selected(w, DIMENSION, n)
    w.put(1, 1)  # default metadata
    w.put(1, 1)  # default transform data
    w.align()
    w.put(1, 0)  # a frame header of its own
    selected(w, FRAME_TYPE, 0)
    w.put(1, 0)  # transform coded
    wide(w, 0)  # flags
    selected(w, UPSAMPLING, 1)
    w.put(3, 2)  # neutral scale of X
    w.put(3, 2)  # neutral scale of B
    selected(w, PASSES, 1)
    w.put(1, 0)  # whole frame
    selected(w, BLEND_MODE, 0)
    w.put(1, 1)  # last frame
    selected(w, NAME_LENGTH, 0)
    w.put(1, 1)  # default filter
    wide(w, 0)  # no extensions
    w.put(1, 0)  # sections in order
    w.align()
    for n in sizes:
        selected(w, SECTION_SIZE, n)
    w.align()
    return w.bytes()


#: The file signature and type boxes. Fixed values.
CONTAINER_HEADER = bytes.fromhex("0000000c4a584c200d0a870a" + "00000014667479706a786c20000000006a786c20")


def container(codestream: bytes) -> bytes:
    """The file: signature and type boxes, and the codestream's box (of a 64-bit size from 2^32 - 8 bytes on)."""
    n = len(codestream)
    box = (n + 8).to_bytes(4, "big") + b"jxlc" if n < (1 << 32) - 8 else (1).to_bytes(4, "big") + b"jxlc" + (n + 16).to_bytes(8, "big")
    return CONTAINER_HEADER + box + codestream


def into_buffer(data: bytes | None, capacity: int) -> tuple[str, int, bytes | None]:
    """Status, bytes needed, and the file if a buffer of ``capacity`` bytes holds it."""
    if data is None:
        return "invalid-argument", 0, None
    return ("ok", len(data), data) if len(data) <= capacity else ("buffer-too-small", len(data), None)
