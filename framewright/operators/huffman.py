"""Length-limited prefix codes and LSB-first bit packing. Alphabets are small (at most a few hundred symbols), so these run on one group at a time."""

from __future__ import annotations

import heapq
from collections.abc import Iterable


class BitWriter:
    """Bits are appended from the low end of each byte."""

    def __init__(self) -> None:
        self.value = self.size = 0
        self.done = bytearray()

    def put(self, nbits: int, bits: int) -> None:
        self.value |= (bits & ((1 << nbits) - 1)) << self.size
        self.size += nbits
        if self.size >= 1024:
            whole = self.size // 8
            self.done += (self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
            self.value >>= 8 * whole
            self.size -= 8 * whole

    @property
    def bits(self) -> int:
        return 8 * len(self.done) + self.size

    def append(self, other: BitWriter) -> None:
        """The bits of another writer, which need not end at a byte."""
        for b in other.done:
            self.put(8, b)
        self.put(other.size, other.value)

    def align(self) -> None:
        self.size = -(-self.size // 8) * 8

    def bytes(self) -> bytes:
        return bytes(self.done) + self.value.to_bytes(-(-self.size // 8), "little")


def depths(counts: dict[int, int], limit: int = 15) -> dict[int, int]:
    """Code lengths of the symbols that occur.

    The floor of the counts doubles until no length exceeds the limit. Ties: leaves by count come in descending symbol
    order, and a leaf goes before an inner node of equal count; inner nodes keep the order in which they were made.
    """
    present = [(s, n) for s, n in sorted(counts.items(), reverse=True) if n > 0]
    if len(present) == 1:
        return {present[0][0]: 1}
    floor = 1
    while present:
        heap = [(max(n, floor - 1), 0, i, (s,)) for i, (s, n) in enumerate(present)]
        heapq.heapify(heap)
        depth = dict.fromkeys((s for s, _ in present), 0)
        made = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in (*a[3], *b[3]):
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], 1, made, (*a[3], *b[3])))
            made += 1
        if max(depth.values()) <= limit:
            return depth
        floor *= 2
    return {}


def canonical(depth: dict[int, int]) -> dict[int, int]:
    """Codes by length, then symbol; each with its bits in the order of writing (first bit lowest)."""
    out, code, last = {}, 0, 0
    for d, s in sorted((d, s) for s, d in depth.items()):
        code <<= d - last
        last = d
        out[s] = int(f"{code:0{d}b}"[::-1], 2)
        code += 1
    return out


def decode(data: bytes, depth: dict[int, int], codes: dict[int, int], raw_bits: dict[int, int], n: int) -> Iterable[tuple[int, int]]:
    """n pairs (symbol, raw bits): the inverse of packing, for tests."""
    table = {(depth[s], codes[s]): s for s in depth}
    value, at = int.from_bytes(data, "little"), 0
    for _ in range(n):
        bits = size = 0
        while (size, bits) not in table:
            bits |= (value >> at & 1) << size
            at, size = at + 1, size + 1
        s = table[size, bits]
        k = raw_bits[s]
        yield s, value >> at & ((1 << k) - 1)
        at += k
