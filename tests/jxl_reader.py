"""A reader of the files that the library writes: every field is read back bit by bit, independent of the writer."""

import numpy as np


class Bits:
    def __init__(self, data):
        self.value, self.at, self.n = int.from_bytes(data, "little"), 0, 8 * len(data)

    def get(self, n):
        out = self.value >> self.at & ((1 << n) - 1)
        self.at += n
        assert self.at <= self.n
        return out

    def align(self):
        pad = -self.at % 8
        assert self.get(pad) == 0

    def pick(self, *options):
        """options: a number, or (bits, offset)."""
        o = options[self.get(2)]
        return o if isinstance(o, int) else o[1] + self.get(o[0])

    def u64(self):
        kind = self.get(2)
        if kind < 3:
            return (0, 1 + self.get(4) if kind == 1 else 0, 17 + self.get(8) if kind == 2 else 0)[kind]
        out, shift = self.get(12), 12
        while self.get(1):
            bits = 4 if shift == 60 else 8
            out |= self.get(bits) << shift
            shift += bits
            if shift == 64:
                break
        return out + 273


def log2_up(n):
    return (n - 1).bit_length() if n > 1 else 0


class Code:
    def __init__(self, lengths):
        """lengths: symbol -> length; the shortest first, then by symbol."""
        self.table, code, last = {}, 0, 0
        for n, s in sorted((n, s) for s, n in lengths.items()):
            code <<= n - last
            last = n
            self.table[n, code] = s
            code += 1
        self.only = next(iter(lengths)) if len(lengths) == 1 else None
        assert self.only is not None or sum(2.0**-n for n in lengths.values()) == 1

    def read(self, b):
        if self.only is not None:
            return self.only
        n = code = 0
        while (n, code) not in self.table:
            code, n = code << 1 | b.get(1), n + 1
            assert n <= 15
        return self.table[n, code]


def read_code(b, size):
    if size == 1:
        return Code({0: 0})
    place = (size - 1).bit_length()
    skip = b.get(2)
    if skip == 1:
        n = b.get(2) + 1
        symbols = [b.get(place) for _ in range(n)]
        if n == 1:
            return Code({symbols[0]: 0})
        lengths = {2: [1, 1], 3: [1, 2, 2], 4: [2, 2, 2, 2]}[n]
        if n == 4 and b.get(1):
            lengths = [1, 2, 3, 3]
        return Code(dict(zip(symbols, lengths)))
    order = [1, 2, 3, 4, 0, 5, 17, 6, 16, 7, 8, 9, 10, 11, 12, 13, 14, 15]
    fixed = {(2, 0): 0, (4, 7): 1, (3, 3): 2, (2, 2): 3, (2, 1): 4, (4, 15): 5}
    lengths, space = {}, 32
    for s in order[skip:]:
        n = v = 0
        while (n, v) not in fixed:
            v, n = v | b.get(1) << n, n + 1
        if fixed[n, v]:
            lengths[s] = fixed[n, v]
            space -= 32 >> fixed[n, v]
        if space <= 0:
            break
    code = Code(lengths)
    out, space, s = {}, 1 << 15, 0
    while space > 0 and s < size:
        n = code.read(b)
        assert n < 16
        if n:
            out[s] = n
            space -= 1 << 15 >> n
        s += 1
    assert space == 0
    return Code(out)


class Stream:
    """Histograms with their contexts, then numbers."""

    def __init__(self, b, contexts):
        self.b = b
        assert b.get(1) == 0
        self.map, n = read_map(b, contexts) if contexts > 1 else ([0], 1)
        assert b.get(1) == 1
        self.kinds = []
        for _ in range(n):
            split = b.get(4)
            high = b.get(log2_up(split + 1)) if split != 15 else 0
            self.kinds.append((split, high, b.get(log2_up(split - high + 1)) if split != 15 else 0))
        sizes = []
        for _ in range(n):
            bits = b.get(4) if b.get(1) else None
            sizes.append(1 if bits is None else (1 << bits) + b.get(bits) + 1)
        self.codes = [read_code(b, s) for s in sizes]

    def read(self, context=0):
        c = self.map[context]
        split, high, low = self.kinds[c]
        s = self.codes[c].read(self.b)
        if s < 1 << split:
            return s
        over = s - (1 << split)
        raw = split - high - low + (over >> (high + low))
        lead, last = over >> low & ((1 << high) - 1), over & ((1 << low) - 1)
        return ((((1 << high) | lead) << raw | self.b.get(raw)) << low) | last

    def signed(self, context=0):
        v = self.read(context)
        return v // 2 if v % 2 == 0 else -(v + 1) // 2


def read_map(b, contexts):
    if b.get(1):
        bits = b.get(2)
        out = [b.get(bits) for _ in range(contexts)]
        return out, max(out) + 1
    front = b.get(1)
    s = Stream(b, 1)
    out = [s.read() for _ in range(contexts)]
    if front:
        order = list(range(256))
        for i, v in enumerate(out):
            out[i] = order.pop(v)
            order.insert(0, out[i])
    return out, max(out) + 1


def channels(b, shapes):
    """Planes of a group with a tree of one leaf."""
    assert (b.get(1), b.get(1), b.get(2)) == (0, 1, 0)
    tree = Stream(b, 6)
    leaf = [tree.read(c) for c in (1, 2, 3, 4, 5)]
    assert leaf[0] == 0 and leaf[2:] == [0, 0, 0]
    data = Stream(b, 1)
    out = []
    for h, w in shapes:
        p = np.zeros((h, w), np.int64)
        for y in range(h):
            for x in range(w):
                left = p[y, x - 1] if x else p[y - 1, x] if y else 0
                up = p[y - 1, x] if y else left
                corner = p[y - 1, x - 1] if x and y else left
                low, high = min(left, up), max(left, up)
                guess = 0 if leaf[1] == 0 else high if corner < low else low if corner > high else left + up - corner
                p[y, x] = data.signed() + guess
        out.append(p)
    return out


def read_file(data, contexts):
    """The parts of a file of one frame: size, quantiser, DC planes and metadata of the DC groups, AC contexts and codes, AC sections."""
    assert data[:12] == bytes.fromhex("0000000c4a584c200d0a870a") and data[12:32] == bytes.fromhex("00000014667479706a786c20000000006a786c20")
    assert int.from_bytes(data[32:36], "big") == len(data) - 32 and data[36:40] == b"jxlc"
    body = data[40:]
    b = Bits(body)
    assert b.get(16) == 0x0AFF
    small = b.get(1)
    side = (lambda: 8 * (b.get(5) + 1)) if small else (lambda: b.pick((9, 1), (13, 1), (18, 1), (30, 1)))
    height = side()
    assert b.get(3) == 0
    width = side()
    assert b.get(1) == b.get(1) == 1
    b.align()
    assert b.get(1) == 0 and b.pick(0, 1, 2, 3) == 0 and b.get(1) == 0 and b.u64() == 0 and b.pick(1, 2, 4, 8) == 1
    assert b.get(3) == b.get(3) == 2 and b.pick(1, 2, 3, (3, 4)) == 1 and b.get(1) == 0 and b.pick(0, 1, 2, (2, 3)) == 0 and b.get(1) == 1
    assert b.pick(0, (4, 0), (5, 16), (10, 48)) == 0 and b.get(1) == 1 and b.u64() == 0 and b.get(1) == 0
    b.align()
    bh, bw = height // 8, width // 8
    dc_groups, ac_groups = -(-bh // 256) * -(-bw // 256), -(-bh // 32) * -(-bw // 32)
    sizes = [b.pick((10, 0), (14, 1024), (22, 17408), (30, 4211712)) for _ in range(2 + dc_groups + ac_groups)]
    b.align()
    at, parts = b.at // 8, []
    for n in sizes:
        parts.append(body[at : at + n])
        at += n
    assert at == len(body)
    g = Bits(parts[0])
    assert g.get(1) == 1
    scale, dc = g.pick((11, 1), (11, 2049), (12, 4097), (16, 8193)), g.pick(16, (5, 1), (8, 1), (16, 1))
    assert (g.get(1), g.get(1), g.get(1)) == (1, 1, 0)
    groups = []
    for i in range(dc_groups):
        gy, gx = divmod(i, -(-bw // 256))
        h, w = min(256, bh - gy * 256), min(256, bw - gx * 256)
        d = Bits(parts[1 + i])
        assert d.get(2) == 0
        planes = channels(d, [(h, w)] * 3)
        n = d.get(log2_up(h * w)) + 1
        tiles = (-(-h // 8), -(-w // 8))
        groups.append((planes, channels(d, [tiles, tiles, (2, n), (h, w)])))
        d.align()
        assert d.at == d.n
    a = Bits(parts[1 + dc_groups])
    assert a.get(1) == 1 and a.get(log2_up(ac_groups)) == 0 and a.pick(0x5F, 0x13, 0, (13, 0)) == 0
    ac = Stream(a, contexts)
    return {"width": width, "height": height, "scale": scale, "dc": dc, "groups": groups, "ac": ac, "sections": parts[2 + dc_groups :]}
