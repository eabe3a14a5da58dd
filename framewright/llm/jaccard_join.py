"""N-gram Jaccard join by signature trees: exact, distributed over candidate blocks.

1. Sets. A text becomes the set of 64-bit hashes of its distinct word shingles. Equal sets (two hashes of the set agree)
   are one *node*, so copies cost one narrow row each from here on.
2. Candidate blocks. Two sets that link differ in at most d = (|x| + |y|) (1 - t) / (1 + t) shingles. Hash space is
   dealt into more than d segments; by the pigeonhole principle a linked pair has an equal segment that isn't empty, so
   the hash of each segment is a key and linked sets share a key. (Sizes fall into bands; a set also joins the next
   band if a partner may be there. A set with too few non-empty segments gives its empty ones too; pairs of which
   both are such sets then meet in one.) Unlike single shingles, whole segments are seldom shared by texts that have a
   passage in common; keys that are common all the same are left out where other keys must be shared too (see
   ``candidate_edges``). Copies in one task send one set of keys. One node of a key is its hub (the smallest; of a common
   key the one with most common keys, so that few hubs serve a large group); a hub with all nodes of its keys is a
   block. Two sets that link share a key, so they are together in the block of its hub.
3. Signature trees. In a block the sets are the leaves of a tree, ordered by size; a node holds the OR of its token
   bitmaps and its range of sizes. A dual traversal drops pairs of nodes whose sizes can't link or whose greatest
   possible overlap is too small, and pairs already connected. This is done twice. First with the bitmaps alone (two
   to four bits a shingle, sent to each block of a set): pairs that the bitmaps allow are connected, and the components
   are groups. Then each set is sent once, to its group, and pairs at the leaves are compared exactly.
4. Blocks above ``piece`` shingles are cut into pieces. First each piece joins itself together with about ``pivots``
   random sets of the block, which connects groups of near copies in linear work; then sets of different components
   (large components stay apart from each other's pieces) join across pieces. No pair of different components is left
   out, none of the same component is looked at.

Components come from alternating large-star and small-star steps, with a table in the shared folder per round. Keys of
many rows (copies of one text, centres of stars) are joined apart from the others.

Edge cases: null, empty and blank texts have an empty set, link with nothing and are their own component. A text with
fewer words than a shingle has one shingle, its whole sequence. Rows that repeat a doc_id are nodes by their texts;
component_id is the smallest doc_id of the component (null only if all its doc_ids are null). Sets whose first hashes
clash are told apart by the second. Ties don't matter: the result depends on the sets alone. An empty table gives an
empty result. Further columns are ignored, and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, map_arrow, materialize, release

_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_KNOWN = 200_000


@dataclass(frozen=True)
class Params:
    """t = num / den. common: nodes of a key from which on it is a common one. piece: shingles in a piece of a block. broadcast_rows bounds the candidate ids sent to all executors."""

    words: int = 4
    num: int = 85
    den: int = 100
    common: int = 32
    piece: int = 1 << 20
    pivots: int = 16
    broadcast_rows: int = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts. A word is what lies between ASCII white space; A-Z count as a-z."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.known: dict[bytes, int] = {}

    def set_of(self, text: bytes | None) -> np.ndarray:
        import xxhash

        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) > _KNOWN:
                known.clear()
                new = set(words)
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = self.words
        with np.errstate(over="ignore"):
            if len(h) < k:
                whole = np.uint64(len(h))
                for i, x in enumerate(h):
                    whole = whole * _C[7] + x * _C[i % 8]
                return mix(np.array([whole], np.uint64))
            total = np.zeros(len(h) - k + 1, np.uint64)
            for i in range(k):
                total = total * _C[7] + h[i : len(h) - k + 1 + i] * _C[i % 8]
        return np.unique(mix(total))


def node_of(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, as signed numbers."""
    import xxhash

    data = s.tobytes()
    return tuple(int(np.uint64(xxhash.xxh3_64_intdigest(data, seed)).astype(np.int64)) for seed in (0, 1))


class Bands:
    """Size bands, the number of segments of each, and the keys of a set. The low six bits of a key are its band.

    A set with e non-empty segments of which a partner can change d shares e - d of them with any partner; its slack is
    e - d - 1: so many keys may be left out and one is still shared. (0 for a set that gives its empty segments.)
    """

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.least = -(-num // (den - num))  # smaller sets link with equal ones alone
        self.edges = [self.least]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, self.edges[-1] * 3 // 2, -(-self.edges[-1] * den // num) + 1))
        self.most = [2 * (e - 1) * (den - num) // (den + num) for e in self.edges[1:]]  # differences of a pair whose larger set is in the band
        self.segments = [d + 1 + max(2, d // 5) for d in self.most]

    def keys(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys, and for each the set's slack in its band."""
        n = len(s)
        if n < self.least:
            return np.zeros(0, np.uint64), np.zeros(0, np.int16)
        own = int(np.searchsorted(self.edges, n, "right")) - 1
        bands = [own] + ([own + 1] if n * self.den // self.num >= self.edges[own + 1] else [])
        out, spare = [], []
        with np.errstate(over="ignore"):
            mixed = mix(s * _C[0] + _C[1])
            for b in bands:
                m = self.segments[b]
                j = ((s >> np.uint64(11)) % np.uint64(m)).astype(np.int64)
                order = np.argsort(j, kind="stable")
                at = j[order]
                first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                sums = np.add.reduceat(mixed[order], first)
                seg = at[first].astype(np.uint64)
                slack = len(first) - 1 - min(n * (self.den - self.num) // self.num, self.most[b])
                if slack < 0:
                    slack = 0
                    empty = np.setdiff1d(np.arange(m, dtype=np.uint64), seg)
                    seg, sums = np.concatenate([seg, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)])
                key = mix(sums + seg * _C[2] + np.uint64(b) * _C[3] + _C[4])
                out.append((key & ~np.uint64(63)) | np.uint64(min(b, 63)))
                spare.append(np.full(len(key), min(slack, 32767), np.int16))
        return np.concatenate(out), np.concatenate(spare)


@lru_cache(maxsize=4)
def _bands(num: int, den: int) -> Bands:
    return Bands(num, den)


def bitmap_of(s: np.ndarray) -> bytes:
    """Token bitmap of a set: two to four bits a token, a power of two of at least 64 bits, lowest bit first."""
    width = 64
    while width < 2 * len(s):
        width *= 2
    line = np.zeros(width, np.uint8)
    line[(s % np.uint64(width)).astype(np.int64)] = 1
    return np.packbits(line, bitorder="little").tobytes()


class SignatureTree:
    """Leaves are sets in the order of their sizes; each node has the OR of their bitmaps, sizes and the greatest surplus of size over bits.

    sizes and bits are by position; members are the positions in the tree. All bitmaps have one width.
    """

    def __init__(self, members: list[int], sizes: list[int], bits: dict[int, int], leaf: int = 4, fan: int = 4) -> None:
        self.sizes, self.bits = sizes, bits
        self.surplus = {i: sizes[i] - bits[i].bit_count() for i in members}
        order = sorted(members, key=lambda i: (sizes[i], i))
        level = [self._node(order[i : i + leaf]) for i in range(0, len(order), leaf)]
        while len(level) > 1:
            level = [self._join(level[i : i + fan]) for i in range(0, len(level), fan)]
        self.root = level[0]

    def _node(self, members: list[int]) -> dict:
        union = 0
        for i in members:
            union |= self.bits[i]
        sizes = [self.sizes[i] for i in members]
        return {"or": union, "min": min(sizes), "max": max(sizes), "surplus": max(self.surplus[i] for i in members), "members": members, "children": (), "one": None}

    def _join(self, nodes: list[dict]) -> dict:
        union = 0
        for x in nodes:
            union |= x["or"]
        return {
            "or": union, "min": min(x["min"] for x in nodes), "max": max(x["max"] for x in nodes), "surplus": max(x["surplus"] for x in nodes),
            "members": [i for x in nodes for i in x["members"]], "children": tuple(nodes), "one": None,
        }


class DualJoin:
    """Dual traversals that share one union-find. exact(i, j) decides a pair that the bitmaps allow; without it such a pair counts as found."""

    def __init__(self, n: int, num: int, den: int, same: list[int] | None, exact: Callable[[int, int], bool] | None) -> None:
        self.num, self.den, self.exact = num, den, exact
        self.parent = list(range(n))
        self.out: list[tuple[int, int]] = []
        seen: dict[int, int] = {}
        for i, label in enumerate(same or ()):
            self.parent[i] = seen.setdefault(label, i)

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def can(self, max_a: int, max_b: int, min_a: int, min_b: int, common: int) -> bool:
        """Sizes and bitmaps allow for a link: overlap >= t (|x| + |y|) / (1 + t)."""
        num, den = self.num, self.den
        return common * (num + den) >= num * (min_a + min_b) and max_a * den >= min_b * num and max_b * den >= min_a * num

    def one(self, node: dict) -> int | None:
        """The component that all members are in, once there is one."""
        if node["one"] is None:
            first = self.find(node["members"][0])
            if any(self.find(i) != first for i in node["members"]):
                return None
            node["one"] = first
        return self.find(node["one"])

    def compare(self, x: SignatureTree, i: int, y: SignatureTree, j: int) -> None:
        if self.find(i) == self.find(j):
            return
        n, m = x.sizes[i], y.sizes[j]
        common = min(x.surplus[i], y.surplus[j]) + (x.bits[i] & y.bits[j]).bit_count()
        if self.can(n, m, n, m, min(common, n, m)) and (self.exact is None or self.exact(i, j)):
            self.out.append((i, j))
            self.parent[self.find(i)] = self.find(j)

    def run(self, x: SignatureTree, y: SignatureTree) -> None:
        """All pairs of a member of x and one of y; within one tree if they are the same."""
        stack = [(x.root, y.root)]
        while stack:
            a, b = stack.pop()
            root = self.one(a)
            if root is not None and (a is b or root == self.one(b)):
                continue
            if a is not b:
                common = min(min(a["surplus"], b["surplus"]) + (a["or"] & b["or"]).bit_count(), a["max"], b["max"])
                if not self.can(a["max"], b["max"], a["min"], b["min"], common):
                    continue
            if a is b:
                kids = a["children"]
                if kids:
                    stack += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i)]
                    stack += [(k, k) for k in kids]  # popped first
                else:
                    m = a["members"]
                    for i in range(len(m)):
                        for j in range(i):
                            self.compare(x, m[i], y, m[j])
            elif a["children"] and (not b["children"] or len(a["members"]) >= len(b["members"])):
                stack += [(k, b) for k in a["children"]]
            elif b["children"]:
                stack += [(a, k) for k in b["children"]]
            else:
                for i in a["members"]:
                    for j in b["members"]:
                        self.compare(x, i, y, j)


def links_of(sets: list[np.ndarray], num: int, den: int, same: list[int] | None = None) -> list[tuple[int, int]]:
    """Enough linked pairs (positions) to connect each component. same: a label per set; equal labels are connected already."""
    if len(sets) < 2:
        return []
    sizes = [len(s) for s in sets]
    width = 256
    while width < 4 * max(sizes) and width < 1 << 16:
        width *= 2
    bits = {}
    for i, s in enumerate(sets):
        line = np.zeros(width, np.uint8)
        line[(s % np.uint64(width)).astype(np.int64)] = 1
        bits[i] = int.from_bytes(np.packbits(line).tobytes(), "big")

    def exact(i: int, j: int) -> bool:
        x, y = (sets[i], sets[j]) if sizes[i] <= sizes[j] else (sets[j], sets[i])
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        overlap = int((y[at] == x).sum())
        return den * overlap >= num * (len(x) + len(y) - overlap)

    tree = SignatureTree(list(range(len(sets))), sizes, bits)
    join = DualJoin(len(sets), num, den, same, exact)
    join.run(tree, tree)
    return join.out


def maybe_links_of(sizes: list[int], maps: list[bytes], num: int, den: int, same: list[int] | None = None) -> list[tuple[int, int]]:
    """Like ``links_of`` by sizes and bitmaps alone: pairs that may link, enough to connect each component of all pairs that may.

    Sets of one width of bitmaps are a tree. Of a wider one, the sets that can link with a narrower are folded to its width.
    """
    if len(sizes) < 2:
        return []
    join = DualJoin(len(sizes), num, den, same, None)
    by_width: dict[int, list[int]] = {}
    for i, m in enumerate(maps):
        by_width.setdefault(8 * len(m), []).append(i)
    widths = sorted(by_width)
    for k, width in enumerate(widths):
        own = by_width[width]
        tree = SignatureTree(own, sizes, {i: int.from_bytes(maps[i], "little") for i in own})
        join.run(tree, tree)
        largest = max(sizes[i] for i in own)
        for wider in widths[k + 1 :]:
            near = [i for i in by_width[wider] if sizes[i] * num <= largest * den]
            if near:
                join.run(tree, SignatureTree(near, sizes, {i: fold(int.from_bytes(maps[i], "little"), wider, width) for i in near}))
    return join.out


def fold(bits: int, width: int, to: int) -> int:
    """A bitmap at a smaller width: positions modulo that width."""
    while width > to:
        width //= 2
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that can be reached.

    Alternating large-star and small-star steps, which end after O(log^2) rounds; nodes of many neighbours are joined
    apart from the others (see ``join_hot``).
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    last, n = None, now.count()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("rows"))
        large = join_hot(both.where("v > u"), low, "u", "rows", n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("rows"))
        small = join_hot(large, low, "u", "rows", n).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        before, now = now, materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "star")
        discard(before)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == last:
            break
        last, n = state, state[0]
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def members(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, n_shingles, node, check, bits) of each row; node, check and bits are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(p.words)
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                sets = [shingler.set_of(text.as_py()) for text in b.column(1)]
                hashes = [node_of(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0), pa.array(map(len, sets), pa.int64()), pa.array([h[0] for h in hashes], pa.int64()), pa.array([h[1] for h in hashes], pa.int64()),
                        pa.array([bitmap_of(s) if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "node", "check", "bits"],
                )

    frame = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return map_arrow(frame, run, "doc_id long, n_shingles long, node long, check long, bits binary")


def nodes_of(rows: DataFrame) -> DataFrame:
    """(node, check, vid, doc_id, n, copies, bits): one row per distinct set. vid is its number from here on: node, or a further hash where sets clash in node."""
    nodes = materialize(
        rows.where("node is not null").groupBy("node", "check").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("bits").alias("bits")),
        "nodes",
    )
    clash = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.min("check").alias("own")).where("k > 1").select("node", "own")
    if clash.isEmpty():
        return nodes.withColumn("vid", F.col("node"))
    return nodes.join(clash, "node", "left").withColumn("vid", F.when(F.col("own").isNull() | (F.col("own") == F.col("check")), F.col("node")).otherwise(F.xxhash64("node", "check"))).drop("own")


def candidate_edges(docs: DataFrame, p: Params) -> DataFrame:
    """(a, b): each key's hub with each of its other nodes, but for common keys that can be left out.

    A key of more than ``p.common`` nodes is common. A set with at most its slack of common keys in a band leaves them
    out: with any set that it links to it shares slack + 1 keys there, so one at least that isn't common, and neither
    leaves that out. What is left of common keys belongs to large groups of near copies.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bands = Shingler(p.words), _bands(p.num, p.den)
        recent: set[int] = set()
        keys: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        spare: list[np.ndarray] = []
        held = 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, nodes, spare)], names=["key", "node", "slack"])

        for b in batches:
            for text in b.column(0):
                s = shingler.set_of(text.as_py())
                if len(s) < bands.least:
                    continue
                node, check = node_of(s)
                both = node << 64 | check & (1 << 64) - 1
                if both in recent:  # copies in one task count once
                    continue
                if len(recent) > _KNOWN:
                    recent.clear()
                recent.add(both)
                k, slack = bands.keys(s)
                keys.append(k.view(np.int64))
                nodes.append(np.full(len(k), node, np.int64))
                spare.append(slack)
                held += len(k)
                if held > 100_000:
                    yield rows()
                    for x in (keys, nodes, spare):
                        x.clear()
                    held = 0
        if held:
            yield rows()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by key and node. Of small groups (first node, other node, null); of common keys (key, node, its slack)."""
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int16)]  # rows of the last key so far
        open_key = None  # a common key of which rows went out already

        def out(k: np.ndarray, n: np.ndarray, spare: np.ndarray) -> Iterator[pa.RecordBatch]:
            fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (n[1:] != n[:-1])))
            k, n, spare = k[fresh], n[fresh], spare[fresh]
            first = np.concatenate(([True], k[1:] != k[:-1]))
            start = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            common = np.diff(np.append(start, len(k)))[group] > p.common
            if open_key is not None:
                common |= k == open_key
            star = ~first & ~common
            pairs = np.unique(np.stack([n[start[group[star]]], n[star]], 1), axis=0) if star.any() else np.zeros((0, 2), np.int64)
            a, b = np.concatenate([pairs[:, 0], k[common]]), np.concatenate([pairs[:, 1], n[common]])
            if len(a):
                slack = np.concatenate([np.zeros(len(pairs), np.int16), spare[common]])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(slack, mask=np.arange(len(a)) < len(pairs))], names=["a", "b", "slack"])

        for b in batches:
            held = [np.concatenate([x, b.column(i).to_numpy()]) for i, x in enumerate(held)]
            if not len(held[0]):
                continue
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                yield from out(*(x[:last] for x in held))
                open_key = None
            held = [x[last:] for x in held]
            if len(held[0]) > 100_000:  # one key fills a batch: its distinct nodes go on, or out if there are many
                _, at = np.unique(held[1], return_index=True)
                held = [x[at] for x in held]
                if len(at) > p.common:
                    open_key = int(held[0][0])
                    yield from out(*held)
                    held = [x[-1:] for x in held]
        if len(held[0]):
            yield from out(*held)

    rows = map_arrow(docs.select(F.col("text").cast("binary")), emit, "key long, node long, slack short")
    found = materialize(map_arrow(rows.repartition("key").sortWithinPartitions("key", "node"), meet, "a long, b long, slack short"), "candidates")
    del rows
    release(docs.sparkSession)  # the keys are by far the largest shuffle
    common = found.where("slack is not null").select(F.col("a").alias("key"), F.col("b").alias("node"), F.col("a").bitwiseAND(F.lit(63)).alias("band"), "slack").distinct()
    rich = common.groupBy("node", "band").agg(F.count(F.lit(1)).alias("n"), F.min("slack").alias("spare")).where("n > spare").select("node", "band", "n")
    kept = common.join(rich, ["node", "band"])
    hubs = kept.groupBy("key").agg(F.max(F.struct("n", "node"))["node"].alias("a"))  # the set with most common keys is a hub to most of its group
    stars = kept.join(hubs, "key").where("a <> node").select("a", F.col("node").alias("b"))
    return found.where("slack is null").select("a", "b").unionByName(stars).distinct()


def _group_links(rows: DataFrame, p: Params) -> DataFrame:
    """(a, b) of linked sets from rows (group, vid, n, same, tokens): one signature tree per group.

    tokens is a set, or its bitmap if the rows have no sets: then pairs that may link are found.
    """
    sets_given = "tokens" in rows.columns
    what = "tokens" if sets_given else "bits"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, vids, sizes, same, held = None, [], [], [], []
        found: list[tuple[int, int]] = []

        def finish() -> None:
            labels = None if all(x is None for x in same) else [v if x is None else x for v, x in zip(vids, same, strict=True)]
            if sets_given:
                got = links_of([np.frombuffer(x, np.uint64) for x in held], p.num, p.den, labels)
            else:
                got = maybe_links_of(sizes, held, p.num, p.den, labels)
            found.extend((vids[i], vids[j]) for i, j in got)

        for b in batches:
            for g, v, n, s, x in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4), strict=True):
                if g != group:
                    finish()
                    group, vids, sizes, same, held = g, [], [], [], []
                if vids and vids[-1] == v:
                    continue
                vids.append(v)
                sizes.append(n)
                same.append(s)
                held.append(x.as_py())
            if found:
                yield pairs(found)
                found.clear()
        finish()
        if found:
            yield pairs(found)

    def pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    placed = rows.select("group", "vid", "n", "same", what).repartition("group").sortWithinPartitions("group", "vid")
    return map_arrow(placed, run, "a long, b long")


def _joined(rows: DataFrame, piece: int, p: Params, cut: bool) -> DataFrame:
    """(a, b) that connect all linked sets of one block. rows: (block, total, vid, n, tokens or bits). cut: some block exceeds a piece (rows are then read more than once)."""
    what = "tokens" if "tokens" in rows.columns else "bits"
    none = F.lit(None).cast("long")
    small = rows.where(F.col("total") <= piece) if cut else rows
    found = _group_links(small.select(F.xxhash64("block").alias("group"), "vid", "n", none.alias("same"), what), p)
    if not cut:
        return found
    large = rows.where(F.col("total") > piece)
    pieces = F.ceil(F.col("total") / piece).cast("int")
    draw = F.pmod(F.xxhash64("vid", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    pivot = draw * F.col("total") < F.lit(float(p.pivots)) * F.col("n")
    dealt = large.withColumn("piece", F.explode(F.when(pivot, F.sequence(F.lit(0), pieces - 1)).otherwise(F.array(F.pmod(F.xxhash64("vid"), pieces.cast("long")).cast("int")))))
    first = _group_links(dealt.select(F.xxhash64("block", "piece").alias("group"), "vid", "n", none.alias("same"), what), p)
    first = materialize(found.unionByName(first), "links")
    return first.unionByName(_cross_links(large, components(first), piece, p))


def _cross_links(large: DataFrame, known: DataFrame, piece: int, p: Params) -> DataFrame:
    """Links between different components of one block that is in pieces."""
    what = "tokens" if "tokens" in large.columns else "bits"
    rows = large.join(known.withColumnRenamed("node", "vid"), "vid", "left").withColumn("root", F.coalesce("root", "vid"))
    held = rows.groupBy("block", "root").agg(F.sum("n").alias("held"))
    others = held.groupBy("block").agg(F.count("*").alias("roots"), F.sum(F.when(F.col("held") <= piece, F.col("held")).otherwise(0)).alias("rest")).where("roots > 1")
    rows = rows.join(held, ["block", "root"]).join(others, "block")
    big = F.col("held") > piece
    owner = F.when(big, F.col("root"))  # null: a piece of small components
    count = F.when(big, F.ceil(F.col("held") / piece)).otherwise(F.greatest(F.ceil(F.col("rest") / piece), F.lit(1)))
    part = F.pmod(F.when(big, F.xxhash64("vid")).otherwise(F.xxhash64("root")), count.cast("long"))
    rows = materialize(rows.select("block", "root", "vid", "n", what, owner.alias("owner"), F.struct(owner.alias("owner"), part.alias("part")).alias("piece")), "pieces")
    partners = rows.select("block", F.col("piece").alias("partner")).distinct()
    crossed = rows.join(partners, "block").where(F.col("owner").isNull() | F.col("partner.owner").isNull() | (F.col("owner") != F.col("partner.owner")))
    pair = F.xxhash64("block", F.least("piece", "partner"), F.greatest("piece", "partner"))
    return _group_links(crossed.select(pair.alias("group"), "vid", "n", F.col("root").alias("same"), what), p)


def _token_sets(docs: DataFrame, wanted: DataFrame, p: Params) -> DataFrame:
    """(vid, n, block, total, tokens) for wanted (doc_id, node, check, vid, n, block, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(p.words)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                keep, tokens = [], []
                for i, (text, *both) in enumerate(zip(part.column(0), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    s = shingler.set_of(text.as_py())
                    if node_of(s) == tuple(both):  # another row may have the same doc_id
                        keep.append(i)
                        tokens.append(s.tobytes())
                part = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[3:], pa.array(tokens, pa.binary())], names=["vid", "n", "block", "total", "tokens"])

    def sets(texts: DataFrame) -> DataFrame:
        return map_arrow(texts.select("text", "node", "check", "vid", "n", "block", "total"), run, "vid long, n long, block long, total long, tokens binary")

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    few = wanted.count() <= p.broadcast_rows  # of 56 bytes each
    numbered = wanted.where("doc_id is not null")
    out = sets(texts.join(F.broadcast(numbered) if few else numbered, "doc_id"))
    bare = wanted.where("doc_id is null")
    if bare.isEmpty():
        return out

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(p.words)
        for b in batches:
            both = [node_of(shingler.set_of(x.as_py())) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([h[k] for h in both], pa.int64()) for k in (0, 1))], names=["text", "node", "check"])

    unnamed = map_arrow(texts.where("doc_id is null").select("text"), hashed, "text binary, node long, check long")  # found by their sets
    return out.unionByName(sets(unnamed.join(F.broadcast(bare) if few else bare, ["node", "check"]).dropDuplicates(["vid"])))


def links(docs: DataFrame, nodes: DataFrame, p: Params) -> DataFrame:
    """(vid, root) of every set that is linked with another. nodes: see ``nodes_of``.

    Bitmaps go to the blocks of all hubs of a set; a set itself goes to one group alone, the component of the pairs that
    the bitmaps allow: two sets that link are such a pair in the block of a hub they share.
    """
    edges = materialize(candidate_edges(docs, p), "edges")
    hubs = edges.select(F.col("a").alias("block")).distinct()
    placed = edges.select(F.col("a").alias("block"), F.col("b").alias("node")).unionByName(hubs.withColumn("node", F.col("block")))
    placed = materialize(placed.join(nodes.select("node", "vid", "n", "bits"), "node").select("block", "vid", "n", "bits"), "placed")
    discard(edges)
    placed, cut = _with_totals(placed, 8 * p.piece, p)  # a bitmap takes a sixteenth of its set at most
    maybe = materialize(_joined(placed, 8 * p.piece, p, cut), "maybe")
    discard(placed)
    group = materialize(components(maybe), "groups").select(F.col("node").alias("vid"), F.col("root").alias("block"))
    wanted = group.join(nodes.select("vid", "node", "check", "doc_id", "n"), "vid")
    wanted, cut = _with_totals(materialize(wanted, "wanted"), p.piece, p)
    sets = _token_sets(docs, wanted, p)
    if cut:
        sets = materialize(sets, "sets")
    return components(_joined(sets, p.piece, p, cut)).withColumnRenamed("node", "vid")


def _with_totals(rows: DataFrame, piece: int, p: Params) -> tuple[DataFrame, bool]:
    """rows with the sum of n of their block as total where that is above piece, else 0; and whether any is."""
    totals = materialize(rows.groupBy("block").agg(F.sum("n").alias("total")).where(F.col("total") > piece), "totals")
    n = totals.count()
    if not n:
        return rows.withColumn("total", F.lit(0).cast("long")), False
    return rows.join(F.broadcast(totals) if n <= p.broadcast_rows else totals, "block", "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long"))), True


def _classed(docs: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, node, check), and (node, check, copies, root) of all sets."""
    rows = materialize(members(docs, p), "members")
    nodes = nodes_of(rows)
    linked = materialize(links(docs, nodes, p), "linked")
    found = nodes.drop("bits").join(linked, "vid", "left").select("node", "check", "doc_id", "copies", F.coalesce("root", "vid").alias("root"))
    return rows.drop("bits"), materialize(found, "classes")


def classes(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id."""
    rows, found = _classed(docs, p or Params())
    lowest = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_set = found.join(lowest, "root").select(F.struct("node", "check").alias("set"), "copies", "component_id")
    full = rows.where("node is not null").select("doc_id", "n_shingles", F.struct("node", "check").alias("set"))
    named = join_hot(full, by_set, "set", "copies", rows.count()).select("doc_id", "n_shingles", "component_id")
    return named.unionByName(rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """One document of each class, the one with the smallest doc_id (null last), with all its columns.

    Documents whose doc_id is theirs alone go by an anti-join with the doc_ids of those that are not the first of their
    class. Rows without doc_id or that share one are found by their sets as well; of rows alike in both, one stays.
    """
    p = p or Params()
    rows, found = _classed(docs, p)
    place = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "node", "check")
    first = found.groupBy("root").agg(F.min(place).alias("first"))
    winners = found.join(first, "root").select(F.struct("node", "check").alias("set"), "copies", "first")
    full = rows.where("node is not null").select("doc_id", "node", "check", F.struct("node", "check").alias("set"))
    judged = join_hot(full, winners, "set", "copies", rows.count()).select("doc_id", "set", "first", (place == F.col("first")).alias("stays"))
    shared = materialize(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("doc_id is null or k > 1").select("doc_id"), "shared")
    gone = materialize(judged.where("not stays and doc_id is not null").select("doc_id").unionByName(shared.where("doc_id is not null")).distinct().select(F.col("doc_id").alias("__gone")), "gone")
    alone = docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(gone) if gone.count() <= p.broadcast_rows else gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
    if shared.isEmpty():
        return alone
    return alone.unionByName(_keep_one_shared(docs, judged, shared, p))


def _keep_one_shared(docs: DataFrame, judged: DataFrame, shared: DataFrame, p: Params) -> DataFrame:
    """Of the rows whose doc_id is null or repeated: those with an empty set, and one of each that is first of its class."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    packed = packed.join(shared.select(F.col("doc_id").alias("__shared")), F.col("doc_id").eqNullSafe(F.col("__shared")), "left_semi")
    kind = packed.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(p.words)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                sets = [shingler.set_of(x.as_py()) for x in part.column(2)]
                both = [node_of(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([h[k] for h in both], pa.int64()) for k in (0, 1))], names=["row", "doc_id", "node", "check"])

    tagged = map_arrow(packed, run, f"row {kind}, doc_id long, node long, check long")
    stays = judged.where("stays").select("doc_id", "set").distinct().select(F.col("doc_id").alias("id"), "set.node", "set.check")
    full = tagged.where("node is not null").join(stays, ["node", "check"]).where(F.col("doc_id").eqNullSafe(F.col("id")))
    one = full.groupBy("doc_id", "node", "check").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return tagged.where("node is null").select("row").unionByName(one.select("row")).select(*[F.col("row")[c].alias(c) for c in names])
