"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items become sequences of word hashes (A-Z as a-z, ASCII punctuation as white space). An item of L words is
found in a text if at most k = floor(L (1 - similarity)) word edits turn it into some stretch of the text.

1. Windows. Items fall into classes of length (a class ends where the next, half as long again, begins). For each class
   with items a window starts at every S-th word of a text, S an eighth of the class's length.
2. CGK. A walk over a window copies the word it stands on at each step and moves on if a random bit of (step, word)
   says so. Edit distance between sequences becomes Hamming distance between walks: after an edit two walks soon meet
   again. The bits of 64 steps are one hash of a word, computed once per word and walk.
3. LSH. A table samples ``bits`` steps, one from each equal part of the walk; a window is compared with the entries that
   agree with it in all samples of a table. An item is entered at every offset in its first part, so that a window needn't
   begin where the item does, and several windows of one stretch each have their chance. The number of tables is chosen
   per class by trying items of random words at k edits: the smallest number that finds ``recall`` of them.
4. Filter. A candidate whose stretch holds fewer than L - k of the item's words is dropped, which loses nothing.
5. Each candidate left is verified by the exact edit distance between item and the best stretch around the window.

A class for which ``max_tables`` tables don't reach ``recall`` (long items at a low similarity) takes its candidates from
an exact index instead: by the q-gram lemma a stretch shares at least L - q + 1 - k q runs of q words with the item near one
diagonal, which loses nothing. ``measured_recall`` reports what each class of a benchmark takes and reaches.

Items come to the workers as texts, in blocks of at most ``block_bytes``, by broadcast; each worker indexes a block once.
Each block is one pass over the texts, so the number of items is not bounded by a worker's memory.

Edge cases: null and empty texts hold nothing; items without words are not searched, items too short for an edit are
searched exactly. Repeated items are reported each under its own item_id, repeated texts each under its own doc_id, and
rows that repeat a doc_id once with the least edits (ties: the first place). An empty table of either kind gives an empty
result. Very long texts are searched whole. Further columns are ignored, and kept by ``keep_clean``, which judges each row
by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .jaccard_join import mix

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLEAN = bytes(32 if i in _PUNCTUATION else i + 32 if 65 <= i <= 90 else i for i in range(256))
_RUN = np.uint64(0x9E3779B97F4A7C15)
_KNOWN = 200_000
_TRIES = 300
_SLICE = 50_000  # words that are searched together, if not one text alone has more


@dataclass(frozen=True)
class Params:
    """steps bounds the length of a walk."""

    similarity: float = 0.8
    recall: float = 0.97
    bits: int = 3
    max_tables: int = 48
    walks: int = 2
    steps: int = 256
    block_bytes: int = 4 << 20
    seed: int = 11

    def edits(self, n: int) -> int:
        return int(n * (1 - self.similarity) + 1e-9)


class Words:
    """Sequences of word hashes."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, text: bytes | None) -> np.ndarray:
        import xxhash

        words = (text or b"").translate(_CLEAN).split()
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) > _KNOWN:
                known.clear()
                new = set(words)
            known.update((w, xxhash.xxh3_64_intdigest(w) | 1) for w in new)  # 0 is no word
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def class_of(n: int) -> tuple[int, int]:
    """The class [low, high) of a length."""
    low = 1
    while True:
        high = low + max(1, low // 2)
        if n < high:
            return low, high
        low = high


@dataclass(frozen=True)
class Shape:
    """How a class is walked: stride of windows, steps of a walk, samples (tables x bits). No samples: the exact index."""

    low: int
    stride: int
    steps: int
    samples: tuple[tuple[int, ...], ...]
    recall: float

    def offsets(self, n: int) -> int:
        """An item of n words is entered at this many offsets."""
        return max(self.stride, n * 2 // 5)


class Walks:
    """CGK walks over the positions of one long sequence of words, which ends in zeros."""

    def __init__(self, h: np.ndarray, p: Params) -> None:
        self.h, self.p = h, p
        self.bits: dict[tuple[int, int], np.ndarray] = {}

    def _bits(self, walk: int, part: int) -> np.ndarray:
        got = self.bits.get((walk, part))
        if got is None:
            seed = mix(np.array([self.p.seed + 1000 * walk + part], np.uint64) * _RUN)
            got = self.bits[walk, part] = mix(self.h ^ seed)
        return got

    def keys(self, starts: np.ndarray, shape: Shape) -> np.ndarray:
        """(starts, tables): hashes of the sampled words of the walks from these positions; 0 where a walk has left the words."""
        tables = len(shape.samples)
        out = np.empty((tables, len(starts)), np.uint64)
        for w in range(min(self.p.walks, tables)):
            own = range(w, tables, self.p.walks)
            needed = {t for j in own for t in shape.samples[j]}
            seen: dict[int, np.ndarray] = {}
            at = starts.copy()
            for t in range(max(needed) + 1):
                if t in needed:
                    seen[t] = self.h[at]
                at += ((self._bits(w, t >> 6)[at] >> np.uint64(t & 63)) & np.uint64(1)).astype(np.int64)
            for j in own:
                key = np.full(len(starts), j + 1, np.uint64)
                whole = np.ones(len(starts), bool)
                with np.errstate(over="ignore"):
                    for t in shape.samples[j]:
                        key = (key ^ seen[t]) * _RUN
                        key ^= key >> np.uint64(29)
                        whole &= seen[t] != 0
                out[j] = np.where(whole, key | np.uint64(1), np.uint64(0))
        return out.T


def laid_out(texts: list[np.ndarray], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one sequence, each followed by ``gap`` zeros, and where each begins."""
    sizes = np.array([len(t) + gap for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    h = np.zeros(int(sizes.sum()), np.uint64)
    for b, t in zip(begin, texts, strict=True):
        h[b : b + len(t)] = t
    return h, begin


def spread(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ..."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def entries(items: list[np.ndarray], shape: Shape, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, table) keys of the items at their offsets, and each entry's item and offset."""
    h, begin = laid_out(items, shape.steps + 1)
    n = np.array([shape.offsets(len(x)) for x in items], np.int64)
    item, offset = np.repeat(np.arange(len(items)), n), spread(n)
    return Walks(h, p).keys(begin[item] + offset, shape), item, offset


def window_starts(sizes: np.ndarray, begin: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all windows of laid out texts, and the text of each."""
    n = -(-sizes // stride)
    return np.repeat(begin, n) + stride * spread(n), np.repeat(np.arange(len(sizes)), n)


def edited(h: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """h after k random edits."""
    x = list(h)
    for _ in range(k):
        kind, i = rng.integers(3), int(rng.integers(max(1, len(x))))
        fresh = np.uint64(rng.integers(1, 1 << 63))
        if kind == 0 and x:
            x[i] = fresh
        elif kind == 1:
            x.insert(i, fresh)
        elif x:
            del x[i]
    return np.array(x, np.uint64)


@lru_cache(maxsize=256)
def shape_of(low: int, high: int, p: Params) -> Shape:
    """The tables of a class: as many as find p.recall of the tries with its longest items (those of most edits a word)."""
    stride, steps = max(1, low // 8), min(low, p.steps)
    rng = np.random.default_rng((p.seed, low))
    bits = min(p.bits, steps)
    edges = [steps * i // bits for i in range(bits + 1)]
    samples = tuple(tuple(int(rng.integers(edges[i], edges[i + 1])) for i in range(bits)) for _ in range(p.max_tables))
    full = Shape(low, stride, steps, samples, 0.0)
    size = max((n for n in range(low, high)), key=lambda n: (p.edits(n) / n, n)) if high - low < 1000 else high - 1
    base = [rng.integers(1, 1 << 63, size).astype(np.uint64) for _ in range(_TRIES)]
    texts = []
    for x in base:
        before, after = (rng.integers(1, 1 << 63, int(k)).astype(np.uint64) for k in (rng.integers(stride), steps))
        texts.append(np.concatenate([before, edited(x, p.edits(size), rng), after]))
    own, item, _ = entries(base, full, p)
    h, begin = laid_out(texts, steps + 1)
    starts, text = window_starts(np.array([len(t) for t in texts]), begin, stride)
    other = Walks(h, p).keys(starts, full)
    found = np.zeros((_TRIES, p.max_tables), bool)
    for i in range(_TRIES):
        a, b = own[item == i], other[text == i]
        found[i] = ((a[:, None, :] == b[None, :, :]) & (a[:, None, :] != 0)).any((0, 1))
    reached = np.maximum.accumulate(found, 1).mean(0)
    enough = np.flatnonzero(reached >= p.recall)
    if not len(enough):
        return Shape(low, 1, steps, (), 1.0)
    tables = min(p.max_tables, int(enough[0]) + 2)
    return Shape(low, stride, steps, samples[:tables], float(reached[tables - 1]))


def runs(h: np.ndarray, q: int) -> np.ndarray:
    if len(h) < q:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(len(h) - q + 1, q, np.uint64)
        for i in range(q):
            total = mix(total * _RUN + h[i : len(h) - q + 1 + i])
    return total


class Postings:
    """Sorted keys with their items and offsets, behind a bitmap of the keys that occur."""

    def __init__(self, keys: np.ndarray, item: np.ndarray, offset: np.ndarray) -> None:
        ok = keys != 0
        keys, item, offset = keys[ok], item[ok], offset[ok]
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.offset = keys[order], item[order].astype(np.int32), offset[order].astype(np.int32)
        self.shift = np.uint64(64 - max(16, min(26, int(16 * len(keys)).bit_length())))
        self.some = np.zeros(1 << (64 - int(self.shift)), bool)
        self.some[(mix(self.keys) >> self.shift).astype(np.int64)] = True

    def find(self, keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place - offset) of all entries that equal a key."""
        at = np.flatnonzero(self.some[(mix(keys) >> self.shift).astype(np.int64)] & (keys != 0))
        keys, places = keys[at], places[at]
        first, end = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
        n = end - first
        flat = np.repeat(first, n) + spread(n)
        return self.item[flat].astype(np.int64), np.repeat(places, n) - self.offset[flat]


def least_edits(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Per row of text: the least edits between the item and any stretch of the row (0 is no word)."""
    place = np.arange(text.shape[1] + 1)
    row = np.zeros((len(text), text.shape[1] + 1), np.int64)
    for i, word in enumerate(item):
        step = np.minimum(row[:, 1:] + 1, row[:, :-1] + (text != word))
        row = np.minimum.accumulate(np.concatenate((np.full((len(text), 1), i + 1), step), 1) - place, 1) + place
    return row.min(1)


class Index:
    """The items of one block by classes."""

    def __init__(self, items: list[tuple[int | None, bytes]], p: Params) -> None:
        self.p = p
        words = Words()
        found = [(item_id, words.of(text)) for item_id, text in items]
        self.ids = [i for i, h in found if len(h)]
        self.seqs = [h for _, h in found if len(h)]
        self.k = np.array([p.edits(len(h)) for h in self.seqs], np.int64)
        by_class: dict[tuple[int, int], list[int]] = {}
        for i, h in enumerate(self.seqs):
            by_class.setdefault(class_of(len(h)), []).append(i)
        self.shapes = {c: shape_of(*c, p) for c in sorted(by_class)}
        self.gap = max((s.steps for s in self.shapes.values()), default=0) + 1
        self.tables: list[tuple[Shape, Postings]] = []
        exact: list[int] = []
        for c, shape in self.shapes.items():
            own = np.array(by_class[c])
            if not shape.samples:
                exact += by_class[c]
                continue
            keys, item, offset = entries([self.seqs[i] for i in own], shape, p)
            tables = keys.shape[1]
            self.tables.append((shape, Postings(keys.ravel(), np.repeat(own[item], tables), np.repeat(offset, tables))))
        self._by_runs(exact)

    def _by_runs(self, own: list[int]) -> None:
        self.runs: dict[int, Postings] = {}
        self.need: dict[int, int] = {}
        by_q: dict[int, list[int]] = {}
        for i in own:
            n, k = len(self.seqs[i]), int(self.k[i])
            q = next((q for q in (4, 3, 2) if n - q + 1 - k * q >= 1), 1)
            self.need[i] = max(1, n - q + 1 - k * q)
            by_q.setdefault(q, []).append(i)
        for q, items in by_q.items():
            g = [runs(self.seqs[i], q) for i in items]
            n = np.array([len(x) for x in g], np.int64)
            self.runs[q] = Postings(np.concatenate(g), np.repeat(np.array(items), n), spread(n))

    def _exact_windows(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, start) with enough shared runs around the diagonal."""
        out: list[tuple[int, int]] = []
        for q, postings in self.runs.items():
            g = runs(h, q)
            items, starts = postings.find(g, np.arange(len(g)))
            order = np.lexsort((starts, items))
            items, starts = items[order], starts[order]
            for i in np.unique(items):
                lo, hi = np.searchsorted(items, i), np.searchsorted(items, i, "right")
                s, reach = starts[lo:hi], 2 * int(self.k[i])
                near = np.searchsorted(s, s + reach, "right") - np.searchsorted(s, s - reach, "left")
                out += [(int(i), int(x)) for x in s[near >= self.need[int(i)]]]
        both = np.array(out, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def search(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, start of the window) of verified finds, the least edits of each text and item."""
        if not self.seqs or not texts:
            return []
        h, begin = laid_out(texts, self.gap)
        sizes = np.array([len(t) for t in texts], np.int64)
        walks = Walks(h, self.p)
        items, starts, owners = [], [], []
        for shape, postings in self.tables:
            at, text = window_starts(sizes, begin, shape.stride)
            keys = walks.keys(at, shape)
            tables = keys.shape[1]
            item, place = postings.find(keys.ravel(), np.repeat(np.arange(len(at)) * (1 << 20), tables))
            window = -(-place // (1 << 20))  # place is the window's number times 2^20, less the offset
            items.append(item)
            starts.append(at[window] - (window * (1 << 20) - place))
            owners.append(text[window])
        if self.runs:
            for d, t in enumerate(texts):
                item, start = self._exact_windows(t)
                items.append(item)
                starts.append(start + begin[d])
                owners.append(np.full(len(item), d))
        item, start, text = (np.concatenate(x) for x in (items, starts, owners))
        if not len(item):
            return []
        item, text, start = np.unique(np.stack([item, text, start]), axis=1)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for i in np.unique(item):
            lo, hi = np.searchsorted(item, i), np.searchsorted(item, i, "right")
            self._verify(int(i), text[lo:hi], start[lo:hi], h, begin, sizes, best)
        return [(d, i, edits, max(0, s - int(begin[d]))) for (d, i), (edits, s) in sorted(best.items())]

    def _verify(self, i: int, text: np.ndarray, start: np.ndarray, h: np.ndarray, begin: np.ndarray, sizes: np.ndarray, best: dict) -> None:
        seq, k = self.seqs[i], int(self.k[i])
        n = len(seq)
        per = max(1, (1 << 21) // (n + 3 * k + 1))
        known = np.unique(seq)
        for lo in range(0, len(text), per):
            d, s = text[lo : lo + per], start[lo : lo + per]
            at = (s - k)[:, None] + np.arange(n + 3 * k + 1)
            inside = (at >= begin[d][:, None]) & (at < (begin + sizes)[d][:, None])
            stretch = np.where(inside, h[np.clip(at, 0, len(h) - 1)], np.uint64(0))
            place = np.minimum(np.searchsorted(known, stretch), len(known) - 1)
            enough = (known[place] == stretch).sum(1) >= n - k
            if not enough.any():
                continue
            d, s = d[enough], s[enough]
            edits = least_edits(seq, stretch[enough])
            for x, y, e in zip(d.tolist(), s.tolist(), edits.tolist(), strict=True):
                if e <= k and (e, y) < best.get((x, i), (1 << 30, 0)):
                    best[x, i] = (e, y)


_BUILT: dict[tuple, Index] = {}


def built(items: list[tuple[int | None, bytes]], p: Params, key: tuple) -> Index:
    """The index of a block, once per worker process and at most one at a time."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Index(items, p)
    return _BUILT[key]


def blocks_of(benchmark: DataFrame, p: Params) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks of about block_bytes."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    n = -(-total // p.block_bytes)
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n)))
    for b in range(n):
        rows = items.where(number == b).collect()
        if rows:
            yield sorted(((r.item_id, bytes(r.text)) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _slices(texts: pa.Array, words: Words) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The texts as words, about _SLICE of them together, with the row where each slice begins."""
    first, held, size = 0, [], 0
    for i, x in enumerate(texts):
        h = words.of(x.as_py())
        held.append(h)
        size += len(h)
        if size >= _SLICE:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def find(docs: DataFrame, benchmark: DataFrame, p: Params | None = None) -> DataFrame:
    """doc_id, item_id, n_words (of the item), edits, similarity, start_word: one row for each text and item found in it."""
    p = p or Params()
    sc = docs.sparkSession.sparkContext
    schema = "doc_id long, item_id long, n_words long, edits long, start_word long"
    frame = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))

    def searched(items, key: tuple) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, words = built(items.value, p, key), Words()
            for b in batches:
                ids = b.column(0).to_pylist()
                for first, texts in _slices(b.column(1), words):
                    rows = [(ids[first + d], index.ids[i], len(index.seqs[i]), e, s) for d, i, e, s in index.search(texts)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "n_words", "edits", "start_word"])

        return map_arrow(frame, run, schema)

    found = [searched(sc.broadcast(items), _key(items, p)) for items in blocks_of(benchmark, p)]
    if not found:
        return docs.sparkSession.createDataFrame([], schema + ", similarity double")
    every = reduce(DataFrame.unionByName, found)
    least = every.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "start_word", "n_words")).alias("m"))
    return least.select("doc_id", "item_id", "m.n_words", "m.edits", "m.start_word", (1 - F.col("m.edits") / F.col("m.n_words")).alias("similarity"))


def _key(items: list[tuple[int | None, bytes]], p: Params) -> tuple:
    import hashlib

    return hashlib.sha256(repr(items).encode()).hexdigest(), p


def keep_clean(docs: DataFrame, benchmark: DataFrame, p: Params | None = None) -> DataFrame:
    """The documents that hold no item, with all their columns: each row is judged by its own text, in one pass a block."""
    p = p or Params()
    sc, at = docs.sparkSession.sparkContext, docs.columns.index("text")

    def kept(frame: DataFrame, items, key: tuple) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, words = built(items.value, p, key), Words()
            for b in batches:
                bad = np.zeros(b.num_rows, bool)
                for first, texts in _slices(b.column(at).cast(pa.binary()), words):
                    bad[[first + d for d, *_ in index.search(texts)]] = True
                yield b.filter(pa.array(~bad))

        return map_arrow(frame, run, frame.schema)

    for items in blocks_of(benchmark, p):
        docs = kept(docs, sc.broadcast(items), _key(items, p))
    return docs


def measured_recall(benchmark: DataFrame, p: Params | None = None) -> list[tuple[int, int, int, float]]:
    """(least length, length that is too long, tables, recall) of each class of the benchmark's items; no tables: the exact index."""
    p = p or Params()
    classes: set[tuple[int, int]] = set()
    for items in blocks_of(benchmark, p):
        words = Words()
        classes |= {class_of(n) for n in {len(words.of(t)) for _, t in items} if n}
    return [(*c, len(shape_of(*c, p).samples), shape_of(*c, p).recall) for c in sorted(classes)]
