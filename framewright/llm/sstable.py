"""Sorted-string-table shards of token ids: documents keyed by identifier.

A shard file is::

    block*  index  bloom  footer
    block   zlib of entries; entry = varint shared, varint rest, varint value bytes, rest of the key, value
    index   per block: varint key length, first key, varint offset, varint stored bytes, varint entries, varint ids
    bloom   bits of a Bloom filter over the shard's keys
    footer  offsets and lengths of index and bloom, number of hashes, entries, ids, bytes per id, magic

A key shares with the key before it in its block the bytes that ``shared`` counts (0 for the first). Keys are doc_id
as 8 bytes, big-endian with the sign bit flipped, so that bytes sort as numbers; a null doc_id is the empty key and
comes first. Repeated keys are allowed and lie side by side. A value is the ids as little-endian unsigned integers of
2 bytes if all ids of the vocabulary fit, else 4.

Writing: texts are dealt by range of (doc_id, hash of the text), so no single key makes a partition too large, sorted
within, encoded and streamed to one shard per partition in the shared folder, under a temporary name that is renamed
once complete; a task that runs again leaves the same shard. Only a row of counts per shard reaches the driver.
Reading: a document's shards are found by their key ranges, the document by Bloom filter, binary search in the index
(both read once per open shard) and one block.

Edge cases: null and empty texts are stored with their end id alone. An empty table gives no shard. A text larger
than a block has a block of its own. Further columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, shared_path, texts_of

MAGIC = b"FWSST001"
_FOOTER = struct.Struct("<QQQQQQQQ8s")
_CACHE = 400_000


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else ((doc_id + (1 << 63)) & (2**64 - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _hashes(key: bytes, k: int, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h >> 64, h & (2**64 - 1) | 1
    return [(a + i * b) % bits for i in range(k)]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """Writes entries in key order to an open binary file."""

    def __init__(self, sink, id_bytes: int, block_bytes: int = 1 << 18) -> None:
        self.sink, self.id_bytes, self.block_bytes = sink, id_bytes, block_bytes
        self.index: list[bytes] = []
        self.at = self.entries = self.ids = 0
        self.keys: list[bytes] = []
        self._start()

    def _start(self) -> None:
        self.block, self.size, self.first, self.last, self.n, self.n_ids = [], 0, None, b"", 0, 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must come in order")
        shared = len(os.path.commonprefix([key, self.last])) if self.n else 0
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        if self.first is None:
            self.first = key
        self.block += [entry, value]
        self.size += len(entry) + len(value)
        self.n += 1
        self.n_ids += len(value) // self.id_bytes
        self.last = key
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.n:
            return
        data = zlib.compress(b"".join(self.block), 1)
        self.sink.write(data)
        self.index.append(_varint(len(self.first)) + self.first + b"".join(map(_varint, (self.at, len(data), self.n, self.n_ids))))
        self.at += len(data)
        self.entries += self.n
        self.ids += self.n_ids
        self._start()

    def close(self) -> None:
        self._flush()
        index = zlib.compress(b"".join(self.index), 6)
        bits = max(64, 10 * len(self.keys))
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for key in self.keys:
            for h in _hashes(key, 7, bits):
                bloom[h >> 3] |= 1 << (h & 7)
        self.sink.write(index)
        self.sink.write(bloom.tobytes())
        self.sink.write(_FOOTER.pack(self.at, len(index), self.at + len(index), bits, 7, self.entries, self.ids, self.id_bytes, MAGIC))


class Reader:
    """Reads one shard: all of it block by block, or single documents."""

    def __init__(self, uri: str) -> None:
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        at, n, bloom_at, self.bits, self.k, self.entries, self.ids, self.id_bytes, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        self._index = (at, n)
        self._bloom = (bloom_at, (self.bits + 7) // 8)

    @cached_property
    def blocks(self) -> list[tuple[bytes, int, int, int, int]]:
        """First key, offset, stored bytes, entries, ids of each block."""
        data, at, out = zlib.decompress(self.file.read_at(self._index[1], self._index[0])), 0, []
        while at < len(data):
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            numbers = []
            for _ in range(4):
                x, at = _read_varint(data, at)
                numbers.append(x)
            out.append((key, *numbers))
        return out

    def _block(self, offset: int, stored: int) -> Iterator[tuple[bytes, bytes]]:
        data, at, key = zlib.decompress(self.file.read_at(stored, offset)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key, at = key[:shared] + data[at : at + rest], at + rest
            yield key, data[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for _, offset, stored, _, _ in self.blocks:
            yield from self._block(offset, stored)

    @cached_property
    def bloom(self) -> bytes:
        return self.file.read_at(self._bloom[1], self._bloom[0])

    def may_hold(self, key: bytes) -> bool:
        bloom = self.bloom
        return all(bloom[h >> 3] >> (h & 7) & 1 for h in _hashes(key, self.k, self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with this key."""
        key = key_of(doc_id)
        if not self.may_hold(key):
            return []
        blocks = self.blocks
        out = []
        for b in blocks[max(0, bisect.bisect_left(blocks, key, key=lambda b: b[0]) - 1) : bisect.bisect_right(blocks, key, key=lambda b: b[0])]:
            out += [self.values(v) for k, v in self._block(b[1], b[2]) if k == key]
        return out

    def values(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.id_bytes}").astype(np.uint32)

    def close(self) -> None:
        self.file.close()


#: A pre-tokenizer's pattern and normaliser that are known here. Fixed values.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable in Latin-1, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Encoder:
    """ids of whole texts as bytes of little-endian unsigned 32-bit integers, by the tokenizers library.

    Where the tokenizer drops white space, texts are cut there and the library sees each distinct chunk once; a text
    that may hold a special string is given to the library whole. Texts of ASCII and Latin-1 letters, for which the
    known normaliser only lowers case and the known pattern is plain, are cut into its pre-tokens and the library's
    model sees each distinct one once.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size()
        pre, norm = json.dumps(spec.get("pre_tokenizer")), json.dumps(spec.get("normalizer"))
        self.by_chunk = '"behavior": "Removed", "invert": true' in pre and "\\\\s+" in norm
        self.special = sorted({a["content"] for a in spec.get("added_tokens") or []})
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        self.plain = (
            self.by_chunk
            and (spec.get("normalizer") or {}).get("normalizers") == _NORMAL
            and [x["type"] for x in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"] == {"Regex": _PATTERN}
            and not steps[1]["add_prefix_space"]
            and not steps[1]["use_regex"]
        )
        self.odd = re.compile("[^ -~\\t\\n\\r\x0b\x0cÀ-ÖØ-öø-ÿ]").search
        self.cut = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+").findall
        self.symbols = byte_symbols()
        self.known: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, words: list[str]) -> list[bytes]:
        """ids of pre-tokens."""
        model, symbols = self.tok.model.tokenize, self.symbols
        out = []
        for w in words:
            raw = w if w.isascii() else "".join(symbols[b] for b in w.encode())
            out.append(np.array([t.id for t in model(raw)], "<u4").tobytes())
        return out

    def _joined(self, split: list[list[str]], known: dict[str, bytes], encode) -> list[bytes]:
        new = set().union(*split).difference(known)
        if len(known) + len(new) > _CACHE:
            known.clear()
            new = set().union(*split)
        fresh = list(new)
        for lo in range(0, len(fresh), 20_000):
            part = fresh[lo : lo + 20_000]
            known.update(zip(part, encode(part), strict=True))
        get = known.__getitem__
        return [b"".join(map(get, parts)) for parts in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        whole, chunks, pieces = [], [], []
        for i, t in enumerate(texts):
            special = any(s in t for s in self.special)
            (whole if special or not self.by_chunk else pieces if self.plain and not self.odd(t) else chunks).append(i)
        for at, got in (
            (whole, self._whole([texts[i] for i in whole])),
            (chunks, self._joined([texts[i].replace("\n", " ").split(" ") for i in chunks], self.chunks, self._whole)),
            (pieces, self._joined([self.cut(texts[i].lower()) for i in pieces], self.known, self._pieces)),
        ):
            for i, ids in zip(at, got, strict=True):
                out[i] = ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, path: str, to: str, end_id: int | None = 2) -> DataFrame:
    """Write shards under the URI ``to``; a table of them: shard, file, first (ids before it), n_docs, n_ids, low and high (least and greatest doc_id; null is the least)."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("doc_id must be an integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        enc = encoder(path)
        tail = b"" if end_id is None else struct.pack("<I", end_id)
        id_bytes = 2 if max(enc.size, end_id or 0) < 1 << 16 else 4
        fs, root = _open(to)
        name = f"shard-{task.partitionId():06d}.sst"
        draft = f"{root}/.{name}.{task.taskAttemptId()}"
        writer = sink = None
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(draft)
                    writer = Writer(sink, id_bytes)
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(texts_of(part.column(1))), strict=True):
                    value = ids + tail
                    writer.add(key_of(doc_id), np.frombuffer(value, "<u4").astype("<u2").tobytes() if id_bytes == 2 else value)
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([task.partitionId()], pa.int64()), pa.array([f"{to}/{name}"], pa.string()), pa.array([writer.entries], pa.int64()), pa.array([writer.ids], pa.int64()),
                    pa.array([id_of(writer.keys[0])], pa.int64()), pa.array([id_of(writer.keys[-1])], pa.int64()),
                ],
                names=["shard", "file", "n_docs", "n_ids", "low", "high"],
            )

    placed = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.col("doc_id"), F.xxhash64("text"))
    rows = map_arrow(placed.sortWithinPartitions(F.col("doc_id"), F.xxhash64("text")), run, "shard long, file string, n_docs long, n_ids long, low long, high long").collect()
    first, out = 0, []
    for r in sorted(rows, key=lambda r: r.shard):
        out.append((r.shard, r.file, first, r.n_docs, r.n_ids, r.low, r.high))
        first += r.n_ids
    return spark.createDataFrame(out, "shard long, file string, first long, n_docs long, n_ids long, low long, high long").repartition(max(1, len(out)))


def read(shards: DataFrame) -> DataFrame:
    """Per stored document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader = Reader(uri)
                rows = []
                for key, value in reader.scan():
                    ids = reader.values(value)
                    rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                reader.close()
                if rows:
                    yield _rows(rows)

    return map_arrow(shards.select("file", "first"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def lookup(spark: SparkSession, shards: DataFrame, doc_ids: list[int]) -> dict[int, list[np.ndarray]]:
    """The ids of a few documents: only shards whose key range holds one of them are opened."""
    out: dict[int, list[np.ndarray]] = {d: [] for d in doc_ids}
    inside = lambda d: F.col("low").isNull() if d is None else (F.col("low").isNull() | (F.col("low") <= d)) & (F.col("high") >= d)
    wanted = reduce(Column.__or__, map(inside, doc_ids), F.lit(False))
    for r in shards.where(wanted).orderBy("shard").toLocalIterator():
        reader = Reader(r.file)
        for d in doc_ids:
            out[d] += reader.get(d)
        reader.close()
    return out


def folder(spark: SparkSession) -> str:
    """A fresh folder for shards, as a URI."""
    path = shared_path(spark, "token-shards")
    return path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1)
