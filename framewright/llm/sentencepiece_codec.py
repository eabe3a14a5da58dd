"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

An Aho-Corasick automaton over the reversed pieces gives, for every position of a chunk, the longest piece that
starts there. Starting with longest matches, the encoder appends a piece if it is compatible with the one before
(merging the pair's characters anew gives just these two pieces), else tries the next shorter piece, else goes back
one piece and marks the position as failed in a bitfield, so that no position fails twice. The result is the
encoding that merging by score (ties: leftmost) gives. Where no piece has two neighbouring characters side by side no
merge spans them, and the parts on either side are encoded on their own.

No piece has a space mark after another character, so a merge never crosses such a place: texts are cut there and
each distinct chunk is encoded once (a bounded store of chunks, emptied when a task ends). If a vocabulary has such pieces, texts
are encoded whole. Characters without a piece are bytes (<0xNN>), or the unknown piece where the model has no bytes.

Models with a normalisation table, other space rules than those of ``Codec.__init__``, or other than merge type are
refused with ValueError.

Edge cases: null and empty texts have no ids and decode to "". Very long texts are encoded chunk by chunk. Ties of score
go to the leftmost pair. Repeated rows give repeated results, an empty table an empty one. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, texts_of

SPACE = "▁"
_CACHE = 500_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + n]
            at += n


class Codec:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        rules = dict(x for n, v in top if n == 3 for x in _fields(v))
        trainer = dict(x for n, v in top if n == 2 for x in _fields(v))
        if trainer.get(3) != 2:
            raise ValueError("only merge-type (BPE) models are supported")
        if rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1):
            raise ValueError("only models without normalisation, with a space put before the text, are supported")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.texts: list[bytes] = []
        self.control = set()
        self.unk = sp.unk_id()
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_control(i):
                self.control.add(i)
                self.texts.append(b"")
            elif sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.texts.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_unknown(i):
                self.texts.append(" ⁇ ".encode())
            else:
                self.texts.append(piece.replace(SPACE, " ").encode())
                if not sp.is_unused(i):
                    self.ids[piece] = i
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.names = {i: p for p, i in self.ids.items()}
        self.sizes = {i: len(p) for p, i in self.ids.items()}
        self.size = n
        self.bigrams = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p[::-1], i)
        self.automaton.make_automaton()
        cut = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        line = not any("\n" in p for p in self.ids if len(p) > 1)
        if cut and line:
            self.chunks = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n").findall
        elif cut:
            self.chunks = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        else:
            self.chunks = lambda text: [text]
        self.as_text = list(map(str, range(n)))
        self.byte_ids = set(self.bytes.values())
        self.shorter: dict[int, int | None] = {}
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def forget(self) -> None:
        """Empty the store of chunks, by far the largest: a worker outlives its tasks."""
        self.known.clear()

    def merged(self, text: str) -> list[str]:
        """Merging by score, leftmost first among equals: for single pieces and pairs only."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, where = s, i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def compatible(self, last: int | None, piece: int) -> bool:
        """Whether merging the characters of both anew gives just these two; with last None, whether a piece is what its own characters merge to."""
        key = piece if last is None else (last + 1) * self.size + piece
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 2 * _CACHE:
                self.pairs.clear()
            want = [self.names[piece]] if last is None else [self.names[last], self.names[piece]]
            found = self.pairs[key] = self.merged("".join(want)) == want
        return found

    def next_shorter(self, piece: int) -> int | None:
        """The longest piece that begins this one."""
        if piece not in self.shorter:
            name = self.names[piece]
            self.shorter[piece] = next((self.ids[name[:k]] for k in range(len(name) - 1, 0, -1) if name[:k] in self.ids), None)
        return self.shorter[piece]

    def backtrack(self, text: str) -> list[int]:
        """The pieces of a text all of whose characters are pieces."""
        n = len(text)
        longest: list[int | None] = [None] * (n + 1)
        for end, piece in self.automaton.iter(text[::-1]):  # of those that end at one place the longest comes first
            if longest[n - 1 - end] is None:
                longest[n - 1 - end] = piece
        failed = 0
        out: list[int] = []
        sizes, compatible, shorter, pairs, size = self.sizes, self.compatible, self.next_shorter, self.pairs.get, self.size
        at, piece, last = 0, longest[0], None
        while piece is not None:
            while True:
                end = at + sizes[piece]
                fits = not failed >> end & 1
                if fits:
                    fits = pairs(piece)
                    if fits is None:
                        fits = compatible(None, piece)
                if fits and last is not None:
                    fits = pairs((last + 1) * size + piece)
                    if fits is None:
                        fits = compatible(last, piece)
                if fits:
                    out.append(piece)
                    at, last, piece = end, piece, longest[end]
                    break
                piece = shorter(piece)
                if piece is None:
                    if last is None:
                        raise ValueError("no encoding")
                    failed |= 1 << at
                    piece = out.pop()
                    at -= sizes[piece]
                    last = out[-1] if out else None
                    break
        return out

    def encode_part(self, part: str) -> tuple[int, ...]:
        """part: text without a place that no piece spans."""
        whole = self.ids.get(part)
        if whole is not None and self.compatible(None, whole):
            return (whole,)
        if len(part) == 1:
            return tuple(self.bytes[b] for b in part.encode()) if self.bytes else (self.unk,)
        return tuple(self.backtrack(part))

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        """Cut at every pair of characters that no piece has: merges don't cross it."""
        cuts = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in self.bigrams]
        if not cuts:
            return self.encode_part(chunk)
        out: list[int] = []
        for lo, hi in zip([0, *cuts], [*cuts, len(chunk)], strict=True):
            part = chunk[lo:hi]
            ids = self.known.get(part)
            if ids is None:
                ids = self.encode_part(part)
                if len(part) < 100:
                    self.known[part] = ids
            out.extend(ids)
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        for chunk in self.chunks(SPACE + text.replace(" ", SPACE)):
            ids = known.get(chunk)
            if ids is None:
                if len(known) > _CACHE:
                    known.clear()
                ids = self.encode_chunk(chunk)
                if len(chunk) < 100:
                    known[chunk] = ids
            out.extend(ids)
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """Bytes that form no character become U+FFFD each. The space before the text goes."""
        try:
            if not self.control.isdisjoint(ids):  # they part bytes
                text = self._decode_runs(ids)
            else:
                text = b"".join(map(self.texts.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            text = self._decode_runs(ids)
        first = next((i for i in ids if i not in self.control), None)
        leading = first is not None and first != self.unk and first not in self.byte_ids and self.texts[first][:1] == b" "
        return text[1:] if leading else text

    def _decode_runs(self, ids: Sequence[int]) -> str:
        out, run, byte_ids = [], b"", self.byte_ids

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + size].decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1

        for i in ids:
            if i in byte_ids:
                run += self.texts[i]
            else:
                flush()
                run = b""
                out.append(self.texts[i].decode())
        flush()
        return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id) and ids array<int> of each whole text."""
    keep = keep or ["doc_id"]
    frame = docs.select(*keep, docs["text"].alias("__text"))
    fields = ", ".join(f"`{c}` {t}" for c, t in frame.dtypes[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for part in _parts(b):
                got = pa.array([c.encode(t) for t in texts_of(part.column(len(keep)))], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], got], names=[*keep, "ids"])
        c.forget()

    return map_arrow(frame, run, f"{fields}, ids array<int>")


def decode(encoded: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id) and text from the column ids."""
    keep = keep or ["doc_id"]
    frame = encoded.select(*keep, "ids")
    fields = ", ".join(f"`{c}` {t}" for c, t in frame.dtypes[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            got = pa.array([c.decode(i or []) for i in b.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], got], names=[*keep, "text"])

    return map_arrow(frame, run, f"{fields}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding without ids leaving the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        name = c.as_text.__getitem__
        for b in batches:
            counts, id_sums, text_sums = [], [], []
            for part in _parts(b):
                for text in texts_of(part.column(1)):
                    ids = c.encode(text)
                    counts.append(len(ids))
                    id_sums.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
                    text_sums.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        c.forget()

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _parts(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Slices, so that Python objects exist for few rows at a time."""
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)
