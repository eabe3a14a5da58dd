"""Token counts by rank-synchronous merging of ragged arrays.

Pre-tokens are held as one flat array of symbol numbers with the owner of each. In every round each sequence finds its
pair of lowest rank (a reduction over its span) and applies it at all its places at once (of overlapping places, from
the left every other one); sequences without a mergeable pair leave. What counts is how many symbols survive. A merge
makes a symbol whose own merges rank later, so this equals applying the lowest-ranked leftmost pair one by one.

Normalisation and splitting into pre-tokens follow the tokenizer file by the tokenizers library; special strings in a
text are one token each, found before anything else, as the library does by default. Where the tokenizer drops white
space, texts are cut there and each distinct chunk is counted once (a bounded store per worker); else each text is cut
into pre-tokens whole. A .model file is counted by ``sentencepiece_codec``.

Refused with ValueError: other models than BPE over a byte alphabet, and added tokens with side conditions.

Edge cases: null and empty texts count 0 bytes and 0 tokens. Very long texts are counted chunk by chunk, or as one text
where the tokenizer keeps white space. Repeated rows give repeated results, an empty table an empty one; ties of rank can't
arise. Further columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, texts_of

_CACHE = 400_000
_NONE = np.iinfo(np.int64).max


class Counter:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only BPE models over a byte alphabet are supported")
        added = spec.get("added_tokens") or []
        if any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError("added tokens with side conditions are not supported")
        names = sorted((a["content"] for a in added), key=lambda a: (-len(a), a))
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.starts = sorted({a[0] for a in names})  # one character at least of a special string
        tok = Tokenizer.from_file(path)
        self.normalizer, self.splitter = tok.normalizer, tok.pre_tokenizer
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.size = len(vocab)
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.mid = np.full(0x200, -1, np.int64)
        self.last = np.full(0x200, -1, np.int64)
        for c in range(0x200):
            self.mid[c] = vocab.get(chr(c), -1)
            self.last[c] = vocab.get(chr(c) + end, -1)
        pre = json.dumps(spec.get("pre_tokenizer"))
        norm = json.dumps(spec.get("normalizer"))
        self.by_chunk = '"behavior": "Removed", "invert": true' in pre and "\\\\s+" in norm
        self.known: dict[str, int] = {}

    def merged_sizes(self, words: list[str]) -> np.ndarray:
        """How many symbols survive in each pre-token (none is empty)."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        out = np.zeros(n, np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        if len(code) and code.max() >= 0x200:
            raise ValueError("a pre-token is not over the byte alphabet")
        sym = self.mid[code]
        ends = np.cumsum(sizes) - 1
        sym[ends] = self.last[code[ends]]
        if (sym < 0).any():
            raise ValueError("a byte has no symbol")
        ids = np.arange(n)
        while len(ids):
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            rank = np.full(len(sym), _NONE, np.int64)  # of the pair that begins here
            pair = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            inside = np.ones(len(pair), bool)
            inside[starts[1:] - 1] = False
            hit = inside & (self.keys[at] == pair)
            rank[:-1][hit] = self.ranks[at[hit]]
            low = np.minimum.reduceat(rank, starts)
            done = low == _NONE
            out[ids[done]] = sizes[done]
            take = (rank == np.repeat(low, sizes)) & (rank < _NONE)
            before = np.concatenate(([False], take[:-1]))
            if (take & before).any():  # aaa: every other place of a run
                place = np.arange(len(take))
                begin = np.maximum.accumulate(np.where(take & ~before, place, 0))
                take &= (place - begin) % 2 == 0
            where = np.flatnonzero(take)
            sym = sym.copy()
            sym[where] = self.made[at[where]]
            stay = np.ones(len(sym), bool)
            stay[where + 1] = False
            stay &= np.repeat(~done, sizes)
            gone = np.add.reduceat(take.astype(np.int64), starts)
            sizes, ids, sym = (sizes - gone)[~done], ids[~done], sym[stay]
        return out

    def count_chunks(self, chunks: list[str]) -> list[int]:
        """Tokens of each chunk. Chunks without white space share one call of the library."""
        odd = re.compile(r"[\s\x1c-\x1f\x85]").search
        rest = [c for c in chunks if odd(c)] if self.by_chunk else chunks
        apart = set(rest)
        plain = [c for c in chunks if c not in apart]
        groups = [(plain, " ".join(plain))] if plain else []
        owners: list[np.ndarray] = []
        words: list[str] = []
        order: list[str] = []
        for members, text in [*groups, *(([c], c) for c in rest)]:
            text = self.normalizer.normalize_str(text) if self.normalizer else text
            got = self.splitter.pre_tokenize_str(text)
            words.extend(w for w, _ in got)
            if len(members) > 1:
                gaps = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
                if len(gaps) != len(members) - 1:
                    raise ValueError("normalisation changed the number of chunks")
                owners.append(len(order) + np.searchsorted(gaps, [s for _, (s, _) in got]))
            else:
                owners.append(np.full(len(got), len(order)))
            order.extend(members)
        distinct: dict[str, int] = {}
        at = np.fromiter((distinct.setdefault(w, len(distinct)) for w in words), np.int64, len(words))
        sizes = self.merged_sizes(list(distinct))
        totals = np.bincount(np.concatenate(owners) if owners else [], sizes[at] if len(at) else None, len(order)).astype(int)
        result = dict(zip(order, totals.tolist(), strict=True))
        return [result[c] for c in chunks]

    def count(self, texts: list[str]) -> list[int]:
        split, extra = [], []
        for t in texts:
            n = 0
            if self.special and any(c in t for c in self.starts):
                n = len(self.special.findall(t))
                parts = self.special.split(t) if n else [t]
            else:
                parts = [t]
            extra.append(n)
            split.append([c for p in parts for c in p.replace("\n", " ").split(" ")] if self.by_chunk else [p for p in parts if p])
        known = self.known if self.by_chunk else {}
        new = {c for chunks in split for c in chunks if c not in known}
        if new:
            if len(known) + len(new) > _CACHE:
                known.clear()
                new = {c for chunks in split for c in chunks}
            fresh = sorted(new - {""})
            known[""] = 0
            for lo in range(0, len(fresh), 50_000):
                part = fresh[lo : lo + 50_000]
                known.update(zip(part, self.count_chunks(part), strict=True))
        get = known.__getitem__
        return [n + sum(map(get, chunks)) for n, chunks in zip(extra, split, strict=True)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path.endswith(".model"):
            from .sentencepiece_codec import codec

            counted = lambda texts: [len(codec(path).encode(t)) for t in texts]
        else:
            counted = counter(path).count
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                texts = texts_of(part.column(1))
                n = counted(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
