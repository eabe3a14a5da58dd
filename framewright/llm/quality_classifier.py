"""Quality classifier: supervised subword embeddings.

A document is the mean of the vectors of its words and of its word bigrams. A word's vector is the mean of the learned
vectors of its hashed features: the word itself and its character n-grams, with marks for the word's ends; a bigram (two
words in a row) is one hashed feature. A softmax layer gives two classes. Embeddings and output layer are trained
together by stochastic gradient descent (numpy, AdaGrad steps).

As mean and output layer are linear, class score(document) = mean over words and bigrams of (mean over features of
output . embedding): after training each hashed feature is reduced to one number, so a model is one array of
``buckets`` floats, each distinct word is scored once and each bigram is one look-up.

Training. At most ``max_train`` labelled documents, in the order of a hash of doc_id, are hashed to (feature, weight)
pairs on the executors; one task trains on at most ``max_pairs`` of them in all (documents with more than ``max_pairs`` / 64 are
not learned from) and hands back the array of weights. No text and no feature reaches the driver.

Edge cases: null and empty texts have no words and get the score of the bias alone. Rows without doc_id are scored
as any other and never learned from. Contradicting labels of one document count by majority (ties: 1); of rows that
repeat a doc_id one text is learned from, the one with the least hash. With no labelled rows the score is 0.5 for all;
an empty table gives an empty result. Very long texts are scored whole. Further columns of the input are ignored, and
kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, texts_of

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Params:
    """max_train bounds the labelled rows that are learned from (taken in the order of a hash of doc_id), max_pairs their (feature, weight) pairs of 8 bytes."""

    buckets: int = 1 << 17
    dim: int = 8
    min_n: int = 3
    max_n: int = 4
    max_train: int = 3000
    max_pairs: int = 1 << 23
    epochs: int = 5
    batch: int = 40
    rate: float = 0.25
    seed: int = 7
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    params: Params


def word_features(words: list[str], p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers of all words, where each word's begin, and each word's hash. Every word has one feature at least."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    marked = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, n)
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    owner = np.repeat(np.arange(n), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(code))  # characters of the word from here on
    buckets, owners = [], []
    power = np.empty(len(code), np.uint64)
    offset = np.arange(len(code)) - starts[owner]
    with np.errstate(over="ignore"):
        steps = np.cumprod(np.full(int(lengths.max()) + 1, _STEP, np.uint64))
        power = (code + np.uint64(1)) * steps[offset]
        whole = np.add.reduceat(power, starts) * _MIX
        buckets.append((whole >> np.uint64(20)) % np.uint64(p.buckets))
        owners.append(np.arange(n))
        for size in range(p.min_n, p.max_n + 1):
            at = np.flatnonzero(left >= size)
            h = np.full(len(at), size, np.uint64)
            for j in range(size):
                h = h * _STEP + code[at + j] + np.uint64(1)
            h = h * _MIX
            buckets.append((h >> np.uint64(20)) % np.uint64(p.buckets))
            owners.append(owner[at])
    own = np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    counts = np.bincount(own, minlength=n)
    return np.concatenate(buckets)[order].astype(np.int64), np.concatenate(([0], np.cumsum(counts)[:-1])), whole


def bigram_buckets(h: np.ndarray, p: Params) -> np.ndarray:
    """Bucket of each two neighbours of a sequence of word hashes."""
    with np.errstate(over="ignore"):
        return (((h[:-1] * _PAIR + h[1:]) * _MIX >> np.uint64(20)) % np.uint64(p.buckets)).astype(np.int64)


def doc_features(text: str, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights, which sum to 1 (none for a text without words)."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    feats, starts, h = word_features(list(number), p)
    sizes = np.diff(np.append(starts, len(feats)))
    each = np.repeat(np.bincount(ids) / sizes, sizes)
    pairs = bigram_buckets(h[ids], p)
    buckets, where = np.unique(np.concatenate([feats, pairs]), return_inverse=True)
    weights = np.bincount(where, np.concatenate([each, np.ones(len(pairs))])) / (2 * len(words) - 1)
    return buckets.astype(np.int32), weights.astype(np.float32)


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int], p: Params) -> Model:
    """Stochastic gradient descent on softmax cross-entropy over ``doc_features``, in an order that the seed fixes."""
    if not docs:
        return Model(np.zeros(p.buckets, np.float32), 0.0, p)
    rng = np.random.default_rng(p.seed)
    emb = rng.uniform(-1 / p.dim, 1 / p.dim, (p.buckets, p.dim)).astype(np.float32)
    out = np.zeros((2, p.dim), np.float32)
    out[1], out[0] = 0.1, -0.1
    share = float(np.clip(np.mean(labels), 1e-3, 1 - 1e-3))
    bias = np.array([0.0, np.log(share / (1 - share))], np.float32)
    y = np.asarray(labels, np.int64)
    sq_emb, sq_out, sq_bias = np.full(p.buckets, 1e-8, np.float32), np.full_like(out, 1e-8), np.full_like(bias, 1e-2)
    for _ in range(p.epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), p.batch):
            pick = order[lo : lo + p.batch]
            flat = np.concatenate([docs[d][0] for d in pick])
            weight = np.concatenate([docs[d][1] for d in pick])[:, None]
            owner = np.repeat(np.arange(len(pick)), [len(docs[d][0]) for d in pick])
            vec = emb[flat] * weight
            doc = np.stack([np.bincount(owner, vec[:, j], len(pick)) for j in range(p.dim)], 1)
            z = doc @ out.T + bias
            z -= z.max(1, keepdims=True)
            g = np.exp(z)
            g /= g.sum(1, keepdims=True)
            g[np.arange(len(pick)), y[pick]] -= 1
            g /= len(pick)
            d_out, d_bias, d_doc = g.T @ doc, g.sum(0), g @ out
            if len(flat):
                rows, inverse = np.unique(flat, return_inverse=True)
                each = d_doc[owner] * weight
                d_emb = np.stack([np.bincount(inverse, each[:, j], len(rows)) for j in range(p.dim)], 1).astype(np.float32)
                sq_emb[rows] += (d_emb**2).mean(1)
                emb[rows] -= p.rate * d_emb / np.sqrt(sq_emb[rows])[:, None]
            sq_out += (d_out**2).astype(np.float32)
            out -= (p.rate * d_out / np.sqrt(sq_out)).astype(np.float32)
            sq_bias += (d_bias**2).astype(np.float32)
            bias -= (0.1 * p.rate * d_bias / np.sqrt(sq_bias)).astype(np.float32)
    return Model((emb @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]), p)


class Scorer:
    """Scores of texts by a model. Words keep their number, score and hash between calls, up to 200,000 of them."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.weights = model.weights.astype(np.float64)
        self._empty()

    def _empty(self) -> None:
        self.number: dict[str, int] = {}
        self.score, self.hash = np.zeros(0), np.zeros(0, np.uint64)

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.number]
        if len(self.number) + len(new) > 200_000:
            self._empty()
            new = list(words)
        for lo in range(0, len(new), 8_000):
            part = new[lo : lo + 8_000]
            feats, starts, h = word_features(part, self.model.params)
            sizes = np.diff(np.append(starts, len(feats)))
            self.number.update(zip(part, range(len(self.number), len(self.number) + len(part)), strict=True))
            self.score = np.concatenate([self.score, np.add.reduceat(self.weights[feats], starts) / sizes])
            self.hash = np.concatenate([self.hash, h])

    def __call__(self, texts: list[str]) -> list[float]:
        """Probability of class 1."""
        split = [t.split() for t in texts]
        self._learn(set().union(*split))
        get, p = self.number.__getitem__, self.model.params
        means = []
        for words in split:
            n = len(words)
            if not n:
                means.append(0.0)
                continue
            ids = np.fromiter(map(get, words), np.int64, n)
            total = self.score[ids].sum() + self.weights[bigram_buckets(self.hash[ids], p)].sum()
            means.append(total / (2 * n - 1))
        return (1 / (1 + np.exp(-np.clip(np.array(means) + self.model.bias, -50, 50)))).tolist()


def score_texts(texts: list[str], model: Model) -> list[float]:
    return Scorer(model)(texts)


def held_out(doc_id: Column) -> Column:
    """The test fold: a fifth of the documents, by the crc32 of their number."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, p: Params | None = None) -> Model:
    """Learn from at most p.max_train labelled documents outside the test fold. Only the model reaches the driver."""
    p = p or Params()
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_train)
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 100):
                part = b.slice(lo, 100)
                got = [doc_features(t, p) for t in texts_of(part.column(3))]
                ok = pa.array([len(x) * 64 <= p.max_pairs for x, _ in got])
                packed = [pa.array([x[k].tobytes() for x in got], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *packed], names=["doc_id", "y", "pick", "buckets", "weights"]).filter(ok)

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for b in batches:
            docs += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), *([np.frombuffer(x.as_py(), kind) for x in b.column(k)] for k, kind in ((2, np.int32), (3, np.float32))), strict=True)
        docs.sort(key=lambda d: d[0])
        m = train([d[2:] for d in docs], [d[1] for d in docs], p)
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.bias], pa.float64())], names=["weights", "bias"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id")  # max_train rows
    rows = map_arrow(texts.select("doc_id", "y", F.xxhash64("text").alias("pick"), "text"), hashed, "doc_id long, y int, pick long, buckets binary, weights binary")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("pick", "y", "buckets", "weights")).alias("m")).select("doc_id", "m.*")
    so_far = F.sum(F.length("weights") / 4).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # max_train rows
    taken = one.withColumn("__pairs", so_far).where(F.col("__pairs") <= p.max_pairs).select("doc_id", "y", "buckets", "weights")
    got = map_arrow(taken.coalesce(1), trained, "weights binary, bias double").first()
    return Model(np.frombuffer(bytes(got.weights), np.float32), float(got.bias), p) if got else train([], [], p)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``keep`` (doc_id) and the score. Only the text is read to score, and sent once if it is kept."""
    keep = keep or ["doc_id"]
    frame = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])])
    at = frame.columns.index("text")
    fields = ", ".join(f"`{c}` {t}" for c, t in frame.dtypes[: len(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                got = scorer(texts_of(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(got, pa.float64())], names=[*keep, name])

    return map_arrow(frame, run, f"{fields}, `{name}` double")


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= model.params.threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with predicted = 1, with all their columns."""
    return score(docs, model, docs.columns, "__score").where(F.col("__score") >= model.params.threshold).drop("__score")
