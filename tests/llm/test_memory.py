"""What the training-data operators hold in memory: an executor's heap and its Python workers share one limit."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import DATA

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("framewright.llm")

from framewright.llm import common, decontamination, quality_classifier, sentencepiece_codec  # noqa: E402

PIECE = public_tokenizers.path("piece_bpe_32k.model")


def collections_of(spark) -> int:
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_every_stage_begins_on_a_collected_heap(spark, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    before = collections_of(spark)
    common.rest(spark)
    assert collections_of(spark) > before
    rested = []
    monkeypatch.setattr(pipeline, "rest", rested.append)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20)
    for _, stage in pipeline.STAGES:
        stage(spark, docs, DATA)
    assert rested == [spark] * len(pipeline.STAGES)


def test_batches_to_python_are_small(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    texts = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("0123456789"), 1000).alias("text"))
    got = [r.n for r in common.map_arrow(texts, sizes, "n long").collect()]
    assert sum(got) > 2000 * 10_000 and max(got) < 5 << 20


def test_workers_forget_chunks(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(6)
    assert sentencepiece_codec.round_trip(docs, PIECE).agg(F.sum("n_tokens")).first()[0] > 0
    assert sentencepiece_codec.encode(docs, PIECE).agg(F.sum(F.size("ids"))).first()[0] > 0

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(sentencepiece_codec.codec(PIECE).known)] * b.num_rows, pa.int64())], names=["n"])

    assert {r.n for r in common.map_arrow(spark.range(0, 12, 1, 12), held, "n long").collect()} == {0}


def test_many_new_words_are_scored_in_small_blocks():
    p = quality_classifier.Params()
    model = quality_classifier.Model(np.random.default_rng(5).normal(size=p.buckets).astype(np.float32), 0.1, p)
    words = [f"word{i * 7919 % 99991}number" for i in range(60_000)]
    scorer = quality_classifier.Scorer(model)
    tracemalloc.start()
    got = scorer([" ".join(words)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    buckets, weights = quality_classifier.doc_features(" ".join(words), p)
    assert got[0] == pytest.approx(1 / (1 + np.exp(-(model.weights[buckets].astype(float) @ weights + 0.1))), abs=1e-4)


def test_texts_are_searched_in_small_slices():
    texts = pa.array([b"a few words " * 5_000] * 20, pa.binary())
    sizes = [sum(map(len, held)) for _, held in decontamination._slices(texts, decontamination.Words())]
    assert sum(sizes) == 20 * 15_000 and max(sizes) < 80_000
