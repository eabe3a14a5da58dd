"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Stage by stage: documents that the quality classifier scores under its threshold go; documents that fail the quality
rules go; of each class of near duplicates (n-gram Jaccard) the one with the smallest doc_id stays; documents that hold
a benchmark item go; what is left is encoded and decoded by SentencePiece. The training tables (labels, benchmark) are
read from sf_dir. The first four stages return the columns of documents.

Edge cases, in any stage: null and empty texts are documents without words, which the quality rules drop; rows with a
null or a repeated doc_id are judged each by its own text, and of rows alike in text one stays; ties go to the smaller
doc_id; very long texts are judged whole; an empty table gives an empty result; further columns are carried through to
the last stage, which returns its own. Without labels no document is rejected by the classifier or by learned rules,
without a benchmark none as contaminated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from framewright.llm import decontamination, jaccard_join, quality_classifier, quality_rules, sentencepiece_codec
from framewright.llm.common import rest, shared_path, table
from framewright.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The pipeline's near duplicates: five words, a similarity of 0.8 or more.
NEAR = jaccard_join.Params(words=5, num=80, den=100)


def rested(stage: Stage) -> Stage:
    """The stage on executors that have given back what earlier ones left on their heaps: its Python workers need the room."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rest(spark)
        return stage(spark, docs, sf_dir)

    return run


@rested
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


@rested
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_passing(docs, table(spark, sf_dir, "labels"))


@rested
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, NEAR)


@rested
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


@rested
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", rules),
    ("jaccard_join", deduplicate),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: A trained classifier and a tokenizer aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
