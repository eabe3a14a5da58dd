"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_extract, jaccard_join, license_scan, oracles, quality_classifier, quality_rules, sentencepiece_codec, sstable, token_counts, url_rules
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

#: The fixed rules of op6, by contract.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read(sstable.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), sstable.folder(spark)))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels for urls come from the documents they name: the last number of the path is a doc_id; low quality and toxic ones are to be blocked."""
    pages = table(spark, sf_dir, "pages")
    number = F.regexp_extract(url_rules.path_of(F.col("url")), r"/(\d{1,18})(?:\.\w+)?/?$", 1)
    named = pages.select("url", F.when(number != "", number).cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull())
    labels = table(spark, sf_dir, "labels").where("doc_id is not null and quality is not null and toxic is not null").select("doc_id", "quality", "toxic")
    labelled = named.join(labels, "doc_id").select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    return url_rules.judge(pages, labelled, URL_RULES)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_license_scan": op3_license_scan,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_token_shards": op5_token_shards,
    "op6_url_rules": op6_url_rules,
    "op7_token_counts": op7_token_counts,
    "op8_decontamination": op8_decontamination,
    "op9_html_extract": op9_html_extract,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": oracles.OP1,
    "op3_license_scan": oracles.OP3,
    "op4_jaccard_join": oracles.OP4,
}
