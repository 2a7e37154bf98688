"""Corpus pipeline: each stage takes the documents its predecessor kept, and is
written as Parquet and read again before the next one.

Each stage takes NULL, empty and blank texts, texts of any length, repeated rows and ids, rows without an id, an empty table, and
columns of any other name, which it passes on as they are (but for the last stage, which returns counts and digests)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mentionflow.llm import byte_bpe, compression_quality, fuzzy_lines, simhash, template_decontamination
from mentionflow.llm.common import stored, table

#: No SQL form: dictionaries, fingerprints and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts (trained on the labels of the given documents). Each row is judged by its
    own text, NULL as empty; with labels of one class or none all stay."""
    model = compression_quality.train(docs, table(spark, sf_dir, "labels"))
    return compression_quality.keep_good(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat, equal or similar, one that stays. NULL texts stay NULL, rows without an id stay
    whole, rows of one id lose the same lines; a document that loses all its lines stays with an empty text."""
    return fuzzy_lines.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: 3-word shingles, 2 bits. NULL, empty and blank texts are one group; equal rows are one
    document; other texts of a repeated id are judged by themselves; rows without an id stay."""
    return simhash.one_of_each(docs, shingle_words=3, max_bits=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, in its words or re-parameterised. NULL and empty texts hold none, nor does anything
    with an empty benchmark; rows of one id are one document; rows without an id stay."""
    return template_decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of each row, NULL as empty."""
    return byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs)))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
