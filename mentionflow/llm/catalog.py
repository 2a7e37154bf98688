"""Queries of the training-data operators: ``(spark, sf_dir) -> DataFrame``
over the whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, compression_quality, conversation_repair, distribution_divergence, fuzzy_lines, negative_mining, pu_toxicity, simhash, source_mixing,
               template_decontamination, viterbi_counts, warc_derivatives, weak_pii)
from .common import table

QUERIES: dict = {}
#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = warc_derivatives.derivatives(warc_derivatives.responses_of(table(spark, sf_dir, "pages")))
    return d.withColumn("record_sha256", F.sha2("record", 256)).drop("record")


@register
def op2_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution_divergence.judge(table(spark, sf_dir, "documents"))


ORACLE["op2_distribution_divergence"] = distribution_divergence.oracle()


@register
def op3_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash.groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


@register
def op4_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pu_toxicity.score(docs, pu_toxicity.train(docs, table(spark, sf_dir, "labels")))


@register
def op5_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_pii.digests(weak_pii.detect(table(spark, sf_dir, "documents")))


@register
def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.report(table(spark, sf_dir, "documents"))


@register
def op7_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi_counts.counts(table(spark, sf_dir, "documents"))


@register
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"))))


@register
def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compression_quality.score(docs, compression_quality.train(docs, table(spark, sf_dir, "labels")))


@register
def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.taken(table(spark, sf_dir, "documents"))


ORACLE["op11_source_mixing"] = source_mixing.oracle()


@register
def op12_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negative_mining.mine(table(spark, sf_dir, "embeddings"))


ORACLE["op12_negative_mining"] = negative_mining.oracle()


@register
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(table(spark, sf_dir, "conversations"))


ORACLE["op13_conversation_repair"] = conversation_repair.oracle()
