"""The queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, mixing, oracles, quality, secrets, simhash, substrings, tokens, toxicity, urls
from .common import read

#: Pieces and scores that op5 takes as its vocabulary: a public tokenizer's file.
UNIGRAM = "/opt/tokenizers/piece_bpe_32k.model"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's address; a labelled page is bad if its quality label is 0 or its toxic label 1."""
    labels = read(spark, sf_dir, "labels")
    bad = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return urls.url_filter(read(spark, sf_dir, "pages"), bad)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.toxicity(read(spark, sf_dir, "documents"), labels)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds."""
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that no earlier passage repeats."""
    return substrings.substring_dedup(read(spark, sf_dir, "documents")).drop("kept")


def op5_token_counts(spark: SparkSession, sf_dir: str, model: str = UNIGRAM) -> DataFrame:
    """Tokens of every document."""
    return tokens.token_counts(read(spark, sf_dir, "documents"), tokens.vocabulary(model))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict of every document."""
    return quality.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document that bring its source to its target."""
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that every document names."""
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secrets.digest(secrets.secret_scan(read(spark, sf_dir, "documents")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash and near-duplicate class of every document."""
    found = simhash.simhash_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_toxicity, op3_decontaminate, op4_substring_dedup, op5_token_counts, op6_quality_rules, op7_mix_sources, op8_license_scan, op9_secret_scan, op10_simhash,
)}
ORACLES = oracles.ORACLES
