"""A training corpus from raw documents in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, mixing, quality, secrets, simhash
from lectern.llm.common import materialize, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled quality rules keep.

    Null, empty and blank texts fail; texts of any length are read whole; a
    metric equal to its cutoff passes; rows that repeat are judged one by one;
    without labels only the base rules reject; no rows give no rows.  All
    columns stay, whatever their names.
    """
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id.

    Null and empty texts are one class; texts of any length are compared whole;
    a similarity of exactly 0.8 links; rows that repeat an id are one document
    and stay or go together, rows without an id stay; no rows give no rows.
    All columns stay, whatever their names.
    """
    classes = simhash.near_duplicates(docs)
    extra = classes.where("doc_id <> component_id").select("doc_id").distinct().hint("shuffle_hash")
    return docs.join(extra, "doc_id", "left_anti").select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; texts of any length are searched whole; a
    distance of exactly the budget is a hit; rows that repeat are judged one by
    one; without items all rows stay, no rows give no rows.  All columns stay,
    whatever their names.
    """
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and n_chars counted again.

    Null texts stay null, empty ones empty; texts of any length are read whole;
    overlapping secrets become one mark; rows that repeat are treated alike; no
    rows give no rows.  All columns stay, whatever their names.
    """
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes every document.

    A null or empty text has size zero and is taken zero words; a text of any
    length is one item; equal rows are rounded one by one, a null source is a
    source of its own; no rows give no rows.  Further columns are not read.
    """
    return mixing.mix_sources(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
]

#: Similarity, edit distance and seeded rounding have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
