"""The corpus pipeline: documents in, a mixture of clean, distinct documents out.

Stages, in order: language ID, exact dedup, near-duplicate join, decontamination, source mixing. Each
takes (spark, docs, sf_dir) and returns a DataFrame; the caller writes it and hands the written table to
the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lapforge.llm.decontaminate import drop_contaminated
from lapforge.llm.exact_dedup import drop_exact_copies
from lapforge.llm.language_id import keep_identified
from lapforge.llm.mixing import EVENER, mix_sources
from lapforge.llm.ngram_join import drop_near_copies
from lapforge.llm.storage import written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return keep_identified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the smallest doc_id."""
    return drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarity links make: the smallest doc_id."""
    return drop_near_copies(docs)


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold a benchmark passage."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per reading of a document in the registered mixture, with all its columns but those named like what mixing adds."""
    own = {"doc_id", "source", "n_tokens", "epoch", "block", "cell", "place"}
    return mix_sources(docs, EVENER, carry=tuple(c for c in docs.columns if c.lower() not in own))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard", near_stage),
    ("decontaminate", clean_stage),
    ("source_mixing", mixing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
