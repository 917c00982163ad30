"""Documents to packed token ids: language, near duplicates, benchmark passages, mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from policylake.llm import decontaminate, jaccard_join, language_id, mixing, packing
from policylake.llm.staging import staged


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or that no language of the corpus explains, go."""
    return language_id.understood(docs, language_id.learned(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles (Jaccard of 0.8 or more) one document stays."""
    return jaccard_join.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage within a fifth of a benchmark item's words go."""
    return decontaminate.without_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target weights of their sources, repeats as repeated rows."""
    return mixing.drawn(docs, mixing.mix(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed matrices of token ids."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_free),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs


#: Learned models and drawn mixes have no SQL form; tests/llm compares each stage with brute force.
ORACLE_SQL = None
