"""A training corpus from raw documents in five stages, each by one operator of the library.

Every stage works on the whole of what its predecessor kept; between stages the documents are
written as Parquet to the folder that all executors share and read again, so a lost executor
costs at most the stage it was working on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylens.llm import decontamination, mixing, quality_rules, sharding, similar_texts
from quarrylens.llm.common import stored, table

SHARDS = 8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of policy v1 go."""
    return quality_rules.accepted(docs, "v1")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose SimHash fingerprints link by Golay keys, or that share 0.8 of
    their five-word shingles or more, the one with the least id stays."""
    return similar_texts.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their weights; documents repeat as often as they are taken."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

# Fingerprints and components cannot be said in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
