"""The corpus pipeline: quality, near duplicates, decontamination, personal data, packing.

Every stage reads what the last one wrote. ``run`` writes each stage as Parquet in the shared
folder of the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stacktally import workspace
from stacktally.llm import decontam, near_dup, packing, pii, quality
from stacktally.llm.common import read, small_batches
from stacktally.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy; others go."""
    small_batches(spark)
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates."""
    small_batches(spark)
    return near_dup.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    return decontam.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced in their texts."""
    small_batches(spark)
    return pii.scrub(docs, pii.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of bounded length."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal data", personal_data),
    ("packing", pack),
]

# Near duplicates, personal data and packing are beyond SQL; tests hold the stages against
# brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = workspace.publish(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
