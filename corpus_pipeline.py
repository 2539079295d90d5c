"""The corpus pipeline: each stage works on all that its predecessor kept, written as Parquet in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import exact_dedup, jaccard_join, mixing, packing, quality
from foliant.llm.common import batches, documents, materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    batches(spark)
    return quality.kept_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    batches(spark)
    return exact_dedup.deduplicated(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays."""
    batches(spark)
    return jaccard_join.representatives(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix holds them."""
    batches(spark)
    return mixing.mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in their sequences."""
    batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", dedup_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Importance weights, near-duplicate links and token ids are beyond SQL; tests hold every stage against brute force, but the
#: classifier, which they hold against the ranks of its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
