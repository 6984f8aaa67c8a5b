"""From raw documents to packed sequences, in five stages.

Every stage reads what its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, mixing, packing, quality_rules, simhash_dedup
from tessera.llm.queries import documents, vocabulary_path
from tessera.session import materialize, working

#: Tables that a stage needs on the way; they go when the next stage begins, so its input must be written by then.
GROUP = "corpus_pipeline"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    with working(spark, GROUP):
        return quality_rules.filter_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    with working(spark, GROUP):
        return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    with working(spark, GROUP):
        return simhash_dedup.keep_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; documents repeat or go."""
    with working(spark, GROUP):
        return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    with working(spark, GROUP):
        return packing.pack(docs, vocabulary_path())


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_dedup", near), ("source_mixing", mixed), ("packing", packed)]

#: Fingerprints, sampling keys and token ids are not to be had in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
