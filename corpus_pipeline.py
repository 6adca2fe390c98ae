"""A corpus made ready for training: five stages, each an operator of ``tempora.llm``.

Every stage takes the documents that its predecessor kept.  The classifier drops what it rejects,
exact and near dedup keep one document of each group, mixing samples documents by calibrated
probabilities, and packing gives the rows of training sequences.  ``run`` writes every stage as
Parquet to the shared folder and reads it again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempora.functions.session import cut
from tempora.llm import classifier, exact, mixing, near, packing


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier, trained on the labels, rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classifier.good(docs, classifier.learn(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id among equal texts."""
    return exact.exact_keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id among near copies."""
    return near.near_keep(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that sources, languages and topics get their share of the tokens."""
    return mixing.sampled(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mix), ("packing", packed)]

#: The classifier's training and the packing plan aren't expressible in SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
