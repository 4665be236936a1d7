"""A corpus from raw documents to training records, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isofield.llm import op2_toxicity, op4_hyperminhash, op7_decontamination, op8_mixing, op9_training_order
from isofield.llm.common import stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are predicted toxic."""
    return op2_toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8 or more)."""
    return op4_hyperminhash.one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, less its benchmark passages."""
    return op7_decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask."""
    return op8_mixing.mixture(docs)


def training_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token records in training order, one row a shard."""
    return op9_training_order.shards(docs)


STAGES = [
    ("toxicity", toxicity),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
    ("token-id output", training_records),
]

#: Scores that are learned, tokenisation and the keyed permutation have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table, each stored and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, "stage-" + name.replace(" ", "-"))
    return docs
