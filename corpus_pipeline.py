"""A training-data pipeline over ``documents``.

Each stage gets all its predecessor kept, as a table read from Parquet. All but the last
return the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import alignment, forest, identifiers, packing, rules
from packetloom.llm.common import prepare, stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned decision list keeps."""
    learned = rules.learn_from(docs, table(spark, sf_dir, "labels"))
    return rules.passing(docs, learned)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    prepare(spark)
    return forest.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return alignment.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each identifier in a text replaced by a mark; n_chars counts the new text."""
    prepare(spark)
    held = identifiers.without_identifiers(docs)
    if "n_chars" in docs.columns:
        held = held.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return held


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("personal_data", personal_data), ("best_fit_packing", best_fit_packing),
]

#: Learned rules, alignment and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = stage(docs)
    return docs
