"""The corpus pipeline: rules, exact and near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
has kept, and its result is written and read again before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dataquay.llm import mixing, near, pieces, queries, rules, tries
from dataquay.llm.common import documents, staged


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return rules.keep_good(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return tries.deduplicate(docs)


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, similarity 0.8."""
    return near.deduplicate(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mix(docs)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sampled segmentation of each document."""
    return pieces.encode(docs)


STAGES = [
    ("quality rules", good_documents),
    ("exact dedup", distinct_documents),
    ("near dedup", dissimilar_documents),
    ("mixing", mixed_documents),
    ("encoding", encoded_documents),
]

#: No SQL has the exact resemblance search and the sampled segmentations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of a folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs


QUERIES = queries.QUERIES | {"pipeline": queries.Query(run, ORACLE_SQL)}
