"""From raw documents to shards: STAGES in order, each written before the next reads it.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, with all their
columns, whatever they are called; the last one adds where each document is stored
(``shard``, ``slot`` of the input are replaced). Null and empty texts fail the quality
rules. Rows without an id that belong to no group with an id all stay in the
near-duplicate stage, as nothing tells them apart; repeated rows of one id and text
become one; of equally good copies the least id stays. Texts are worked whole, however
long. An empty table gives an empty table at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.llm import decontaminate, jaccard, mixing, quality, sharding
from lexivane.llm.common import table
from lexivane.session import settled


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of similar texts."""
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_rows(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix),
    ("sharding", shards),
]

# alignment and sampled splitters are not SQL; tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
