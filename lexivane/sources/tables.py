"""Parquet tables and the corpora made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly when an input has fewer splits than the cluster has
    slots. Large inputs have more splits than slots and are left alone."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages ``page_id, url, html``."""
    return spark.read.schema("page_id bigint, url string, html string").parquet(path)


def document_corpus(documents: DataFrame) -> DataFrame:
    """``doc_id, text, source`` as ``doc_key, url, title, content, source``."""
    return documents.select(
        F.col("doc_id").cast("string").alias("doc_key"),
        F.concat(F.lit("doc://"), F.col("doc_id")).alias("url"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("content"),
        "source",
    )


def turn_corpus(conversations: DataFrame) -> DataFrame:
    """Each turn as a small markdown document with two headings. A turn is a
    document of its own, so a long conversation is never gathered in one task."""
    name = F.concat_ws("-", "conv_id", "turn")
    return conversations.select(
        name.alias("doc_key"),
        F.concat(F.lit("conv://"), name).alias("url"),
        F.concat(F.lit("Conversation "), F.col("conv_id")).alias("title"),
        F.concat(
            F.lit("# Conversation "), "conv_id", F.lit("\n\n## "), "role", F.lit(" "), "turn",
            F.lit("\n"), "text",
        ).alias("content"),
        F.concat(F.lit("conv://"), "conv_id").alias("source"),
    )
