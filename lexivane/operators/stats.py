"""Counts and capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.config import (
    BYTES_PER_FLOAT,
    CHUNK_COUNT_WARNING,
    DEFAULTS,
    FREE_TIER_MB,
    VECTOR_DIM,
    WORDS_PER_CHUNK,
)
from lexivane.operators.postings import TextIndex


def count_by(df: DataFrame, col: str, name: str = "n", order: str = "count") -> DataFrame:
    """Rows per value: largest first (``count``), by value (``value``), or unsorted."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias(name))
    if order == "count":
        return counts.orderBy(F.desc(name), col)
    return counts.orderBy(col) if order == "value" else counts


def source_distribution(chunks: DataFrame) -> DataFrame:
    return count_by(chunks, "source_url", "chunk_count")


def store_counts(index: TextIndex) -> DataFrame:
    """``store, n, matches``: rows of each store, and whether it holds as many
    chunks as the chunk table."""
    stores = {"chunks": index.chunks, "text": index.lengths}
    if index.embeddings is not None:
        stores["vectors"] = index.embeddings
    counts = None
    for name, df in stores.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("store"), "n")
        counts = one if counts is None else counts.unionByName(one)
    chunks = index.chunks.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return counts.withColumn("matches", F.col("n") == chunks)


def ingest_stats(docs: DataFrame, chunks: DataFrame, stored: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: documents, chunks created, chunks stored and errors."""
    total = lambda df: df.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return docs.agg(F.count(F.lit(1)).alias("documents")).select(
        "documents",
        total(chunks).alias("chunks_created"),
        total(stored).alias("chunks_stored"),
        total(errors).alias("errors"),
    )


def capacity_estimate(
    docs: DataFrame, chunks: DataFrame, dim: int = VECTOR_DIM, chunk_size: int = DEFAULTS.chunk_size
) -> DataFrame:
    """One row: words (``docs.word_count``), chunks foreseen by both rules, chunks
    made, vector storage and its share of the free tier, and the warnings."""
    made = chunks.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    words = F.coalesce(F.sum("word_count"), F.lit(0)).cast("bigint")
    base = docs.agg(words.alias("total_words")).withColumn("n_chunks", made)
    mb = F.col("n_chunks") * (dim * BYTES_PER_FLOAT) / (1024 * 1024)
    return (
        base.withColumn("est_chunks_by_words", F.floor(F.col("total_words") / WORDS_PER_CHUNK))
        .withColumn("est_chunks_by_size", F.floor(F.col("total_words") / (chunk_size // 2)))
        .withColumn("storage_mb", mb)
        .withColumn("tier_percent", F.col("storage_mb") / FREE_TIER_MB * 100)
        .withColumn("warn_80", F.col("tier_percent") > 80)
        .withColumn("warn_90", F.col("tier_percent") > 90)
        .withColumn(
            "warn_chunks",
            (F.col("n_chunks") > CHUNK_COUNT_WARNING)
            | (F.col("est_chunks_by_size") > CHUNK_COUNT_WARNING),
        )
    )
