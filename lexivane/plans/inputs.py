"""Inputs that several registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.functions.text import unnest
from lexivane.operators.chunking import chunk_documents, sentences
from lexivane.operators.postings import TextIndex
from lexivane.session import materialize, scratch_path
from lexivane.sources.index_store import IndexStore
from lexivane.sources.tables import document_corpus, spread, table, turn_corpus

_stores: dict[tuple[str, str, str, bool], IndexStore] = {}
_steps: dict[tuple[str, str, str], DataFrame] = {}


def once(spark: SparkSession, sf: str, name: str, make) -> DataFrame:
    """A step that several queries start from, stored once per application."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _steps:
        _steps[key] = materialize(make())
    return _steps[key]


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return document_corpus(spread(table(spark, sf, "documents")))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return turn_corpus(spread(table(spark, sf, "conversations")))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "pages"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """``query_id, q``: every sentence of every benchmark passage."""
    rows = unnest(table(spark, sf, "benchmark"), sentences(F.col("text")), "item_id")
    return rows.select((F.col("item_id") * 1000 + F.col("pos")).alias("query_id"), F.col("item").alias("q"))


def whole_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as they are, in the shape of the chunk table."""
    d = docs(spark, sf)
    none = F.lit(None).cast("string")
    return d.select(
        F.col("doc_key").alias("chunk_id"),
        "doc_key",
        F.col("source").alias("source_url"),
        "title",
        F.lit("").alias("heading_path"),
        F.col("url").alias("anchor_link"),
        F.lit(1).alias("section_seq"),
        F.lit(1).alias("chunk_seq"),
        "content",
        F.floor(F.length("content") / 4).cast("int").alias("token_count"),
        none.alias("prev_id"),
        none.alias("next_id"),
    )


def index(spark: SparkSession, sf: str, kind: str, stem: bool = False) -> TextIndex:
    """The stored index of whole ``documents`` or of their ``chunks``; built once
    per application and read by every query that needs it."""
    key = (spark.sparkContext.applicationId, sf, kind, stem)
    if key not in _stores:
        store = IndexStore(spark, scratch_path(spark, f"index-{kind}"), n_buckets=8, stem=stem, term_buckets=8)
        rows = whole_documents(spark, sf) if kind == "documents" else chunk_documents(docs(spark, sf))
        store.write(rows)
        _stores[key] = store
    return _stores[key].open()
