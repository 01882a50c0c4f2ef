"""Ingestion: documents in, index tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.config import DEFAULTS
from lexivane.operators.chunking import chunk_documents
from lexivane.operators.pages import clean_pages, seed_select, split_ok_quarantine
from lexivane.session import materialize
from lexivane.sources.index_store import IndexStore
from lexivane.sources.tables import spread


@dataclass(frozen=True)
class IngestStats:
    documents: int
    chunks_created: int
    chunks_stored: int
    errors: int


def run_ingest(
    docs: DataFrame,
    store: IndexStore,
    size: int = DEFAULTS.chunk_size,
    overlap: int = DEFAULTS.chunk_overlap,
    clear: bool = False,
    quarantine: str | None = None,
) -> IngestStats:
    """Chunks ``doc_key, url, title, content`` into ``store``. Counts are taken from
    the chunks once they are stored. A document without text is an error and is
    removed from the index; ``quarantine`` names a folder for these records."""
    ok, bad = split_ok_quarantine(spread(docs), "content", "doc_key", "content")
    chunks = materialize(chunk_documents(ok, size, overlap))
    bad = materialize(bad)
    keys = chunks.select("doc_key").union(bad.select("doc_key")).distinct()
    if clear or not store.exists():
        store.write(chunks, keys)
    else:
        store.upsert(chunks, keys)
    if quarantine:
        bad.write.mode("append").parquet(quarantine)
    made = chunks.agg(F.countDistinct("doc_key").alias("documents"), F.count(F.lit(1)).alias("chunks")).first()
    stored = store.open().stats.first()["n_chunks"]
    return IngestStats(made["documents"], made["chunks"], stored, bad.count())


def ingest_pages(pages: DataFrame, store: IndexStore, seeds: DataFrame | None = None, mode: str = "article", **options) -> IngestStats:
    """Pages, or the seeded ones of them, into ``store``."""
    chosen = pages if seeds is None else seed_select(pages, seeds)
    return run_ingest(clean_pages(chosen, mode), store, **options)

