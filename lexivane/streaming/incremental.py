"""Incremental indexing: new files in a folder are chunked and upserted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexivane.config import DEFAULTS
from lexivane.operators.chunking import chunk_documents
from lexivane.operators.pages import split_ok_quarantine
from lexivane.session import materialize
from lexivane.sources.index_store import IndexStore

DOCUMENT_SCHEMA = "doc_key string, url string, title string, content string, version bigint"


def incremental_ingest(
    spark: SparkSession,
    in_dir: str,
    store: IndexStore,
    checkpoint: str,
    size: int = DEFAULTS.chunk_size,
    overlap: int = DEFAULTS.chunk_overlap,
    max_files: int = 1000,
    continuous: bool = False,
    quarantine: str | None = None,
) -> StreamingQuery:
    """Watches ``in_dir`` for Parquet files of documents (``DOCUMENT_SCHEMA``).

    The checkpoint remembers the files taken. A batch that is run again after a
    failure replaces the same documents by the same chunks, so each file counts
    once. Of several versions, in one batch or over many, the highest wins; a version
    without text removes the document and is noted in ``quarantine``, a folder, if given.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        # the newest first: an older text must not stand in for a newer blank
        newest = batch.groupBy("doc_key").agg(
            F.max(F.struct("version", "content", "url", "title")).alias("d")
        )
        docs = newest.select("doc_key", "d.url", "d.title", "d.content", "d.version")
        docs = materialize(docs)
        ok, bad = split_ok_quarantine(docs, "content", "doc_key", "content")
        store.upsert(chunk_documents(ok.drop("version"), size, overlap), docs.select("doc_key", "version"))
        if quarantine:
            bad.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{quarantine}/batch-{batch_id}")

    writer = (
        spark.readStream.schema(DOCUMENT_SCHEMA)
        .option("maxFilesPerTrigger", max_files)
        .parquet(in_dir)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
    )
    return (writer if continuous else writer.trigger(availableNow=True)).start()
