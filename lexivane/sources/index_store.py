"""The index on storage, as segments: chunks, term blocks, tiles, dictionary, embeddings.

A write adds one segment with its own rows alone, and a table of dead slots: a bitmap
for each tile in which it replaces or removes chunks. Then it puts a manifest beside
them, which names the segments and dead tables that count. Readers follow the newest
manifest, so they see a write whole or not at all. Of two writers at once, the second
finds its manifest's number taken and fails; nothing of it is seen. ``compact`` writes
all living rows as one segment, ``vacuum`` removes what no manifest names.

Chunks and documents are partitioned by a bucket of the document key, term blocks by a
bucket of the term, in which they are sorted.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.operators.blocks import blocks_of_tiles
from lexivane.operators.context import bucket_of
from lexivane.operators.embedding import embed_dedup, embed_hash, task_prefix
from lexivane.operators.postings import (
    Embed,
    TextIndex,
    bucket_of_term,
    corpus_sums,
    dictionary_of,
    parts_of,
    tile_ranges,
    tiles_of,
    token_counts,
    with_place,
)
from lexivane.session import bounded_broadcast, freed_shuffles, materialize, remove

CHUNKS = (
    "chunk_id string, doc_key string, source_url string, title string, heading_path string, "
    "anchor_link string, section_seq int, chunk_seq int, content string, token_count int, "
    "prev_id string, next_id string, created_at timestamp, tile bigint, slot int, bucket int"
)
TABLES = {
    "chunks": CHUNKS,
    "blocks": "term string, tile bigint, held bigint, max_tf int, min_len int, slots array<int>, tfs array<int>, positions array<array<int>>, term_bucket int",
    "tiles": "tile bigint, held bigint, chunk_ids array<string>, lens array<int>",
    "dictionary": "first string, last string, heads array<string>, entries array<struct<stem: string, term: string>>",
    "embeddings": "chunk_id string, tile bigint, slot int, embedding array<float>",
    "documents": "doc_key string, version bigint, bucket int",
}
DEAD = "tile bigint, dead bigint"
TOKENS_PER_ROUND = 4_000_000  # of those whose blocks are made in one go, where that takes few rounds
# tiles of a segment are numbered from its version's multiple of this
TILES_OF_SEGMENT = 1 << 46
ALIVE = "(shiftright(coalesce(dead, 0L), slot) & 1L) = 0L"


def upsert_chunks(existing: DataFrame, incoming: DataFrame, key: str = "source_url") -> DataFrame:
    """``incoming`` replaces everything ``existing`` holds for the same keys, so
    no chunk of an older, longer version stays behind."""
    replaced = incoming.select(key).distinct()
    kept = existing.join(bounded_broadcast(replaced), key, "left_anti")
    return kept.select(*existing.columns).unionByName(incoming.select(*existing.columns))


class ConcurrentWrite(RuntimeError):
    """Another writer has put its manifest first; the write may be tried again."""


@dataclass(frozen=True)
class IndexStore:
    spark: SparkSession
    path: str
    n_buckets: int = 64
    slices: int = 1
    fold: bool = True
    stem: bool = True
    embed: Embed | None = field(default=None, compare=False)
    term_buckets: int = 64
    max_segments: int = 16
    rounds: int = 16  # in which the blocks of a large segment are written, at most

    def _at(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}"

    def _fs(self, name: str):
        """Hadoop's file system and path of a name below the index."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(name))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _children(self, name: str) -> list[str]:
        fs, path = self._fs(name)
        return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []

    def _manifest(self) -> dict:
        """``version``, ``layout``, ``segments`` and ``dead`` (folders that count)."""
        done = [int(n.split(".")[0]) for n in self._children("manifest") if n.endswith(".json")]
        own = self._layout()
        if not done:
            return {"version": 0, "layout": own, "segments": [], "dead": []}
        held = json.loads(self.spark.read.text(self._at(f"manifest/{max(done)}.json")).first()["value"])
        if held["layout"] != own:
            raise ValueError(f"the index at {self.path} was made with {held['layout']}, not {own}")
        return held

    def _layout(self) -> dict:
        return {"n_buckets": self.n_buckets, "term_buckets": self.term_buckets, "fold": self.fold, "stem": self.stem}

    def _commit(self, version: int, segments: list[str], dead: list[str]) -> None:
        """Creates the manifest of ``version``, which must not exist yet."""
        text = json.dumps({"version": version, "layout": self._layout(), "segments": segments, "dead": dead})
        fs, path = self._fs(f"manifest/{version}.json")
        try:
            out = fs.create(path, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or fs.exists(path):
                raise ConcurrentWrite(f"version {version} of {self.path} was written by another job") from e
            raise
        out.write(bytearray(text.encode()))
        out.close()

    def _read(self, name: str, held: dict, buckets: list[int] | None = None) -> DataFrame:
        """A table of the segments that count; ``buckets``: only these partitions."""
        paths = [f"segments/{s}/{name}" for s in held["segments"]]
        paths = [self._at(p) for p in paths if self._fs(p)[0].exists(self._fs(p)[1])]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        # each segment is read by itself, so that its partition folders are its own
        out = None
        for p in paths:
            rows = self.spark.read.schema(TABLES[name]).parquet(p)
            out = rows if out is None else out.union(rows)
        return out if buckets is None else out.where(F.col("bucket").isin(buckets))

    def _dead(self, held: dict) -> DataFrame | None:
        """``tile, dead``: one row for each tile with deleted chunks."""
        if not held["dead"]:
            return None
        rows = self.spark.read.schema(DEAD).parquet(*[self._at(f"dead/{d}") for d in held["dead"]])
        return bounded_broadcast(rows.groupBy("tile").agg(F.bit_or("dead").alias("dead")))

    def _live(self, name: str, held: dict, buckets: list[int] | None = None) -> DataFrame:
        """Rows of single chunks that are not deleted."""
        rows, dead = self._read(name, held, buckets), self._dead(held)
        return rows if dead is None else rows.join(dead, "tile", "left").where(ALIVE).select(*rows.columns)

    def _masked(self, name: str, held: dict) -> DataFrame:
        """Bitmap rows, with ``present``: the slots of ``held`` that are not deleted."""
        rows, dead = self._read(name, held), self._dead(held)
        if dead is None:
            return rows.withColumn("present", F.col("held"))
        present = F.col("held").bitwiseAND(F.bitwise_not(F.coalesce("dead", F.lit(0).cast("long"))))
        return rows.join(dead, "tile", "left").withColumn("present", present).drop("dead").where("present <> 0")

    def exists(self) -> bool:
        return self._manifest()["version"] > 0

    # ---- writing ---------------------------------------------------------

    def _put(self, df: DataFrame, folder: str, name: str, *partition_by: str) -> DataFrame:
        path = self._at(f"{folder}/{name}")
        writer = df.write.mode("append").option("compression", "zstd")
        with freed_shuffles(df.sparkSession):
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(TABLES.get(name, DEAD)).parquet(path)

    def _rounds(self, stored: DataFrame) -> tuple[list[DataFrame], int]:
        """Stored chunks in ranges of tiles, and the number of tasks for each. What a
        round shuffles is gone before the next begins, so the writing of blocks needs at
        most about a ``rounds``-th of it at a time, however large the segment is."""
        n = stored.agg(F.sum(F.col("token_count").cast("long"))).first()[0] or 0
        rounds = max(1, min(self.rounds, -(-n // TOKENS_PER_ROUND)))
        return [stored.where(r) for r in tile_ranges(stored, rounds)], parts_of(self.spark, -(-n // rounds))

    def _segment(self, chunks: DataFrame, documents: DataFrame | None, version: int) -> str:
        """Writes a segment and returns its folder's name. ``documents`` None: those of the chunks.

        Chunks are shuffled once, to their bucket (and a slice, so that a full bucket is
        several tasks), and get their tile and slot there. Blocks are made in rounds, by the
        tasks to which the texts of their tiles are dealt, and shuffled once, to the bucket
        of their term; a common word is spread by its tiles.
        """
        name = f"{version}-{uuid.uuid4().hex[:12]}"
        folder = f"segments/{name}"
        ordered = self._dealt(chunks, "bucket", "chunk_id").sortWithinPartitions("bucket", "doc_key", "chunk_seq")
        columns = [c.split()[0] for c in CHUNKS.split(", ")]
        stored = self._put(with_place(ordered, version * TILES_OF_SEGMENT).select(*columns), folder, "chunks", "bucket")
        rounds, tasks = self._rounds(stored)
        for some in rounds:
            blocks = blocks_of_tiles(some, tasks, fold=self.fold).withColumn("term_bucket", bucket_of_term(F.col("term"), self.term_buckets))
            sorted_blocks = self._dealt(blocks, "term_bucket", "tile").sortWithinPartitions("term_bucket", "term", "tile")
            held = self._put(sorted_blocks.select(*[c.split()[0] for c in TABLES["blocks"].split(", ")]), folder, "blocks", "term_bucket")
        self._put(dictionary_of(held, self.stem), folder, "dictionary")
        named = stored.select("tile", "slot", "chunk_id").join(token_counts(held), ["tile", "slot"], "left")
        self._put(tiles_of(named.withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))), folder, "tiles")
        texts = stored.select("chunk_id", "tile", "slot", "content")
        if self.embed is None:
            vectors = embed_hash(texts, "content")
        else:  # a model is asked once for each distinct text
            texts = texts.withColumn("content", task_prefix(F.col("content"), "document"))
            vectors = embed_dedup(texts, "content", lambda rows: self.embed(rows, "content"))
        vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<float>"))
        self._put(vectors.select("chunk_id", "tile", "slot", "embedding"), folder, "embeddings")
        documents = self._first_versions(stored.select("doc_key")) if documents is None else documents
        self._put(self._dealt(documents, "bucket", "doc_key").select("doc_key", "version", "bucket"), folder, "documents", "bucket")
        return name

    def _dealt(self, rows: DataFrame, bucket: str, within: str) -> DataFrame:
        """Rows by bucket and, in it, by a slice of ``within``. A bucket that outgrows a
        task's share is cut further by adaptive execution, so what one task reads does not
        grow with the index; a common word's blocks are cut like any others."""
        sliced = rows.withColumn("_slice", F.pmod(F.xxhash64(within), F.lit(self.slices)))
        return sliced.hint("rebalance", bucket, "_slice")

    def _placed(self, chunks: DataFrame) -> DataFrame:
        if "created_at" not in chunks.columns:
            chunks = chunks.withColumn("created_at", F.current_timestamp())
        return chunks.withColumn("bucket", bucket_of(F.col("doc_key"), self.n_buckets))

    def _keys(self, keys: DataFrame) -> DataFrame:
        """doc_key, version (the highest given, or null) and bucket, one row each."""
        version = F.col("version").cast("long") if "version" in keys.columns else F.lit(None).cast("long")
        newest = keys.groupBy("doc_key").agg(F.max(version).alias("version"))
        return newest.withColumn("bucket", bucket_of(F.col("doc_key"), self.n_buckets))

    def _first_versions(self, keys: DataFrame) -> DataFrame:
        return self._keys(keys).withColumn("version", F.coalesce("version", F.lit(0).cast("long")))

    def write(self, chunks: DataFrame, keys: DataFrame | None = None) -> None:
        """Replaces the whole index."""
        version = self._manifest()["version"] + 1
        documents = None if keys is None else self._first_versions(keys)
        self._commit(version, [self._segment(self._placed(chunks), documents, version)], [])

    def upsert(self, chunks: DataFrame, keys: DataFrame | None = None) -> None:
        """Replaces the documents named in ``keys`` (``doc_key`` and, if given,
        ``version``; else those of the chunks) by their chunks; a document without
        chunks is removed. A document stored with a higher version stays as it is; one
        given without a version replaces what is stored and keeps its version. The
        version of a removed one is remembered.

        What is written follows the batch: its own rows, and a bitmap for each tile
        in which it replaces chunks.
        """
        held = self._manifest()
        if not held["segments"]:
            return self.write(chunks, keys)
        asked = materialize(self._keys(chunks.select("doc_key") if keys is None else keys))
        touched = sorted(r["bucket"] for r in asked.select("bucket").distinct().collect())  # at most n_buckets
        if not touched:
            return None
        was = self._read("documents", held, touched).groupBy("doc_key").agg(F.max("version").alias("was"))
        fresh = asked.join(was, "doc_key", "left").where("version is null or was is null or version >= was")
        fresh = fresh.select("doc_key", F.coalesce("version", "was", F.lit(0).cast("long")).alias("version"), "bucket")
        fresh = materialize(fresh)
        if not fresh.limit(1).count():
            return None
        names = bounded_broadcast(fresh.select("doc_key"))
        version = held["version"] + 1
        new = self._segment(self._placed(chunks).join(names, "doc_key", "left_semi"), fresh, version)
        replaced = self._live("chunks", held, touched).select("doc_key", "tile", "slot").join(names, "doc_key", "left_semi")
        gone = materialize(replaced.groupBy("tile").agg(F.bit_or(F.expr("shiftleft(1L, slot)")).alias("dead")))
        dead = held["dead"]
        if gone.limit(1).count():
            self._put(gone, "dead", new)
            dead = [*dead, new]
        self._commit(version, [*held["segments"], new], dead)

    def compaction_due(self) -> bool:
        """More segments than ``max_segments``, or over a quarter of the slots dead."""
        held = self._manifest()
        dead = self._dead(held)
        if len(held["segments"]) > self.max_segments:
            return True
        if dead is None:
            return False
        lost = dead.agg(F.sum(F.bit_count("dead"))).first()[0] or 0
        return 4 * lost > (self._read("tiles", held).agg(F.sum(F.bit_count("held"))).first()[0] or 0)

    def compact(self) -> None:
        """Writes all living rows as one segment; a job of its own, beside no writer."""
        held = self._manifest()
        if not held["segments"]:
            return
        documents = self._read("documents", held).groupBy("doc_key", "bucket").agg(F.max("version").alias("version"))
        version = held["version"] + 1
        chunks = self._live("chunks", held).drop("tile", "slot")
        self._commit(version, [self._segment(chunks, documents, version)], [])

    def clear(self) -> None:
        """Empties the index; the layout stays."""
        self._commit(self._manifest()["version"] + 1, [], [])

    def vacuum(self) -> int:
        """Deletes segments, dead tables and manifests that no longer count; only while
        nothing reads an older state and nothing writes. Returns how many folders went."""
        held = self._manifest()
        old = [f"manifest/{x}" for x in self._children("manifest") if x.endswith(".json") and int(x.split(".")[0]) < held["version"]]
        old += [f"segments/{x}" for x in self._children("segments") if x not in held["segments"]]
        old += [f"dead/{x}" for x in self._children("dead") if x not in held["dead"]]
        return sum(remove(self.spark, self._at(x)) for x in old)

    def open(self) -> TextIndex:
        held = self._manifest()
        tiles = self._masked("tiles", held)
        return TextIndex(
            chunks=self._live("chunks", held).drop("tile", "slot"),
            blocks=self._masked("blocks", held),
            dictionary=self._read("dictionary", held),
            tiles=tiles,
            stats=corpus_sums(tiles),
            embeddings=self._live("embeddings", held).drop("tile", "slot"),
            fold=self.fold,
            stem=self.stem,
            n_buckets=self.n_buckets,
            embed=self.embed,
            term_buckets=self.term_buckets,
        )
