"""Language model scores of whole texts.

Counts of words and of subword ids cover all training documents (those whose CRC-32 of
the id is not ``HELD`` modulo ``FOLDS``). A causal self-attention model over subword
classes (``attention.py``) is trained in ``ROUNDS`` rounds: a hash of the id gives each
training document to one of them, whatever the size of the corpus. In a round every task
trains the current weights on its part of the round's documents, and the weights' mean by
tokens starts the next round. All documents are passed once; a corpus of few words
(``LEAST_WORDS``) is passed several times.

Classes are the subword ids most frequent in training and one class for the others. Each
of these is a symbol of its own as well, as input and within its class. A word's probability is that of its
subwords given those before it, mixed with the word's smoothed frequency (``BASE_SHARE``),
which is also its base score. A document ends with an end id, scored like a word.

The counts of a document's words come through a join by word: documents form blocks
by the part of the file they stand in, a block asks once for each of its words, and gets
the counts back next to its documents. No table of words is ever held whole.

Null or empty text: the end alone. Null ids: never held out, as their remainder is
null. Repeated rows are scored one by one. Without training documents all counts are 0
and the model is uniform. An empty table gives no rows. Columns of other names are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.llm import attention, hashing
from lexivane.llm.common import query, table
from lexivane.llm.token_files import Encoder
from lexivane.session import materialize, ship_package

FOLDS, HELD = 7, 2
LEAST_WORDS = 200_000
PASSES = 6  # at most, over a corpus of fewer words
ROUNDS = 3
STEPS = (0.01, 0.005, 0.0025)  # learning rate of each round
BASE_SHARE = 0.3
BLOCK_BYTES = 8 << 20  # of compressed table; what one group of documents holds
END_WORD = -1  # the end as a word
END_TEXT = b" "  # what stands for the end among words, which hold no blank
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}  # else 10,000 rows, however long
HELD_RUNS = 1 << 17  # runs of letters whose ids a worker keeps
TEXTS_BYTES, COUNT_BYTES = 1 << 19, 1 << 21  # of texts that are worked, and encoded or counted, together
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_encoders: dict[int, Encoder] = {}


def _encoder(tokenizer_json: str) -> Encoder:
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(tokenizer_json, HELD_RUNS)
    return _encoders[key]


@contextmanager
def _short_batches(spark: SparkSession) -> Iterator[None]:
    """Texts go to Python in batches of a few MB, which executors hold beside their heap."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def round_of(doc_id: Column) -> Column:
    """The round that trains on a document."""
    return F.pmod(F.xxhash64(doc_id.cast("string"), F.lit(17)), F.lit(ROUNDS))


def _slices(column: pa.Array, most: int = TEXTS_BYTES):
    """(first row, number of rows) of slices of about ``most`` bytes."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    edge = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)] if len(sizes) else [0]
    for a, z in zip(edge, edge[1:]):
        yield a, z - a


def _encoded(encoder: Encoder, column: pa.Array, end: int):
    """(first row, number of rows, ids, ids of each text, ids of each word and end) of slices
    of ``TEXTS_BYTES``; several are encoded together, as they share most of their words."""
    for first, rows in _slices(column, COUNT_BYTES):
        whole = column.slice(first, rows)
        ids, n, pieces = encoder.encode(whole, end, pieces=True)
        at, words = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(pieces))
        for low, k in _slices(whole):
            own = slice(at[low], at[low + k])
            a, z = np.searchsorted(words, (own.start, own.stop))
            yield first + low, k, ids[own], n[low : low + k], pieces[a:z]
        pa.default_memory_pool().release_unused()


def _word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words of each text."""
    each = [h for _, h, _, _ in hashing.batch_words(column)]
    n = np.array([len(h) for h in each], np.int64)
    return (np.concatenate(each) if each else np.zeros(0, np.uint64)) >> np.uint64(1), n


def _count(batches):
    """text -> (word, n): the words of a few texts at a time, A-Z as a-z."""
    for batch in batches:
        for low, rows in _slices(batch.column("text"), COUNT_BYTES):
            column = batch.column("text").slice(low, rows)
            data, hashes, spans, at = [], [], [], 0
            for own, h, s, e in hashing.batch_words(column):
                data.append(own)
                hashes.append(h)
                spans.append(np.stack([s, e], 1) + at)
                at += len(own)
            _, first, times = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
            whole = np.concatenate(data).tobytes()
            cut = np.concatenate(spans)[first].tolist()
            words = [whole[a:z].translate(LOWER) for a, z in cut]
            words = pa.array([*words, END_TEXT], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([words, pa.array(np.append(times, rows))], ["word", "n"])


def _encode_words(shared, end: int):
    """(word, n) -> (kind, key, n): hashes of words (kind 0), counts of subword ids (1)."""

    def run(batches):
        encoder, ids = _encoder(shared.value), np.zeros(end + 1)
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            is_end = pc.equal(batch.column("word"), END_TEXT.decode()).to_numpy(zero_copy_only=False)
            key = np.full(len(n), END_WORD, np.int64)
            key[~is_end] = _word_hashes(batch.column("word"))[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(key), np.int32)), pa.array(key), pa.array(n)], ["kind", "key", "n"])
            ids[end] += n[is_end].sum()
            rest = np.flatnonzero(~is_end)
            for low in range(0, len(rest), 50_000):
                own = rest[low : low + 50_000]
                got, sizes = encoder.encode(batch.column("word").take(pa.array(own)), end)
                keep = got != end
                ids[:end] += np.bincount(got[keep], np.repeat(n[own], sizes)[keep], end)[:end]
        seen = np.flatnonzero(ids)
        counts = pa.array(ids[seen].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(seen), np.int32)), pa.array(seen), counts], ["kind", "key", "n"])

    return run


def _train(shared, weights, class_of, end: int, step: float, seed: int, passes: int):
    """text -> one row: how ``passes`` over the task's texts change the weights, and targets.
    Most rare ids are not met by a task; the zeros that stand for them are compressed."""

    def run(batches):
        encoder, classes = _encoder(shared.value), class_of.value
        model, done = attention.unpack(weights.value, _like(end)), 0
        for batch in batches:
            for _, _, ids, n, _ in _encoded(encoder, batch.column("text"), end):
                y = classes[ids]
                inputs, valid, place = attention.windows(y, n)
                targets = np.where(place >= 0, y[np.maximum(place, 0)], -1)
                for again in range(passes):
                    model = attention.train(model, inputs, valid, targets, step, seed + 100 * again)
                done += len(y)
        if done:
            yield _weights_row(done, attention.pack(model) - weights.value)

    return run


def _weights_row(n: int, weights: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([weights.astype("<f4").tobytes()], pa.binary())], ["n", "w"])


def _sum_weights(batches):
    n, w = 0, None
    for batch in batches:
        for k in range(batch.num_rows):
            m = batch.column("n")[k].as_py()
            own = np.frombuffer(batch.column("w")[k].as_py(), "<f4") * float(m)
            n, w = n + m, own if w is None else w + own
    if w is not None:
        yield _weights_row(n, w / n)


def _mean_weights(rows: DataFrame, start: np.ndarray) -> np.ndarray:
    """``start`` and the mean of the tasks' changes: means of means, 32 at a time, so no
    task gathers them all."""
    kind = "n bigint, w binary"
    width = 1024
    while width >= 1:
        rows = rows.repartition(width).mapInArrow(_sum_weights, kind) if width < 1024 else rows.mapInArrow(_sum_weights, kind)
        width //= 32
    got = [r for r in rows.collect() if r["n"]]
    return start + np.frombuffer(got[0]["w"], "<f4") if got else start


def _like(end: int) -> dict[str, np.ndarray]:
    """A model of the right shape: each of ``end + 1`` ids is a class or in the last one."""
    return attention.new_model(np.zeros(attention.CLASSES), log_share=np.zeros(max(0, end + 1 - attention.LAST)))


def _score(shared, weights, class_of, end: int, total: int, distinct: int):
    """(documents of a block, counts of its words) -> scores."""

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        encoder, classes = _encoder(shared.value), class_of.value
        model = attention.unpack(weights.value, _like(end))
        keys, n_of = (counts.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "n"))
        order = np.argsort(keys)
        keys, n_of = keys[order], n_of[order]
        texts_column = docs.column("text").combine_chunks()
        lower = np.log10(float(total + distinct + 1))
        out = []
        for low, rows, ids, n_ids, pieces in _encoded(encoder, texts_column, end):
            part = texts_column.slice(low, rows)
            h, n_words = _word_hashes(part)
            # the end stands after the words of each text
            words = np.insert(h.astype(np.int64), np.cumsum(n_words), END_WORD)
            n = n_words + 1
            at = np.minimum(np.searchsorted(keys, words), max(len(keys) - 1, 0))
            if not len(keys) or not np.array_equal(keys[at], words):
                raise RuntimeError("a block was read in other parts than before")
            c = n_of[at]
            base = np.log10(c + 1.0) - lower
            y = classes[ids]
            lp = attention.log_probs(model, y, n_ids)
            edge = np.append(0, np.cumsum(pieces))
            sums = np.append(0.0, np.cumsum(lp))
            own = (sums[edge[1:]] - sums[edge[:-1]]) / np.log(10)
            mixed = np.logaddexp2(
                base / np.log10(2) + np.log2(BASE_SHARE),
                np.where(pieces > 0, own / np.log10(2) + np.log2(1 - BASE_SHARE), -np.inf),
            ) * np.log10(2)
            first = np.cumsum(n) - n
            out.append((n, np.add.reduceat((c > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(mixed, first)))
        n, known, base, mixed = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0)] * 4
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        arrays = [pa.array(x, k) for x, k in zip((n, known, base, mixed), kinds)]
        return pa.Table.from_arrays(
            [docs.column("doc_id"), docs.column("held"), *arrays], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        )

    return run


def _block_words(batches):
    """block, text -> distinct words of each block, a few texts at a time."""
    for batch in batches:
        for low, rows in _slices(batch.column("text"), COUNT_BYTES):
            h, n = _word_hashes(batch.column("text").slice(low, rows))
            block = batch.column("block").slice(low, rows).to_numpy(zero_copy_only=False)
            for b in np.unique(block):
                words = np.append(np.unique(h[np.repeat(block == b, n)].astype(np.int64)), END_WORD)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), b)), pa.array(words)], ["block", "key"])


def _blocks(docs: DataFrame) -> DataFrame:
    """Adds ``block``: where a row stands in its file; a hash for other sources."""
    spark = docs.sparkSession
    most = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    parts = max(1, -(-most // BLOCK_BYTES))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    loose = max(1, -(-size // BLOCK_BYTES))
    by_id = F.xxhash64(F.col("doc_id").cast("string"))
    in_file = F.xxhash64(F.input_file_name(), F.input_file_block_start(), F.pmod(by_id, F.lit(parts)))
    return docs.withColumn("block", F.when(F.input_file_name() == "", F.pmod(by_id, F.lit(loose))).otherwise(in_file))


def score_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Scores of all documents, stored, as training is a job of its own in any case."""
    with _short_batches(docs.sparkSession):
        return materialize(_scores(docs, tokenizer_path))


def _scores(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    sc = spark.sparkContext
    ship_package(spark)
    tokenizer = Tokenizer.from_file(tokenizer_path)
    shared = sc.broadcast(tokenizer.to_str())
    end = tokenizer.get_vocab_size(with_added_tokens=True)  # an id of its own
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held"))
    learn = own.where(~F.col("held")).select("doc_id", "text")

    met = learn.select("text").mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counted = materialize(met.mapInArrow(_encode_words(shared, end), "kind int, key bigint, n bigint"))
    words = counted.where("kind = 0").select("key", "n")
    totals = words.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    total, distinct = int(totals[0] or 0), int(totals[1] or 0)
    id_counts = np.zeros(end + 1, np.int64)  # the vocabulary's size, whatever the corpus
    for r in counted.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).collect():
        id_counts[r["key"]] = r["n"]
    class_of, log_share, log_p = _classes(id_counts, end)

    symbol_of = _symbols(class_of)
    weights = attention.pack(attention.new_model(log_p, log_share=log_share[symbol_of > attention.BEGIN]))
    symbol_of = sc.broadcast(symbol_of)
    passes = min(PASSES, max(1, -(-2 * LEAST_WORDS * ROUNDS // max(1, total))))
    for i in range(ROUNDS if total else 0):
        now = sc.broadcast(weights.astype(np.float32))
        rows = learn.where(round_of(F.col("doc_id")) == i).select("text").mapInArrow(
            _train(shared, now, symbol_of, end, STEPS[i], i, passes), "n bigint, w binary"
        )
        weights = _mean_weights(rows, weights)
    now = sc.broadcast(weights.astype(np.float32))

    blocks = _blocks(own)
    asked = blocks.select("block", "text").mapInArrow(_block_words, "block bigint, key bigint").distinct()
    known = asked.join(words, "key", "left").select("block", "key", F.coalesce("n", F.lit(0)).alias("n"))
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("held_out", T.BooleanType()),
            *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")],
            *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")],
        ]
    )
    scored = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        _score(shared, now, symbol_of, end, total, distinct), schema
    )
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))


def _classes(counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each id, log probability of the id within its class, and of classes.

    The most frequent ids are classes of their own (the end always); the last class
    holds the others by their smoothed frequency.
    """
    rank = counts.astype(float)
    rank[end] = np.inf
    top = np.argsort(-rank, kind="stable")[: attention.CLASSES - 1]
    rest = attention.CLASSES - 1
    class_of = np.full(len(counts), rest, np.int64)
    class_of[top] = np.arange(len(top))
    others = class_of == rest
    log_share = np.zeros(len(counts))
    log_share[others] = np.log(counts[others] + 1.0) - np.log((counts[others] + 1.0).sum())
    by_class = np.bincount(class_of, counts, attention.CLASSES) + 1.0
    return class_of, log_share, np.log(by_class / by_class.sum())


def _symbols(class_of: np.ndarray) -> np.ndarray:
    """Symbol of each id: its class, or for those in the last class one of its own."""
    out = class_of.copy()
    rest = np.flatnonzero(class_of == attention.LAST)
    out[rest] = attention.BEGIN + 1 + np.arange(len(rest))
    return out


@query("op3_lm_scoring")
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
