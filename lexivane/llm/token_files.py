"""Token ids of whole texts in grammar-compressed shard files.

Texts are put in order of their ids by range partitioning, encoded, and cut into
shards of about ``SHARD_IDS`` ids. In a shard, Re-Pair runs in rounds: the most frequent
pairs of neighbouring ids become nonterminals, and occurrences are replaced without
overlap, those of the more frequent pair first, until no pair stands ``REPEATS`` times. A shard stores its rules, the length that each rule expands to, the
sequence and the documents' first ids; any range of ids is decoded by finding its place
among the expansion lengths, without the rest of the shard.

A shard is one binary value; Spark writes the shards as Parquet, in order, so its commit
protocol covers lost executors and any storage that Spark can write will do.

Words (texts cut at ASCII blanks) are encoded once for every ``TEXT_BYTES`` of texts, runs of
letters once per worker: the tokenizer drops blanks, so no token reaches over one. The tokenizer's file is read
by the driver and sent to the workers; it is some 2 MB whatever the input.

Null or empty text: the end id alone. Null ids come first; ties of ids stand in any order.
Repeated rows are stored one by one. Empty table: no shards. Columns of other names are
ignored.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexivane.llm.common import query, table
from lexivane.session import bounded_broadcast, scratch_path, ship_package, write_and_read

SHARD_IDS = 1 << 21
TEXT_BYTES = 1 << 24  # of texts that are encoded together
JOINED, TEXTS = 256, 64  # words that are encoded as one text, and texts at a time
MARK = "\x01"  # between them
HELD = 1 << 20  # runs of letters that an encoder keeps, some 40 bytes each
CACHED = 1 << 16  # words whose ids are put together at a time, so that they stay in the cache
SLOT_BITS = 20
REPEATS = 8
SHARE = 4  # a round takes the pairs that stand at least this part of the most frequent one's times
MAGIC = b"REPAIR02"
# rules under which a run of letters is a piece of its own, whatever stands around it
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PIECES = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_AT_BLANKS = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
_LETTERS = {"type": "Sequence", "pretokenizers": [_AT_BLANKS, _PIECES["pretokenizers"][1]]}
_HEAD_TAIL = re.compile(r"^(?P<head>[a-zß-öø-ÿ]+)(?P<tail>[!-/:-@\[-`{-~]*)$")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _places(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ``n`` places from each of ``first`` on."""
    at = np.cumsum(n) - n
    return np.repeat(first - at, n) + np.arange(n.sum())


class Encoder:
    """Ids of texts: each distinct word of a call goes through the tokenizer once."""

    def __init__(self, tokenizer_json: str, held: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark_id = mark[0] if len(mark) == 1 else None
        norm = self.tokenizer.normalizer
        self.folds = norm is not None and norm.normalize_str(_UPPER) == _UPPER.lower()
        self.letters, self.last, self.held = None, None, held
        self.known = (pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64))
        spec = json.loads(tokenizer_json)
        suffix = spec["model"].get("end_of_word_suffix")
        added = [t["content"].lower() for t in spec["added_tokens"]]
        if (spec["normalizer"], spec["pre_tokenizer"]) == (_NORMALIZER, _PIECES) and suffix and not any(map(_HEAD_TAIL.fullmatch, added)):
            # the same model for words of small letters, which the normalizer leaves as they are
            self.letters = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": _LETTERS}))
            ids = {i: t.endswith(suffix) for t, i in self.letters.get_vocab().items()}
            self.last = np.array([ids.get(i, False) for i in range(max(ids) + 1)])

    def _each(self, words: list[str], tokenizer=None) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in (tokenizer or self.tokenizer).encode_batch_fast(words, add_special_tokens=False)]

    def _joined(self, words: pa.Array, sep: str, ends_of, tokenizer=None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and the number of each one's. Many words are one text; where
        ``ends_of`` its ids does not tell the words apart, they are encoded one by one."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for low in range(0, len(words), JOINED * TEXTS):
            part = pa.concat_arrays([words.slice(low, JOINED * TEXTS)])
            edge = np.append(np.arange(0, len(part), JOINED), len(part)).astype(np.int32)
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(edge), part), sep).to_pylist()
            for k, got in enumerate(self._each(texts, tokenizer)):
                own = part[edge[k] : edge[k + 1]]
                kept, n = ends_of(own, got)
                if len(n) != len(own):
                    each = self._each(own.to_pylist())
                    kept, n = np.concatenate(each), np.array([len(x) for x in each], np.int64)
                ids.append(kept)
                sizes.append(n)
        return np.concatenate(ids), np.concatenate(sizes)

    def _by_mark(self, words: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.mark_id is None or pc.any(pc.match_substring(words, MARK)).as_py():
            return ids, ids[:0]
        at = np.flatnonzero(ids == self.mark_id)
        return np.delete(ids, at), np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1

    def _by_last(self, words: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)

    def _letters_of(self, heads: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_joined``; runs of letters that earlier calls met are looked up."""
        words, flat, size = self.known
        at = pc.index_in(heads, value_set=words)
        fresh = at.is_null()
        new = heads.filter(fresh)
        more, n = self._joined(new, " ", self._by_last, self.letters)
        flat, size = np.append(flat, more), np.append(size, n)
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[fresh.to_numpy(zero_copy_only=False)] = len(words) + np.arange(len(new))
        own = size[place]
        ids = flat[_places((np.cumsum(size) - size)[place], own)]
        full = len(size) > (HELD if self.held is None else self.held)
        self.known = (heads, ids, own) if full else (pa.concat_arrays([words, new]), flat, size)
        return ids, own

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, and the number of each one's."""
        if self.letters is None:
            return self._joined(words, f" {MARK} ", self._by_mark)
        # letters and the signs after them are never one piece: few letters, fewer signs
        cut = pc.extract_regex(words, _HEAD_TAIL.pattern)
        met = cut.is_valid().to_numpy(zero_copy_only=False)
        cut = cut.drop_null()
        head, tail = (cut.field(k).dictionary_encode() for k in (0, 1))
        rest = words.filter(pa.array(~met))
        h, t = len(head.dictionary), len(tail.dictionary)
        letters = self._letters_of(head.dictionary)
        others = self._joined(pa.concat_arrays([tail.dictionary, rest, pa.array([""])]), f" {MARK} ", self._by_mark)
        flat, size = (np.concatenate(x) for x in zip(letters, others))
        parts = np.full((len(words), 2), len(size) - 1)
        parts[met, 0], parts[met, 1] = head.indices.to_numpy(), h + tail.indices.to_numpy()
        parts[~met, 0] = h + t + np.arange(len(rest))
        n = size[parts]
        return flat[_places((np.cumsum(size) - size)[parts.ravel()], n.ravel())], n.sum(1)

    def encode(self, texts: pa.Array | list[str], end: int, pieces: bool = False) -> tuple[np.ndarray, ...]:
        """All ids, each text followed by ``end``, and the number of ids of each text;
        with ``pieces`` also the number of ids of each word and end."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        words = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        edge = words.offsets.to_numpy().astype(np.int64)
        met = words.values.slice(edge[0], edge[-1] - edge[0]).dictionary_encode()
        edge -= edge[0]
        code, distinct = met.indices.to_numpy(), met.dictionary
        if self.folds:  # one word whatever its case; other letters may depend on marks after them
            met = pc.if_else(pc.string_is_ascii(distinct), pc.ascii_lower(distinct), distinct).dictionary_encode()
            code, distinct = met.indices.to_numpy()[code], met.dictionary
        flat, size = self._ids_of(distinct)
        flat, size = np.append(flat, np.uint32(end)), np.append(size, 1)
        code = np.insert(code, edge[1:], len(distinct))
        first = np.cumsum(size) - size
        n = size[code]
        first = first[code]
        parts = [flat[_places(first[i : i + CACHED], n[i : i + CACHED])] for i in range(0, len(code), CACHED)]
        ids = np.concatenate([flat[:0], *parts])
        edge += np.arange(len(edge))  # with the ends
        counts = np.diff(np.append(0, np.cumsum(n))[edge])
        if not pieces:
            return ids, counts
        blank = pc.index(distinct, "").as_py()  # what stands before a first and after a last blank
        return ids, counts, n[code != blank]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each stands."""
    ordered = np.sort(keys)
    edge = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[edge], np.diff(np.append(edge, len(ordered)))


def _free(at: np.ndarray, rule: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which hits are replaced: where they overlap, that of the pair of lower rank, and
    of one pair in a row every other one. So copies are cut alike whatever is around."""
    run = np.append(True, (np.diff(at) > 1) | (np.diff(rule) != 0))
    place = np.arange(len(at))
    left = np.flatnonzero((place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0)
    out = [left[:0]]
    while len(left):
        own, r = at[left], rank[rule[left]]
        beside = np.diff(own) == 1
        loses = np.zeros(len(left), bool)
        loses[1:] |= beside & (r[1:] > r[:-1])
        loses[:-1] |= beside & (r[:-1] > r[1:])
        wins = ~loses
        out.append(left[wins])
        loses[1:] &= ~(beside & wins[:-1])
        loses[:-1] &= ~(beside & wins[1:])
        left = left[loses]
    return np.sort(np.concatenate(out))


def _replaced(at: np.ndarray, rule: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hits that are replaced, of pairs for which that happens twice or more."""
    while True:
        free = _free(at, rule, rank)
        few = (np.bincount(rule[free], minlength=len(rank)) < 2)[rule]
        if not few[free].any():
            return at[free], rule[free]
        at, rule = at[~few], rule[~few]


def _slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number below 2 ** SLOT_BITS for each pair."""
    mixed = left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA6B)
    return (mixed >> np.uint32(32 - SLOT_BITS)).astype(np.int64)


def repair(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, rules): rule i stands for symbol ``base + i`` and is two symbols.

    Pairs are counted by slots; a slot's count is no less than that of any of its pairs,
    so only pairs of slots with many are sorted and counted by themselves.
    """
    seq, rules = ids.astype(np.uint32), np.zeros((0, 2), np.uint32)
    slots = _slots(seq[:-1], seq[1:])
    held = np.bincount(slots, minlength=1 << SLOT_BITS)
    place = np.zeros(1 << SLOT_BITS, np.int32)
    while len(slots):
        for least in (max(REPEATS, int(held.max()) // SHARE), REPEATS):
            at = np.flatnonzero((held >= least)[slots])
            own = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
            keys, n = _counted(own)
            if len(n) and n.max() >= least:
                break
        else:
            break
        top = np.flatnonzero(n >= max(least, n.max() // SHARE))
        chosen = keys[top[np.argsort(-n[top], kind="stable")]]
        chosen = np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        # of pairs with one slot the most frequent is replaced now, the others in later rounds
        where = _slots(*chosen[::-1].T)
        place[where] = np.arange(len(chosen) - 1, -1, -1)
        rule = place[slots[at]]
        place[where] = 0
        hit = np.flatnonzero((chosen[rule, 0] == seq[at]) & (chosen[rule, 1] == seq[at + 1]))
        at, rule = _replaced(at[hit], rule[hit], np.arange(len(chosen)))
        used = np.flatnonzero(np.bincount(rule, minlength=len(chosen)))
        symbol = np.zeros(len(chosen), np.uint32)
        symbol[used] = base + len(rules) + np.arange(len(used))
        # pairs at and next to the replaced places go
        near = np.zeros(len(seq) + 1, bool)
        near[at] = near[at + 1] = near[at - 1] = True  # before the first place: the last entry, cut off
        np.subtract.at(held, slots[np.flatnonzero(near[: len(slots)])], 1)
        seq[at] = symbol[rule]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        slots = slots[keep[:-1]][: len(seq) - 1]
        # and those with a new symbol come
        at = at - np.arange(len(at))
        near = np.zeros(len(seq) + 1, bool)
        near[at] = near[at - 1] = True
        new = np.flatnonzero(near[: len(slots)])
        slots[new] = _slots(seq[new], seq[new + 1])
        np.add.at(held, slots[new], 1)
        rules = np.concatenate([rules, chosen[used]])
    return seq, rules


def _levels(rules: np.ndarray, base: int):
    """(first, past the last) of rules that use only symbols of earlier ones."""
    most = np.maximum.accumulate(rules.max(1)) if len(rules) else rules
    low = 0
    while low < len(rules):
        high = int(np.searchsorted(most, base + low))
        yield low, high
        low = high


def _lengths(rules: np.ndarray, base: int) -> np.ndarray:
    out = np.ones(base + len(rules), np.int64)
    for low, high in _levels(rules, base):
        out[base + low : base + high] = out[rules[low:high]].sum(1)
    return out


def _planes(symbols: np.ndarray, bits: int) -> bytes:
    """The 16 low bits of all symbols, then each further bit of all."""
    high = [np.packbits(symbols >> b & 1).tobytes() for b in range(16, bits)]
    return symbols.astype("<u2").tobytes() + b"".join(high)


def _from_planes(data: bytes, n: int, bits: int, at: int) -> tuple[np.ndarray, int]:
    """(symbols, where they end)."""
    out, at, size = np.frombuffer(data, "<u2", n, at).astype(np.int64), at + 2 * n, -(-n // 8)
    for b in range(16, bits):
        out |= np.unpackbits(np.frombuffer(data, "u1", size, at), count=n).astype(np.int64) << b
        at += size
    return out, at


def pack(ids: np.ndarray, counts: np.ndarray, base: int) -> bytes:
    """A shard: head, rules, expansion lengths, sequence, ids per document."""
    seq, rules = repair(ids, base)
    bits = max(16, (base + len(rules) - 1).bit_length())
    out = io.BytesIO()
    out.write(MAGIC + struct.pack("<5Q", base, len(rules), len(seq), len(counts), bits))
    out.write(_planes(rules.ravel(), bits))
    out.write(_lengths(rules, base)[base:].astype("<u4").tobytes())
    out.write(_planes(seq, bits))
    out.write(counts.astype("<u4").tobytes())
    return out.getvalue()


@dataclass
class Shard:
    base: int
    rules: np.ndarray
    lengths: np.ndarray  # of all symbols
    seq: np.ndarray
    counts: np.ndarray

    @classmethod
    def read(cls, data: bytes) -> Shard:
        if data[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        base, n_rules, n_seq, n_docs, bits = struct.unpack_from("<5Q", data, 8)
        rules, at = _from_planes(data, 2 * n_rules, bits, 48)
        own = np.frombuffer(data, "<u4", n_rules, at).astype(np.int64)
        seq, at = _from_planes(data, n_seq, bits, at + 4 * n_rules)
        counts = np.frombuffer(data, "<u4", n_docs, at).astype(np.int64)
        lengths = np.concatenate([np.ones(base, np.int64), own])
        return cls(base, rules.reshape(-1, 2), lengths, seq, counts)

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All symbols' ids, one after another, and where each symbol's ids begin."""
        first = np.append(0, np.cumsum(self.lengths))
        flat = np.zeros(first[-1], np.uint32)
        flat[: self.base] = np.arange(self.base)
        for low, high in _levels(self.rules, self.base):
            both = self.rules[low:high].ravel()
            size = self.lengths[both]
            at = np.cumsum(size) - size
            flat[first[self.base + low] : first[self.base + high]] = flat[np.repeat(first[both] - at, size) + np.arange(size.sum())]
        return flat, first

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, first = self._expansions()
        size = self.lengths[symbols]
        at = np.cumsum(size) - size
        return flat[np.repeat(first[symbols] - at, size) + np.arange(size.sum())]

    def _expand_few(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of some symbols, by their own rules alone, level by level."""
        out = symbols.astype(np.int64)
        while (out >= self.base).any():
            pair = out >= self.base
            at = np.cumsum(1 + pair) - 1 - pair
            wide = np.empty(len(out) + int(pair.sum()), np.int64)
            wide[at] = out
            wide[at[pair]], wide[at[pair] + 1] = self.rules[out[pair] - self.base].T
            out = wide
        return out.astype(np.uint32)

    def ids(self) -> np.ndarray:
        return self._expand(self.seq)

    def ids_between(self, low: int, high: int) -> np.ndarray:
        """Ids low to high - 1 of the shard; only the symbols that cover them."""
        ends = np.cumsum(self.lengths[self.seq])
        a, z = np.searchsorted(ends, (low, high - 1), "right")
        first = ends[a] - self.lengths[self.seq[a]]
        return self._expand_few(self.seq[a : z + 1])[low - first : high - first]

    def document(self, i: int) -> np.ndarray:
        start = int(self.counts[:i].sum())
        return self.ids_between(start, start + int(self.counts[i]))


_encoders: dict[int, Encoder] = {}


def _write_shards(shared, end: int, base: int, id_type, shard_ids: int):
    def run(batches):
        key = zlib.crc32(shared.value.encode())
        if key not in _encoders:  # kept by the worker for its next tasks
            _encoders[key] = Encoder(shared.value)
        encoder, part, n = _encoders[key], TaskContext.get().partitionId(), 0
        ids, counts, docs, held = [], [], [], 0

        def flush():
            sizes = np.concatenate(counts)
            row = [[part], [n], [int(sizes.sum())], [[x for d in docs for x in d.to_pylist()]], [pack(np.concatenate(ids), sizes, base)]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(id_type), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["part", "seq", "n_ids", "doc_ids", "payload"])

        for batch in batches:
            texts = batch.column("text")
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + TEXT_BYTES, "right")))
                got, own = encoder.encode(texts.slice(low, high - low), end)
                edge = np.append(0, np.cumsum(own))
                i = 0
                while i < len(own):  # up to the document that fills the shard
                    j = min(len(own), int(np.searchsorted(edge, edge[i] + shard_ids - held)))
                    j = max(j, i + 1)
                    ids.append(got[edge[i] : edge[j]])
                    counts.append(own[i:j])
                    docs.append(batch.column("doc_id").slice(low + i, j - i))
                    held += int(edge[j] - edge[i])
                    i = j
                    if held >= shard_ids:
                        yield flush()
                        ids, counts, docs, held, n = [], [], [], 0, n + 1
                low = high
        if held:
            yield flush()

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, end: int, path: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the shards of ``docs`` to ``path`` and returns them as they were read back."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    ship_package(spark)
    tokenizer = Tokenizer.from_file(tokenizer_path)
    shared = spark.sparkContext.broadcast(tokenizer.to_str())
    base = max(tokenizer.get_vocab_size(with_added_tokens=True), end + 1)
    id_kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("seq", T.IntegerType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(id_kind)),
            T.StructField("payload", T.BinaryType()),
        ]
    )
    id_type = to_arrow_type(id_kind)
    ordered = docs.select("doc_id", F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return write_and_read(ordered.mapInArrow(_write_shards(shared, end, base, id_type, shard_ids), schema), path)


def _read_shards(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            shard = Shard.read(batch.column("payload")[k].as_py())
            ids, n = shard.ids().astype("<u4"), shard.counts
            cut = np.append(0, np.cumsum(n))
            crc = [zlib.crc32(ids[cut[i] : cut[i + 1]].tobytes()) for i in range(len(n))]
            rows = len(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column("part")[k].as_py()] * rows, pa.int32()),
                    pa.array([batch.column("seq")[k].as_py()] * rows, pa.int32()),
                    batch.column("doc_ids").slice(k, 1).flatten(),
                    pa.array(cut[:-1], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"],
            )


def read_token_files(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, decoded from the files."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    own = shards.select("part", "seq", "doc_ids", "payload").mapInArrow(
        _read_shards, f"part int, seq int, doc_id {kind}, local bigint, n_tokens bigint, ids_crc32 bigint"
    )
    # sums of parts are ordered first, one row for each writing task, then shards in their part
    before = lambda c, order: F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", before("n", Window.orderBy("part")).alias("part_first"))
    own_first = before("n_ids", Window.partitionBy("part").orderBy("seq"))
    firsts = shards.select("part", "seq", own_first.alias("own_first")).join(bounded_broadcast(parts), "part")
    firsts = firsts.select("part", "seq", (F.col("part_first") + F.col("own_first")).alias("first"))
    return own.join(bounded_broadcast(firsts), ["part", "seq"]).select(
        "doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )


@query("op10_token_id_output")
def op10_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token-files")
    return read_token_files(
        write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, path)
    )
