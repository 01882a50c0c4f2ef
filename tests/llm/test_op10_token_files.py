import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from lexivane.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    tok, out, start = Tokenizer.from_file(PATH), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_hold_the_ids_of_whole_texts_in_order(spark, folder):
    rng = random.Random(4)
    odd = ["", None, "It's don't I'LL", "<|endoftext|> a<|startoftext|>b", "é É ß 🙂́ x y\x1cz\x85q", "a\tb\r\nc\x0bd\x0ce", "1234 5", "É ﬁ Σας ΣΑΣ", "x" * 5000, "word " * 40_000]
    rows = [(i * 7 % 211, rng.choice(odd[:-1]) if i % 2 else " ".join(rng.choice(["the", "Of", "anda", "the."]) for _ in range(rng.choice([3, 300])))) for i in range(211)]
    rows += [(1000 + i, t) for i, t in enumerate(odd)] + [(None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 as part", "2 as seq", "'p' as payload")
    shards = tf.write_token_files(df, PATH, 1, folder + "/ids", shard_ids=5000)
    assert shards.count() > 4
    got = sorted(map(tuple, tf.read_token_files(shards).collect()), key=lambda r: r[1])
    assert got == brute(rows)
    assert tf.read_token_files(tf.write_token_files(df.limit(0), PATH, 1, folder + "/none")).count() == 0


def test_repeated_rows_are_stored_one_by_one(spark, folder):
    df = spark.createDataFrame([(3, "same text"), (3, "same text"), (2, None)], "doc_id long, text string")
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in tf.read_token_files(tf.write_token_files(df, PATH, 1, folder + "/ids")).collect())
    assert got == [(0, 2, 1), (1, 3, 3), (4, 3, 3)]


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(6)
    phrase = rng.integers(2, 40_000, 60)
    for ids in (np.tile(phrase, 400), rng.integers(2, 9, 30_000), np.full(10_000, 5), np.arange(500), np.zeros(0, int), np.array([3])):
        counts = np.array([len(ids) // 3, 0, len(ids) - len(ids) // 3])
        data = tf.pack(ids.astype(np.uint32), counts, 49_408)
        shard = tf.Shard.read(data)
        assert np.array_equal(shard.ids(), ids)
        for low, high in ((0, 1), (len(ids) // 2, len(ids) // 2 + 7), (len(ids) - 1, len(ids))):
            if 0 <= low < high <= len(ids):
                assert np.array_equal(shard.ids_between(low, high), ids[low:high])
        assert np.array_equal(shard.lengths[shard.base :], [len(shard._expand(np.array([shard.base + i]))) for i in range(len(shard.rules))])
    packed = tf.pack(np.tile(phrase, 400).astype(np.uint32), np.array([24_000]), 49_408)
    assert len(packed) < 24_000 * 2 / 4 and np.array_equal(tf.Shard.read(packed).document(0), np.tile(phrase, 400))


def test_no_pair_repeats_when_a_grammar_is_done():
    rng = np.random.default_rng(7)
    long_copy = np.tile(rng.integers(2, 40_000, 5000), 40)
    few = rng.integers(2, 60, 60_000)
    many = np.repeat(rng.integers(2, 49_000, (30_000, 2)), 9, axis=0)[rng.permutation(270_000)].ravel()  # over 65536 symbols
    for ids in (long_copy, few, many, np.full(3000, 7), np.append(long_copy, rng.integers(2, 40_000, 300_000))):
        seq, rules = tf.repair(ids.astype(np.uint32), 49_408)
        pairs, n = np.unique(seq[:-1].astype(np.int64) << 32 | seq[1:], return_counts=True)
        assert not len(n) or n.max() < tf.REPEATS
        shard = tf.Shard.read(tf.pack(ids.astype(np.uint32), np.array([len(ids)]), 49_408))
        assert np.array_equal(shard.ids(), ids) and shard.lengths.max() <= len(ids)
    assert len(tf.repair(many.astype(np.uint32), 49_408)[1]) > 1 << 14
    seq, rules = tf.repair(long_copy.astype(np.uint32), 49_408)
    assert len(seq) < 400


def test_a_range_uses_its_own_rules_alone():
    rng = np.random.default_rng(9)
    parts = [np.tile(rng.integers(2, 40_000, 50), 60) for _ in range(6)]
    ids = np.concatenate(parts).astype(np.uint32)
    shard = tf.Shard.read(tf.pack(ids, np.full(6, 3000), 49_408))
    shard._expansions = None  # all rules at once are for whole shards
    assert np.array_equal(shard.document(2), parts[2])
    used, todo = set(), set(shard.seq.tolist())
    ends = np.cumsum(shard.lengths[shard.seq])
    a, z = np.searchsorted(ends, (6000, 8999), "right")
    todo = set(shard.seq[a : z + 1].tolist())
    while todo:
        used |= todo
        todo = {int(x) for s in todo if s >= shard.base for x in shard.rules[s - shard.base]} - used
    others = [i for i in range(len(shard.rules)) if shard.base + i not in used]
    shard.rules = shard.rules.copy()
    shard.rules[others] = shard.base + len(shard.rules)  # out of range for whoever looks
    assert others and np.array_equal(shard.document(2), parts[2])


def test_ids_of_any_kind(spark, folder):
    for i, kind in enumerate(("smallint", "decimal(20,0)", "date", "double")):
        df = spark.createDataFrame([(3, "a b"), (1, "c")], "n int, text string").selectExpr(f"cast(cast(n as {'timestamp' if kind == 'date' else 'int'}) as {kind}) as doc_id", "text")
        got = tf.read_token_files(tf.write_token_files(df, PATH, 1, f"{folder}/{i}"))
        assert got.schema["doc_id"].dataType.simpleString() == kind and got.agg({"n_tokens": "sum"}).first()[0] == 5


def test_a_word_is_encoded_once_whatever_its_case_and_signs():
    enc, text = tf.Encoder(Tokenizer.from_file(PATH).to_str()), "The the, THE! the's über. Über a_b \x01 x\x01y don'. H̱ ẖ x<|endoftext|>. lead"
    texts = [f" {text} ", None, "", f"{text}\n" * 3]
    met = []
    for t in ("tokenizer", "letters"):
        whole = getattr(enc, t)
        setattr(enc, t, type("", (), {"encode_batch_fast": lambda self, x, whole=whole, **k: [met.extend(y.split(" ")) for y in x] and whole.encode_batch_fast(x, **k)})())
    ids, n, pieces = enc.encode(pa.array(texts), 1, pieces=True)
    plain = Tokenizer.from_file(PATH)
    want = [plain.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert ids.tolist() == sum(want, []) and n.tolist() == list(map(len, want))
    words = [w for t in texts for w in [*(t or "").replace("\n", " ").split(" "), None] if w != ""]
    each = [1 if w is None else len(plain.encode(w, add_special_tokens=False).ids) for w in words]
    assert pieces.tolist() == each
    assert met.count("the") == 1 and "THE!" not in met and "the," not in met


def test_what_is_kept_of_earlier_texts_does_not_show(monkeypatch):
    monkeypatch.setattr(tf, "HELD", 3)
    monkeypatch.setattr(tf, "CACHED", 2)
    enc, plain = tf.Encoder(Tokenizer.from_file(PATH).to_str()), Tokenizer.from_file(PATH)
    for t in ("one two", "two three. one", "four five six two", "", "one four, seven"):
        want = plain.encode(t, add_special_tokens=False).ids + [1]
        assert enc.encode([t], 1)[0].tolist() == want
        assert len(enc.known[0]) == len(enc.known[2]) <= 4 and len(enc.known[1]) == enc.known[2].sum()
