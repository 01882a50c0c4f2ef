import math
import re
import zlib
from collections import Counter
from types import SimpleNamespace as Value

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexivane.llm import attention, lm

W = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    tokens = [W.findall((t or "").translate(LOW)) + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(x for w, h in zip(tokens, held) if not h for x in w)
    n, v = sum(c.values()), len(c)
    return [(h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for w, h in zip(tokens, held)]


def check(got, rows):
    want = {}
    for (i, t), b in zip(rows, brute(rows)):
        want.setdefault(i, []).append(b)
    for r in got:
        assert any(
            (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == b[:4] and r["base_score"] == pytest.approx(b[4]) for b in want[r["doc_id"]]
        ), r
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_held_out_texts_score_above_word_frequencies(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = lm.score_documents(df, PATH).collect()
    assert len(got) == len(rows)
    check(got, rows)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_edge_rows_and_tables_that_are_no_files(spark):
    rows = [(1, None), (2, ""), (3, "Word word WORD"), (3, "Word word WORD"), (None, "é it's <|endoftext|> x"), (5, "y " * 30_000), (10, "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "true as held", "'k' as key")
    got = lm.score_documents(df, PATH).collect()
    assert len(got) == len(rows)
    check(got, rows)
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_class_probabilities_sum_to_one_and_see_only_the_past():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, 49_409)
    class_of, share, log_p = lm._classes(counts, 49_408)
    rest = class_of == attention.CLASSES - 1
    assert np.exp(share[rest]).sum() == pytest.approx(1) and np.exp(log_p).sum() == pytest.approx(1)
    model = attention.new_model(log_p)
    text = rng.integers(0, attention.CLASSES, 70)
    whole = attention.log_probs(model, text, np.array([70]))
    for cut in (1, 16, 33, 69):
        assert np.allclose(attention.log_probs(model, text[:cut], np.array([cut])), whole[:cut], atol=1e-4)
    head = [attention.log_probs(model, np.append(text[:20], y), np.array([21]))[20] for y in range(attention.CLASSES)]
    assert np.exp(head).sum() == pytest.approx(1, abs=1e-3)


def test_each_token_is_scored_once():
    counts = np.array([1, 0, 16, 17, 40])
    _, _, place = attention.windows(np.arange(counts.sum()) % 9, counts)
    assert sorted(place[place >= 0].tolist()) == list(range(counts.sum()))


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    m = {k: v.astype(float) for k, v in attention.new_model(np.full(attention.CLASSES, -np.log(attention.CLASSES))).items()}
    y = rng.integers(0, 100, 60)
    inputs, valid, place = attention.windows(y, np.array([25, 35]))
    targets = np.where(place >= 0, y[np.maximum(place, 0)], -1)
    _, d = attention.gradients(m, inputs, valid, targets)
    for k in m:
        at = np.unravel_index(np.argmax(abs(d[k])), d[k].shape)
        side = []
        for e in (1e-5, -2e-5):
            m[k][at] += e
            side.append(attention.gradients(m, inputs, valid, targets)[0])
        m[k][at] += 1e-5
        assert d[k][at] == pytest.approx((side[0] - side[1]) / 2e-5, rel=1e-3, abs=1e-8)


def test_every_training_document_trains_the_model(spark, monkeypatch):
    """Also where the corpus is far larger than what is passed again."""
    monkeypatch.setattr(lm, "LEAST_WORDS", 100)
    rows = [(i, f"text {i} " + "of many plain words " * 15) for i in range(500)]
    trained = []
    mean = lm._mean_weights

    def spy(made, start):
        made = made.localCheckpoint()
        trained.append(made.agg(F.sum("n")).first()[0] or 0)
        return mean(made, start)

    monkeypatch.setattr(lm, "_mean_weights", spy)
    lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), PATH)
    encoder = lm._encoder(Tokenizer.from_file(PATH).to_str())
    texts = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    assert sum(trained) == len(encoder.encode(texts, 0)[0]) and all(trained)


def test_rare_ids_depend_on_what_stands_before():
    counts = np.arange(49_409)[::-1].copy()
    class_of, share, log_p = lm._classes(counts, 49_408)
    symbol = lm._symbols(class_of)
    assert len(np.unique(symbol)) == len(counts)
    model = attention.new_model(log_p, log_share=share[symbol > attention.BEGIN])
    assert {k: v.shape for k, v in model.items()} == {k: v.shape for k, v in lm._like(49_408).items()}
    rare = symbol[[30_000, 40_000, 45_000, 48_000]]

    def of(*text):
        return attention.log_probs(model, np.array(text), np.array([len(text)]))

    own = np.flatnonzero(symbol > attention.BEGIN)
    pairs = np.stack([np.full(len(own), symbol[7]), symbol[own]], 1).ravel()
    last = attention.log_probs(model, pairs, np.full(len(own), 2))[1::2]
    assert np.exp(last).sum() == pytest.approx(np.exp(of(symbol[7], attention.LAST)[1]), rel=1e-3)
    rng = np.random.default_rng(1)
    y = np.concatenate([(symbol[rng.integers(0, 9, rng.integers(1, 3))], rare[:2], rare[2:])[rng.integers(3)] for _ in range(800)])
    inputs, valid, place = attention.windows(y, np.array([len(y)]))
    targets = np.where(place >= 0, y[np.maximum(place, 0)], -1)
    for k in range(60):
        model = attention.train(model, inputs, valid, targets, 0.02, k)
    assert of(rare[0], rare[1])[1] > of(rare[2], rare[1])[1] + 0.5


def test_gradients_of_rare_ids_equal_differences():
    rng = np.random.default_rng(3)
    share = np.full(50, -np.log(50))
    m = {k: v.astype(float) for k, v in attention.new_model(np.full(attention.CLASSES, -np.log(attention.CLASSES)), log_share=share).items()}
    y = np.where(rng.random(60) < 0.5, rng.integers(0, 100, 60), attention.BEGIN + 1 + rng.integers(0, 50, 60))
    inputs, valid, place = attention.windows(y, np.array([25, 35]))
    targets = np.where(place >= 0, y[np.maximum(place, 0)], -1)
    _, d = attention.gradients(m, inputs, valid, targets)
    for k in m:
        at = np.unravel_index(np.argmax(abs(d[k])), d[k].shape)
        side = []
        for e in (1e-5, -2e-5):
            m[k][at] += e
            side.append(attention.gradients(m, inputs, valid, targets)[0])
        m[k][at] += 1e-5
        assert d[k][at] == pytest.approx((side[0] - side[1]) / 2e-5, rel=1e-3, abs=1e-8)


def test_texts_come_in_short_batches_and_the_setting_stays(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    monkeypatch.setitem(lm.BATCH, key, "20000")
    df = spark.range(400).selectExpr("id as doc_id", "repeat('some words ', 100) as text").repartition(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": [b.num_rows]})

    with lm._short_batches(spark):
        got = [r["doc_id"] for r in df.mapInArrow(sizes, "doc_id long").collect()]
    assert sum(got) == 400 and max(got) < 100
    assert spark.conf.get(key, None) == before


def test_a_task_sends_only_what_it_changes(spark):
    end = Tokenizer.from_file(PATH).get_vocab_size(with_added_tokens=True)
    symbol = lm._symbols(lm._classes(np.arange(end + 1), end)[0])
    start = attention.pack(lm._like(end)).astype(np.float32)
    texts = pa.RecordBatch.from_pydict({"text": ["a few plain words"] * 9})
    (row,) = lm._train(Value(value=Tokenizer.from_file(PATH).to_str()), Value(value=start), Value(value=symbol), end, 0.01, 0, 1)([texts])
    change = np.frombuffer(row.column("w")[0].as_py(), "<f4")
    assert len(change) == len(start) and 0 < np.count_nonzero(change) < len(start) / 10
    mean = lm._mean_weights(spark.createDataFrame([(1, b"\0\0\x80?"), (3, b"\0\0\0\0")], "n bigint, w binary"), np.ones(1, np.float32))
    assert mean == pytest.approx([1.25])


def test_an_encoder_keeps_no_more_runs_than_it_may():
    json = Tokenizer.from_file(PATH).to_str()
    few, many = lm.Encoder(json, 1000), lm.Encoder(json)
    rng = np.random.default_rng(4)
    for _ in range(6):
        texts = ["".join(map(chr, 97 + x)) for x in rng.integers(0, 26, (400, 7))]
        for a, b in zip(few.encode(texts, 0), many.encode(texts, 0)):
            assert np.array_equal(a, b)
        assert len(few.known[0]) <= 1400
    assert len(many.known[0]) > 2300


def test_adam_in_place_equals_its_formula():
    rng = np.random.default_rng(5)
    m, first, second, g = (abs(rng.standard_normal((3, 4))).astype(np.float32) for _ in range(4))
    a, b = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
    want = m - 0.01 * (a / (1 - 0.9**3)) / (np.sqrt(b / (1 - 0.99**3)) + 1e-6)
    attention._adam(m, first, second, g, 0.01, 3)
    assert np.allclose(m, want, atol=1e-6) and np.allclose(first, a, atol=1e-6) and np.allclose(second, b, atol=1e-6)
