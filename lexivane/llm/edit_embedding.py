"""Fingerprints by randomised edit embedding (random walks over characters).

A walk reads a text from its first character. At time ``j`` it notes the character it
stands on and goes on to the next one if a bit shared by all texts, drawn for ``j`` and
the character, is 1. Walks over two texts that meet again after an edit stay together,
so few edits leave most of the notes equal: edit distance becomes Hamming distance.

The fingerprint samples the notes: ``SAMPLES`` times of each octave (times 0 to 31, 32 to
63, 64 to 127 and so on), the same for all texts, each as a hexadecimal digit drawn for
the time and the character; ``.`` stands after the text's end. ``likeness`` is the share
of equal samples, an octave counting by its times, over the times of the longer walk.
Equal texts have equal fingerprints.

``near_classes`` finds documents of alike fingerprints: keys of ``ROWS`` sampled digits
(``BANDS`` of them) put candidates together, and the fingerprints verify them.

Null text: empty, whose fingerprint is the empty string; two empty ones are alike (1.0),
an empty and another one are not (0.0). Texts are walked whole, many at a time, long
ones to their end. Order is by descending id, null ids last, equal ids by a hash of the
text; a lone document is its own successor. Repeated rows: each has its row. Empty table:
no rows. Further columns are ignored. Texts are shuffled once, to ranges of ids; what a
task keeps is bounded by ``GROUP_CHARS`` and its longest text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.llm.common import query, table, text_or_empty
from lexivane.llm.components import components
from lexivane.session import bounded_broadcast, materialize, ship_package

SAMPLES = 32
CLASSES = 64  # characters are drawn for by a class of theirs
PERIOD = 4096  # of the shared bits
GROUP_CHARS = 1 << 22
FEW = 96  # so many texts or fewer are walked one by one
BANDS, ROWS = 32, 8
LEAST = 0.8

_RNG = np.random.default_rng(20130213)
_OCTAVES = 33


def _strides() -> np.ndarray:
    """For each class and time, how long the walk stays from that time on."""
    bits = _RNG.integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
    bits[:, ::61] = 1  # no stay is longer than a byte can tell
    stay, out = np.zeros(CLASSES, np.int64), np.zeros((CLASSES, PERIOD), np.uint8)
    for t in range(2 * PERIOD - 1, -1, -1):
        stay = np.where(bits[:, t % PERIOD] == 1, 1, stay + 1)
        out[:, t % PERIOD] = stay
    return out.ravel()


STRIDES = _strides()
_STRIDE_LIST = STRIDES.tolist()


def octave_start(o: int) -> int:
    return 0 if o == 0 else SAMPLES << (o - 1)


def _times() -> np.ndarray:
    out = np.zeros((_OCTAVES, SAMPLES), np.int64)
    for o in range(_OCTAVES):
        width = max(1, octave_start(o)) if o else SAMPLES
        step = width // SAMPLES
        out[o] = octave_start(o) + np.arange(SAMPLES) * step + (_RNG.integers(0, step, SAMPLES) if step > 1 else 0)
    return out


TIMES = _times()
WEIGHTS = np.array([1] + [max(1, octave_start(o) // SAMPLES) for o in range(1, _OCTAVES)], np.float64)
DIGITS = _RNG.integers(0, 16, (_OCTAVES * SAMPLES, CLASSES), dtype=np.uint8)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
PAD = ord(".")


def char_classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((points * np.uint32(2654435761)) >> np.uint32(26)).astype(np.uint8)


def walk(codes: np.ndarray, first: np.ndarray, n: np.ndarray, start: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Times at which the walks over ``codes[first:first + n]`` end that start at
    ``start``; ``out`` gets the time at which each character is reached."""
    order = np.argsort(-n, kind="stable")
    at, left, now = first[order].astype(np.int64), n[order], start[order].astype(np.int64)
    active, i = int(np.searchsorted(-left, 0)), 0
    while active > FEW:
        pos, t = at[:active] + i, now[:active]
        if out is not None:
            out[pos] = t
        t += STRIDES[(codes[pos].astype(np.int64) << 12) | (t & (PERIOD - 1))]
        i += 1
        while active and left[active - 1] <= i:
            active -= 1
    for k in range(active):
        a, z, t = int(at[k]) + i, int(at[k] + left[k]), int(now[k])
        times = []
        for c in codes[a:z].tolist():
            times.append(t)
            t += _STRIDE_LIST[(c << 12) | (t & 4095)]
        if out is not None:
            out[a:z] = times
        now[k] = t
    ends = np.empty(len(n), np.int64)
    ends[order] = now
    return ends


def read_notes(parts: list[tuple[np.ndarray, np.ndarray]], end: int) -> bytes:
    """The fingerprint of a walk given by the (times, codes) of its parts, up to ``end``."""
    if end == 0:
        return b""
    octaves = 1 if end <= SAMPLES else (end - 1).bit_length() - 4
    times = TIMES[:octaves].ravel()
    out = np.full(len(times), PAD, np.uint8)
    met = np.arange(len(times))
    for when, codes in reversed(parts):
        if not len(when):
            continue
        here = met[(times[met] >= when[0]) & (times[met] < end)]
        code = codes[np.searchsorted(when, times[here], "right") - 1]
        out[here] = _HEX[DIGITS[here, code]]
        end = int(when[0])
    return out.tobytes()


def fingerprints_of(texts: list[str]) -> tuple[list[bytes], tuple]:
    """Fingerprints, and the walks (codes, first, n, times, ends) for those who go on."""
    n = np.array([len(t) for t in texts], np.int64)
    codes = np.concatenate([char_classes(t) for t in texts]) if len(texts) else np.zeros(0, np.uint8)
    first = np.cumsum(n) - n
    times = np.zeros(len(codes), np.int64)
    ends = walk(codes, first, n, np.zeros(len(n), np.int64), times)
    prints = [read_notes([(times[a : a + m], codes[a : a + m])], int(e)) for a, m, e in zip(first, n, ends)]
    return prints, (codes, first, n, times, ends)


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal notes of two fingerprints, 0 to 1."""
    size = max(len(a), len(b))
    if size == 0:
        return 1.0
    x, y = (np.frombuffer(p.ljust(size, b"."), np.uint8) for p in (a, b))
    weight = np.repeat(WEIGHTS[: size // SAMPLES], SAMPLES)
    noted = (x != PAD) | (y != PAD)
    return float((weight * (noted & (x == y))).sum() / (weight * noted).sum())


def compare_with_next(texts: list[str], rows: np.ndarray, following: np.ndarray) -> list[tuple]:
    """(n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)
    of ``texts[rows]``, each followed by ``texts[following]``."""
    prints, (codes, first, n, times, ends) = fingerprints_of(texts)
    cut = n[rows] // 2
    kept, taken = n[rows] - cut, np.minimum(cut, n[following])
    joint = ends[rows].copy()  # when the walk comes to the first character of the other text
    inside = cut > 0
    joint[inside] = times[(first[rows] + kept)[inside]]
    # the other text's own times are still needed: its beginnings are walked as copies
    starts = np.cumsum(taken) - taken
    tails = np.concatenate([codes[a : a + m] for a, m in zip(first[following], taken)]) if len(rows) else codes[:0]
    when = np.zeros(len(tails), np.int64)
    over = walk(tails, starts, taken, joint, when)
    out = []
    for k, (r, f) in enumerate(zip(rows, following)):
        a, s = int(first[r]), slice(int(starts[k]), int(starts[k] + taken[k]))
        head = (times[a : a + kept[k]], codes[a : a + kept[k]])
        edited = read_notes([head, (when[s], tails[s])], int(over[k]))
        text = texts[r][: kept[k]] + texts[f][: taken[k]]
        sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        mine = prints[r]
        out.append((int(n[r]), sha, mine.decode(), edited.decode(), likeness(mine, edited), likeness(mine, prints[f])))
    return out


MADE = [
    ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]
RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _columns(made: list[tuple]) -> list[pa.Array]:
    return [pa.array([m[i] for m in made], t) for i, (_, t) in enumerate(MADE)]


def _pieces(batches):
    """(ids, texts) of about GROUP_CHARS, in order."""
    for b in batches:
        ids, texts, low, size = b.column("doc_id"), b.column("text").to_pylist(), 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= GROUP_CHARS:
                yield ids[low : i + 1], texts[low : i + 1]
                low, size = i + 1, 0
        if low < len(texts):
            yield ids[low:], texts[low:]


def _in_order(batches):
    """Results of all rows of a task but the last, whose successor is in another task;
    the first and the last row are passed on as they are (``kind`` 1 and 2)."""
    part = TaskContext.get().partitionId()
    id_last, text_last = None, None

    def rows(kind, ids, texts, made):
        n = len(ids)
        fields = [pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int64()), ids, pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays([*fields, *_columns(made)], ["kind", "part", "doc_id", "text", *[m for m, _ in MADE]])

    for ids, texts in _pieces(batches):
        if text_last is None:
            yield rows(1, ids[:1], texts[:1], [(None,) * len(MADE)])
        else:
            ids, texts = pa.concat_arrays([id_last, ids]), [text_last, *texts]
        at = np.arange(len(texts) - 1)
        if len(at):
            yield rows(0, ids[: len(at)], [None] * len(at), compare_with_next(texts, at, at + 1))
        id_last, text_last = ids[len(ids) - 1 :], texts[-1]
    if text_last is not None:
        yield rows(2, id_last, [text_last], [(None,) * len(MADE)])


def _pairs(batches):
    for b in batches:
        texts = [*b.column("text").to_pylist(), *b.column("next_text").to_pylist()]
        at = np.arange(b.num_rows)
        made = compare_with_next(texts, at, at + b.num_rows) if len(at) else []
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_columns(made)], ["doc_id", *[m for m, _ in MADE]])


def edit_digest(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``RESULT``: each text's fingerprint, that of the text with its last
    half replaced by the next document's beginning, and how alike they are."""
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = text_or_empty()
    order = [F.desc_nulls_last("doc_id"), F.asc("h")]
    ordered = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h")).repartitionByRange(*order).sortWithinPartitions(*order)
    made = materialize(ordered.drop("h").mapInArrow(_in_order, f"kind int, part long, doc_id {kind}, text string, {RESULT}"))

    # the last row of a task is followed by the first of the next task that has rows
    ends = made.where("kind > 0").select("kind", "part", "doc_id", "text")
    tasks = ends.where("kind = 1").select("part", "doc_id", F.xxhash64("text").alias("h"))  # a row for each task
    line = Window.orderBy(*order)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = tasks.select("part", F.coalesce(F.lead("part").over(line), F.first("part").over(whole)).alias("next_part"))
    firsts = ends.where("kind = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    pairs = ends.where("kind = 2").join(bounded_broadcast(follow), "part").join(firsts, "next_part")
    seams = pairs.select("doc_id", "text", "next_text").mapInArrow(_pairs, f"doc_id {kind}, {RESULT}")
    names = ["doc_id", *[m for m, _ in MADE]]
    return made.where("kind = 0").select(*names).unionByName(seams)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of each row; nothing is shuffled."""
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for ids, texts in _pieces(batches):
            prints, _ = fingerprints_of(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array([p.decode() for p in prints], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def _band_places() -> np.ndarray:
    """Digits of each band, as places in the last three octaves up to a full one."""
    rng = np.random.default_rng(77)
    octave = rng.choice(3, (BANDS, ROWS), p=[1 / 7, 2 / 7, 4 / 7])
    return octave * SAMPLES + rng.integers(0, SAMPLES, (BANDS, ROWS))


_PLACES = _band_places()


def band_keys(prints: DataFrame) -> DataFrame:
    """``node, band, key``: bit-sampled keys of each fingerprint.

    Samples come from three octaves ending at the last or the last but one, so texts
    whose lengths lie on both sides of an octave's end have keys in common. Samples after
    a text's end give no key.
    """
    start = F.length("fingerprint") - 3 * SAMPLES
    keys = []
    for back in (0, SAMPLES):
        for b, places in enumerate(_PLACES):
            # places before the first octave are empty strings
            digits = F.concat(*[F.when(start - back + int(p) >= 0, F.substr("fingerprint", start - back + int(p) + 1, F.lit(1))).otherwise("") for p in places])
            full = (F.length("fingerprint") > back) & (F.length(digits) > 0) & ~F.contains(digits, F.lit("."))
            keys.append(F.when(full, F.struct(F.lit(b).alias("band"), F.xxhash64(F.length("fingerprint") - back, F.lit(b), digits).alias("key"))))
    return prints.select("node", F.explode(F.array_compact(F.array(*keys))).alias("k")).select("node", "k.key")


@F.udf(T.DoubleType(), useArrow=True)
def _likeness(a: str, b: str) -> float:
    return likeness(a.encode(), b.encode())


def near_classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``doc_id, class_id``: the smallest id reachable by links of fingerprints whose
    likeness is ``least`` or more; null where a class has no id.

    Equal fingerprints are one node. In each bucket of a key, all nodes are held against
    the smallest one; those it does not take are held against the smallest of their
    rest, until none is left. So a bucket costs its members times its kinds of text, and
    what is found are links to a few nodes, not pairs.
    """
    prints = materialize(fingerprints(docs))
    nodes = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("label"))).where("label is not null")
    nodes = nodes.withColumn("node", F.col("label"))
    left = materialize(band_keys(nodes).distinct())
    links = None
    while True:
        heads = left.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
        pairs = left.join(heads.drop("n"), "key").where("node <> head")
        print_of = nodes.select("node", "fingerprint")
        tried = pairs.select("node", "head").distinct().join(print_of, "node").join(
            print_of.select(F.col("node").alias("head"), F.col("fingerprint").alias("other")), "head"
        )
        tried = materialize(tried.select("node", "head", (_likeness("fingerprint", "other") >= least).alias("alike")))
        if tried.limit(1).count() == 0:
            break
        found = tried.where("alike").select(F.col("node").alias("a"), F.col("head").alias("b"))
        links = found if links is None else links.unionByName(found)
        left = materialize(pairs.join(tried.where("not alike"), ["node", "head"]).select("key", "node"))
    if links is None:
        classes = nodes.select("fingerprint", F.col("label").alias("class_id"))
    else:
        roots = components(links)
        classes = nodes.join(roots, "node", "left").select("fingerprint", F.coalesce("root", "label").alias("class_id"))
    return prints.join(classes, "fingerprint", "left").select("doc_id", "class_id")


@query("op13_document_fingerprints")
def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_digest(table(spark, sf_dir, "documents"))
