"""Chunking: hand-worked cases, and a plain fold over random documents."""

import random

from pyspark.sql import functions as F

from lexivane.operators import chunking as C

SAMPLE = """# Start

Some words here.

## First part

A first part with words. It has more than one sentence. Each is short.

### Inner part

Words below the inner heading. They go on a little.

## Second part

Other words."""


def chunks_of(spark, text, size=500, overlap=50, url="https://e.org/t", **options):
    df = spark.createDataFrame([("k", url, "T", text)], "doc_key string, url string, title string, content string")
    return C.chunk_documents(df, size, overlap, **options).orderBy("chunk_seq").collect()


def test_one_chunk_per_heading(spark):
    rows = chunks_of(spark, SAMPLE, 100, 20)
    assert [r["heading_path"] for r in rows] == [
        "Start", "Start > First part", "Start > First part > Inner part", "Start > Second part",
    ]
    assert [r["anchor_link"].split("#")[1] for r in rows] == ["start", "first-part", "inner-part", "second-part"]
    assert [(r["prev_id"], r["next_id"]) for r in rows] == [
        (None, "k:2"), ("k:1", "k:3"), ("k:2", "k:4"), ("k:3", None),
    ]
    assert all(r["token_count"] == len(r["content"]) // 4 for r in rows)


def test_skipped_levels_collapse(spark):
    rows = chunks_of(spark, "# A\n### B\n### C\n## D")
    assert [r["heading_path"] for r in rows] == ["A", "A > B", "A > B > C", "A > D"]


def test_text_before_headings_and_fences(spark):
    text = "intro\n# A\n```\n# note\n```\n####### seven"
    rows = chunks_of(spark, text, url="u#f")
    assert [(r["heading_path"], r["anchor_link"]) for r in rows] == [
        ("Introduction", "u#f"), ("A", "u#a"), ("note", "u#note"),
    ]
    fenced = chunks_of(spark, text, track_fences=True)
    assert [r["heading_path"] for r in fenced] == ["Introduction", "A"]


def spans(spark, tokens, size, overlap):
    row = spark.createDataFrame([(tokens,)], "tk array<int>")
    out = row.select(C.pack_spans(F.col("tk"), size, overlap).alias("s")).first()["s"]
    return [tuple(s) for s in out]


def test_packing(spark):
    assert spans(spark, [3, 4, 5, 2], 7, 4) == [(1, 2, 7), (2, 3, 9), (4, 4, 2)]
    assert spans(spark, [0, 600, 10], 500, 50) == [(1, 1, 0), (1, 2, 600), (3, 3, 10)]


def greedy(tokens, size, overlap):
    """The packing rule, one sentence at a time."""
    out, cur, total = [], [], 0
    for i, t in enumerate(tokens, 1):
        if cur and total + t > size:
            out.append((cur[0], cur[-1], total))
            kept, s = [], 0
            for j in reversed(cur):
                if s + tokens[j - 1] > overlap:
                    break
                kept.insert(0, j)
                s += tokens[j - 1]
            cur, total = kept + [i], s + t
        else:
            cur.append(i)
            total += t
    return out + [(cur[0], cur[-1], total)]


def test_packing_equals_a_plain_fold(spark):
    rng = random.Random(7)
    cases = []
    for _ in range(200):
        n = rng.randint(1, 60)
        cases.append(([rng.choice([0, 0, 1, 3, 9, 20, 60, 120]) for _ in range(n)], rng.choice([10, 50, 100]), rng.choice([0, 5, 30])))
    for size in (10, 50, 100):
        for overlap in (0, 5, 30):
            mine = [c[0] for c in cases if c[1:] == (size, overlap)]
            if not mine:
                continue
            df = spark.createDataFrame([(i, t) for i, t in enumerate(mine)], "i int, tk array<int>")
            got = df.select("i", C.pack_spans(F.col("tk"), size, overlap).alias("s")).orderBy("i").collect()
            for row, tokens in zip(got, mine):
                assert [tuple(s) for s in row["s"]] == greedy(tokens, size, overlap)


def test_sentences(spark):
    def of(t):
        return spark.createDataFrame([(t,)], ["t"]).select(C.sentences(F.col("t")).alias("s")).first()["s"]

    assert of("One. Two! three? four") == ["One.", "Two!", "three?", "four"]
    assert of("- a. b.") == ["- a. b."]
    assert of("3.14 is pi.") == ["3.14 is pi."]
    assert of("a.\n\n  b. c") == ["a.", "b.", "c"]


def test_every_sentence_is_kept_and_size_holds(spark):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefgh ") for _ in range(rng.randint(5, 90))).strip() + "." for _ in range(300))
    df = spark.createDataFrame([("k", "u", "t", text)], "doc_key string, url string, title string, content string")
    listed = df.select(C.sentences(F.col("content")).alias("s")).first()["s"]
    rows = C.chunk_documents(df, 80, 15).collect()
    assert all(any(s in r["content"] for r in rows) for s in listed)
    longest = max(len(s) // 4 for s in listed)
    assert all(r["token_count"] <= max(80, 15 + longest) for r in rows)
