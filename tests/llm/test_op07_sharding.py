import zlib
from collections import Counter, defaultdict

from lexivane.llm import sharding


def placed(spark, rows, n=8, extra=""):
    df = spark.createDataFrame(rows, "doc_id long, text string" + extra)
    return sharding.shard_digest(df, n).collect()


def loads(rows):
    out = Counter()
    for r in rows:
        out[r["shard"]] += r["size"]
    return out


def slots_are_gapless(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    return all(sorted(x) == list(range(len(x))) for x in by.values())


def test_bytes_are_near_equal_and_equal_texts_stay_together(spark):
    rows = [(i, f"text {i // 3} " * (1 + i % 40)) for i in range(6000)]
    got = placed(spark, rows)
    load = loads(got)
    assert set(load) == set(range(8)) and max(load.values()) < 1.05 * min(load.values())
    assert slots_are_gapless(got) and len(got) == 6000
    shards = defaultdict(set)
    for r in got:
        shards[r["text_crc32"]].add(r["shard"])
    assert all(len(x) == 1 for x in shards.values())
    want = {i: (len(t) + 1, zlib.crc32(t.encode())) for i, t in rows}
    assert all(want[r["doc_id"]] == (r["size"], r["text_crc32"]) for r in got)


def test_a_third_of_all_rows_with_one_text_is_subdivided(spark):
    rows = [(i, "the same text again" if i % 3 == 0 else f"another text {i}") for i in range(9000)]
    got = placed(spark, rows)
    load = loads(got)
    assert len(load) == 8 and max(load.values()) < 1.1 * min(load.values()) and slots_are_gapless(got)


def test_nulls_ties_repeats_and_an_empty_table(spark):
    got = placed(spark, [(1, None), (1, None), (None, ""), (2, "é"), (2, "é")])
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == [
        (0, 1, 0), (1, 1, 0), (1, 1, 0), (2, 3, zlib.crc32("é".encode())), (2, 3, zlib.crc32("é".encode()))
    ]
    assert slots_are_gapless(got) and {r["law"] for r in got} == {"bytes"}
    assert placed(spark, []) == []


def test_a_very_long_text_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x" * 2_000_000, 9, "a"), (2, "y", 8, "b")], "doc_id long, text string, shard int, size string")
    rows = sharding.shard_rows(df, 2)
    assert rows.columns == ["doc_id", "text", "size", "shard", "slot"]
    assert {r["size"] for r in rows.collect()} == {"a", "b"}


def test_reruns_agree(spark):
    rows = [(i, f"t{i % 50}") for i in range(500)]
    assert sorted(map(tuple, placed(spark, rows)), key=repr) == sorted(map(tuple, placed(spark, rows)), key=repr)
