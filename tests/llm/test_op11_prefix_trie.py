import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lexivane.llm import prefix_trie as P

KIND = "conv_id long, turn long, role string, text string"


def ordered(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            by[c].append(((turn is not None, turn or 0, key), (role, text)))
    return {c: [x for _, x in sorted(t, key=lambda x: x[0])] for c, t in by.items()}


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        own = (len(members[p]) - 1) * (len(p[-1][1].split()) if p else 0)
        got = [below(k) for k in kids[p]]
        return sum(x for x, _ in got) or 1, own + sum(y for _, y in got)

    out = set()
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(p))
        leaves, saved = below(p)
        up = min(members[p[:-1]]) if p else None
        out.add((min(cs), len(p), up, len(cs), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed, n=120):
    rng, rows = random.Random(seed), []
    for c in range(n):
        text = [rng.choice("ab") for _ in range(rng.randrange(0, 9))]
        if c % 3 == 0:  # a third of all are one conversation
            text = list("abababab")
        for i, t in enumerate(text):
            rows.append((c, i, rng.choice(["user", None]) if c % 7 == 0 else "user", f"{t} word {t}" if t == "a" else t))
    rows += [(500, None, None, None), (500, 3, "user", "x"), (500, 3, "user", "x"), (501, 1, "user", "long " * 50_000), (None, 1, "user", "x"), (-3, 0, "u", "")]
    return rows


def as_set(df):
    return {tuple(r) for r in df.select(*[c.split()[0] for c in P.NODES.split(", ")]).collect()}


@pytest.mark.parametrize("tile, width", [(16_384, 1 << 25), (5, 1 << 25), (5, P.PAGE)])
def test_nodes_equal_brute_force(spark, monkeypatch, tile, width):
    """Small tiles cut conversations; the sketch decides nothing."""
    monkeypatch.setattr("lexivane.llm.common.TILE_ROWS", tile)
    monkeypatch.setattr(P, "WIDTH", width)
    rows = conversations(tile)
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as depth", "'x' as words").repartition(3)
    assert as_set(P.prefix_trie(df)) == brute(ordered(rows))


def test_grafted_turns(spark):
    rows = conversations(7) + [(1020, i, "user", t) for i, t in enumerate("pq")] + [(c, i, "user", t) for c in range(1021, 1040) for i, t in enumerate("vwxyz"[: c % 6])]
    own = ordered(rows)
    cut = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    # a remainder takes the sign of the id, as in SQL
    base = {c: c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20)) for c in own}
    want = {c: own.get(base[c], [])[: cut[c]] + t[cut[c] :] for c, t in own.items()}
    turns, convs = P.grafted(P.ordered_turns(spark.createDataFrame(rows, KIND)))
    assert as_set(P.trie_nodes(turns, convs)) == brute(want)


def test_a_full_sketch_shuffles_more_and_changes_nothing(spark, monkeypatch):
    rows = [(c, d, "user", f"{c} {d}" if d else "same") for c in range(3000) for d in range(4)]
    df = spark.createDataFrame(rows, KIND)
    ordered_rows = P.ordered_turns(df)
    convs = ordered_rows.groupBy("conv_id").agg({"pos": "max"}).toDF("conv_id", "n")
    rows_of = P.prefixes(ordered_rows, convs)
    wide = P.screened(rows_of, 12_000).where("alone").count()
    assert 0.8 * 9000 < wide <= 9000
    monkeypatch.setattr(P, "WIDTH", P.PAGE)
    monkeypatch.setattr(P, "CELLS", 0)
    assert P.screened(rows_of, 12_000).where("alone").count() < wide
    assert P.screened(rows_of, 12_000).where("alone and depth = 1").count() == 0


def test_texts_of_nodes_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi")], KIND)
    got = P.node_turns(P.prefix_trie(df), df).orderBy("conv_id", "depth").collect()
    assert [(r["conv_id"], r["depth"], r["role"], r["text"]) for r in got] == [(1, 0, None, None), (1, 1, "user", "hi"), (1, 2, "bot", "yo")]
    assert P.prefix_trie(df.limit(0)).count() == 0
    turns, convs = P.grafted(P.ordered_turns(df.limit(0)))
    assert P.trie_nodes(turns, convs).count() == 0
