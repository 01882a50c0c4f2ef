import hashlib
import random

import numpy as np
import pytest

from lexivane.llm import edit_embedding as E

KIND = "doc_id long, text string"


def notes(text):
    t, out = 0, []
    for c in E.char_classes(text).tolist():
        stay = int(E.STRIDES[(c << 12) | (t & 4095)])
        out += [c] * stay
        t += stay
    return out


def brute(text):
    held, out, o = notes(text), [], 0
    while held and E.octave_start(o) < len(held):
        for k, j in enumerate(E.TIMES[o]):
            out.append("." if j >= len(held) else "0123456789abcdef"[E.DIGITS[o * E.SAMPLES + k, held[j]]])
        o += 1
    return "".join(out)


def texts(seed=1):
    rng = random.Random(seed)
    some = ["", "a", "ab\n", "é🙂x", "x" * 5000, None]
    some += ["".join(rng.choice("abcdefgh ij\n") for _ in range(rng.choice([3, 15, 16, 30, 33, 200, 3000]))) for _ in range(150)]
    return some + some[10:60]  # repeated texts


@pytest.mark.parametrize("few, group", [(96, 1 << 22), (0, 5000), (100_000, 10)])
def test_digest_equals_brute_force(spark, monkeypatch, few, group):
    monkeypatch.setattr(E, "FEW", few)
    monkeypatch.setattr(E, "GROUP_CHARS", group)
    held = [t or "" for t in texts()]
    prints, _ = E.fingerprints_of(held)
    assert [p.decode() for p in prints] == [brute(t) for t in held]
    df = spark.createDataFrame(list(enumerate(texts())), KIND).selectExpr("*", "1 as part", "'x' as kind", "2 as h").repartition(7)
    got = {r["doc_id"]: r for r in E.edit_digest(df).collect()}
    assert len(got) == len(held)
    order = sorted(range(len(held)), reverse=True)
    for k, d in enumerate(order):
        text, after = held[d], held[order[(k + 1) % len(order)]]
        half = len(text) // 2
        edited, r = text[: len(text) - half] + after[:half], got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (brute(text), brute(edited))
        assert r["near_edited"] == pytest.approx(E.likeness(brute(text).encode(), brute(edited).encode()))
        assert r["near_next"] == pytest.approx(E.likeness(brute(text).encode(), brute(after).encode()))


def test_likeness_follows_edits():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    few, many, other = [], [], []
    for _ in range(30):
        t = " ".join(word() for _ in range(300))
        prints = []
        for n in (1, 60):
            s = list(t)
            for _ in range(n):
                at = rng.randrange(len(s))
                s[at : at + 1] = rng.choice([[], ["z"], [s[at], "z"]])
            prints.append("".join(s))
        (a, b, c, d), _ = E.fingerprints_of([t, *prints, " ".join(word() for _ in range(300))])
        few.append(E.likeness(a, b)), many.append(E.likeness(a, c)), other.append(E.likeness(a, d))
        assert E.likeness(a, a) == 1.0
    assert np.mean(few) > 0.9 > np.mean(many) > np.mean(other) + 0.1 and np.mean(other) < 0.25
    assert E.likeness(b"", b"") == 1.0 and E.likeness(b"", a) == 0.0


def test_nulls_ties_and_empty_tables(spark):
    rows = [(None, "n"), (1, "same"), (1, "same"), (1, None), (2, "word " * 200_000)]
    got = E.edit_digest(spark.createDataFrame(rows, KIND)).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 1, 4, 4, 1_000_000]
    assert len({r["fingerprint"] for r in got if r["n_chars"] == 4}) == 1
    alone = E.edit_digest(spark.createDataFrame([(7, "abcd")], KIND)).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and alone["near_next"] == 1.0
    assert E.edit_digest(spark.createDataFrame([], KIND)).count() == 0
    assert E.near_classes(spark.createDataFrame([], KIND)).count() == 0


def test_classes_hold_edited_copies_together(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, family = [], {}
    for f in range(12):
        base = [word() for _ in range(rng.randrange(60, 400))]
        for _ in range(20 if f == 0 else 3):
            copy = list(base)
            copy[rng.randrange(len(copy))] = word()
            family[len(rows)] = f
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, rows[0][1]) for i in range(30)] + [(None, "a b"), (None, None)]
    got = {r["doc_id"]: r["class_id"] for r in E.near_classes(spark.createDataFrame(rows, KIND)).collect()}
    prints = {i: E.fingerprints_of([t or ""])[0][0] for i, t in rows if i in family}
    near = [(a, b) for a in family for b in family if a < b and E.likeness(prints[a], prints[b]) >= E.LEAST]
    assert sum(got[a] == got[b] for a, b in near) >= 0.9 * len(near) > 50
    assert all(family[a] == family[c] for a, c in got.items() if a in family)
    assert got[None] is None and all(got[i] == got[0] for i, _ in rows[len(family) : len(family) + 30])
