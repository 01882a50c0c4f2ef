import random
import re
from collections import Counter

from lexivane.llm import quality

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = W.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if W.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def texts():
    rng = random.Random(5)
    out = [None, "", " \n\t", "a", "a a a", "a a a a", "a b c a b c", "x y z w " * 60, "é 🙂 ß\n" * 30, "a b c\x1cd", "the of and " * 40_000]
    for _ in range(80):
        n = rng.choice([3, 40, 60, 300])
        out.append("".join(rng.choice(["the", "of", "and", "x", "yy", "z#", "<|"]) + rng.choice([" ", "\n", "  ", "\r\n", "\x0b"]) for _ in range(n)))
    return out


def test_counts_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        want = brute(rows[r["doc_id"]][1])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, rows[r["doc_id"]][1][:80]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_each_rule_rejects_what_it_names(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    clean = " ".join(word() if i % 4 else rng.choice(["the", "of", "and"]) for i in range(120))
    cases = {
        "clean": (clean, True), "symbols": (clean.replace(" ", "### ", 60), False), "no stop words": (" ".join(word() for _ in range(120)), False),
        "long words": (" ".join("the" if i % 9 == 0 else word() * 5 for i in range(120)), False), "short": (" ".join(clean.split()[:49]), False),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases.values())], "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(df).collect()}
    assert {k: got[i] for i, k in enumerate(cases)} == {k: v for k, (_, v) in cases.items()}


def test_the_table_of_thresholds_is_the_plan(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string").selectExpr("*", "7 as n_words", "'k' as kept", "1 as w")
    got = quality.judge(df, (("n_words", 2, None),)).first()
    assert got["kept"] is True and got["n_words"] == 2
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_of_any_name_pass(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").selectExpr("*", "7 as counts", "8 as COUNTS_", "9 as n_words_", "'x' as base")
    got = quality.judge(df)
    assert set(df.columns) <= set(got.columns) and got.where("counts = 7 and COUNTS_ = 8").count() == 2
    kept = quality.kept_rows(df.withColumn("kept", df.counts), (("n_words", 2, None),))
    assert [r.asDict() for r in kept.collect()] == [{"doc_id": 1, "text": "a b", "counts": 7, "COUNTS_": 8, "n_words_": 9, "base": "x", "kept": 7}]
