from lexivane.llm import licenses

KIND = "doc_id long, path string, text string"


def scan(spark, rows):
    return {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, KIND)).collect()}


def test_headers_licence_files_and_the_nearest_directory(spark):
    code = "code words here\n" * 80
    rows = [
        (1, "a/LICENSE", "MIT License\n\nReleased under the MIT License, Copyright 2020\n" + code),
        (2, "a/x.py", code),
        (3, "a/b/c/y.py", code),
        (4, "a/b/COPYING", "Licensed under the Apache License, Version 2.0 (the License)"),
        (5, "a/b/z.py", "# SPDX header: licensed under the GNU General Public License version 3\n" + code),
        (6, "other/q.py", code),
        (7, "a/b2/q.py", None),
        (8, "top.py", "the licence of this unlikely gadget is void of sense"),
        (9, "a/b/w.py", "Licensed under CC BY-NC 4.0.\n" + code),
        (10, "a/b/v.py", "Licensed under CC BY 4.0.\n" + code),
    ]
    got = scan(spark, rows)
    want = {
        1: ("MIT", "licence file", None), 2: ("MIT", "inherited", "a"), 3: ("Apache-2.0", "inherited", "a/b"), 4: ("Apache-2.0", "licence file", None),
        5: ("GPL-3.0", "header", None), 6: (None, "none", None), 7: ("MIT", "inherited", "a"), 8: (None, "none", None),
        9: ("CC-BY-NC-4.0", "header", None), 10: ("CC-BY-4.0", "header", None),
    }
    assert {k: (r["license"], r["origin"], r["from_dir"]) for k, r in got.items()} == want


def test_nulls_repeats_ties_long_texts_and_empty_tables(spark):
    rows = [(None, None, None), (1, "d/LICENSE", "MIT License"), (1, "d/LICENSE", "MIT License"), (2, "d/COPYING", "Apache License, Version 2.0"), (3, "d/f", "x\n" * 200_000)]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as rid", "'n' as notice", "2 as n", "'l' as license")
    got = sorted((r["doc_id"] or 0, r["license"], r["origin"]) for r in licenses.scan_licenses(df).collect())
    assert got == [(0, None, "none"), (1, "MIT", "licence file"), (1, "MIT", "licence file"), (2, "Apache-2.0", "licence file"), (3, "MIT", "inherited")]
    assert licenses.scan_licenses(spark.createDataFrame([], KIND)).count() == 0
