"""Compares registered queries with their SQL: python tests/oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else (None if math.isnan(v) else round(v, 9))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return len(got[1]) > 0, f"rows {len(got[1])} (no SQL)", t1 - t0, 0.0
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    if got == want:
        return True, f"rows {len(got[1])}", t1 - t0, t2 - t1
    a, b = set(map(repr, got[1])), set(map(repr, want[1]))
    detail = f"columns {got[0]} vs {want[0]}; rows {len(got[1])} vs {len(want[1])}"
    only = lambda s: " | ".join(x[:300] for x in sorted(s)[:2])
    return False, f"{detail}\n   spark only ({len(a - b)}): {only(a - b)}\n   sql only ({len(b - a)}): {only(b - a)}", t1 - t0, t2 - t1


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def main():
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, con, bad = session(), connect(sf), []
    for name in names:
        try:
            ok, text, a, b = compare(spark, con, sf, name, entry.queries()[name], entry.oracle_sql().get(name))
        except Exception as e:  # noqa: BLE001
            ok, text, a, b = False, f"{type(e).__name__}: {str(e)[:600]}", 0.0, 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {name} spark {a:.1f}s sql {b:.1f}s {text}", flush=True)
        bad += [] if ok else [name]
    print(f"{len(names) - len(bad)} of {len(names)} agree; not: {bad}")


if __name__ == "__main__":
    main()
