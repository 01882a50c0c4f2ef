"""Connected components by alternating stars, as joins and minima of edges.

Each step is a grouped minimum, combined before its shuffle, and a join back; a hub
with most of the edges is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(low, "a")
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of each node with an edge (a, b) to another node; the root is
    the least node reachable. Loops and repeated edges do no harm."""
    now, before = materialize(edges.select("a", "b").where("a <> b").distinct()), None
    while True:
        now = materialize(_small_star(_large_star(now)).distinct())
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return ends.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
