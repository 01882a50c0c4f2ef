"""Session settings, shared scratch storage and size-checked broadcasts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side must fit both bounds, measured and not estimated.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A folder of our own is made only where none is set, as in local tests; on a
    cluster the setting must name storage that every executor reaches.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        root = sc.getCheckpointDir()
        if root is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        package = os.path.basename(here)
        archive = shutil.make_archive(
            os.path.join(made, package), "zip", root_dir=os.path.dirname(here), base_dir=package
        )
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)


def materialize(df: DataFrame) -> DataFrame:
    """Computes ``df`` once, as a table in shared storage.

    What is read afterwards has no lineage to lose and exact statistics.
    """
    return write_and_read(df, scratch_path(df.sparkSession, "step"))


def materialize_in_turn(parts: Iterable[DataFrame]) -> DataFrame:
    """The rows of all ``parts`` as one stored table, computed one after another: what one
    shuffles is gone before the next begins."""
    path = None
    for df in parts:
        path = path or scratch_path(df.sparkSession, "step")
        with freed_shuffles(df.sparkSession):
            df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_scopes: list[list[str]] = []  # scratch paths made by each running ``settled``


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """Stores what ``build()`` returns, then removes the steps it has stored on the way."""
    result = scratch_path(spark, "step")
    _scopes.append([])
    try:
        return write_and_read(build(), result)
    finally:
        for path in _scopes.pop():
            remove(spark, path)


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs in this block gives back its shuffle files when it ends, not when the
    driver happens to collect its garbage. For plans that are run once, as those of writes."""
    was = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if was is None else spark.conf.set(FREE_SHUFFLES, was)


def remove(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))


def write_and_read(df: DataFrame, path: str, **layout) -> DataFrame:
    """Cut the lineage by writing a table and reading it back."""
    writer = df.write.mode("overwrite")
    if layout.get("partition_by"):
        writer = writer.partitionBy(*layout["partition_by"])
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure ``df``, reading no more than ``max_rows + 1`` rows of it."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    size = (
        df.select(width.alias("w"))
        .limit(max_rows + 1)
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("b"))
        .first()
    )
    return size["n"] <= max_rows and size["b"] <= max_bytes


def bounded_broadcast(df: DataFrame, **bounds) -> DataFrame:
    """Broadcast ``df`` if it measures small; otherwise leave the join to a
    shuffle, where adaptive execution splits skewed partitions."""
    return F.broadcast(df) if fits_broadcast(df, **bounds) else df
