"""Embeddings: feature hashing inside the JVM, and a slot for a real model."""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.config import DEFAULTS, DOCUMENT_PREFIX, QUERY_PREFIX
from lexivane.functions.terms import tokens
from lexivane.functions.text import let
from lexivane.functions.vectors import l2_normalize, truncate_tokens, zero_fallback, zeros
from lexivane.session import bounded_broadcast, materialize, ship_package


def task_prefix(c: Column, kind: str) -> Column:
    return F.concat(F.lit({"query": QUERY_PREFIX, "document": DOCUMENT_PREFIX}[kind]), c)


def token_slot(token: Column, dim: int) -> Column:
    """Signed feature of a token: ``2 * dimension`` plus 1 where the sign is
    negative, from the first eight hex digits of its MD5."""
    h = F.conv(F.left(F.md5(token), F.lit(8)), 16, 10).cast("bigint")
    return ((h % dim) * 2 + F.floor(h / dim) % 2).cast("int")


def hash_vector(text: Column, dim: int = DEFAULTS.embedding_dim, max_tokens: int = DEFAULTS.max_tokens) -> Column:
    """Mean of the signed unit features of the first tokens, at unit length
    (Weinberger et al. 2009). A text without tokens gives the zero vector."""

    def runs(s: Column, starts: Column) -> Column:
        """How often each slot occurs, as a map: lengths of runs in sorted order."""
        ends = lambda j: F.coalesce(F.get(starts, j + 1), F.size(s))
        return F.map_from_entries(
            F.transform(starts, lambda b, j: F.struct(F.get(s, b), ends(j) - b))
        )

    def counted(s: Column) -> Column:
        first = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))
        )
        return let(let(first, lambda starts: runs(s, starts)), lambda m: dense(m, F.size(s)))

    def dense(m: Column, n: Column) -> Column:
        times = lambda slot: F.coalesce(F.try_element_at(m, slot), F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: (times(d * 2) - times(d * 2 + 1)) / n
        )

    kept = truncate_tokens(tokens(text, fold=False), max_tokens)
    slots = F.sort_array(F.transform(kept, lambda t: token_slot(t, dim)))
    return let(
        slots,
        lambda s: F.when(F.size(s) == 0, zeros(dim)).otherwise(let(counted(s), l2_normalize)),
    )


def embed_hash(
    df: DataFrame, text_col: str, dim: int = DEFAULTS.embedding_dim, max_tokens: int = DEFAULTS.max_tokens
) -> DataFrame:
    """Adds ``embedding`` and ``embed_ok``; narrow, no Python."""
    vector = hash_vector(F.coalesce(F.col(text_col), F.lit("")), dim, max_tokens)
    return df.withColumn("embedding", vector).withColumn(
        "embed_ok", F.exists("embedding", lambda x: x != 0)
    )


def embed_udf(
    df: DataFrame, text_col: str, model_factory: Callable[[], Callable], dim: int, batch_size: int = 8
) -> DataFrame:
    """Adds ``embedding`` and ``embed_ok`` from a user's model.

    ``model_factory`` runs once per Python worker and returns a function from a
    list of texts to a list of vectors. A batch that fails gives zero vectors.
    """

    ship_package(df.sparkSession)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = model_factory()
        for texts in batches:
            out = []
            for i in range(0, len(texts), batch_size):
                part = texts.iloc[i : i + batch_size].tolist()
                try:
                    vectors = [[float(x) for x in v] for v in model(part)]
                except Exception:
                    vectors = [None] * len(part)
                out.extend(vectors)
            yield pd.Series(out, index=texts.index, dtype=object)

    return df.withColumn("_v", encode(F.col(text_col))).select(
        *df.columns,
        zero_fallback(F.col("_v"), dim).cast("array<float>").alias("embedding"),
        (F.coalesce(F.size("_v"), F.lit(-1)) == dim).alias("embed_ok"),
    )


def embed_dedup(
    df: DataFrame, text_col: str, embed: Callable[[DataFrame], DataFrame], hot: int = 100_000
) -> DataFrame:
    """Encode every distinct text once and hand the vector to all its copies.

    Copies collapse before the shuffle. On the way back, a text with more than
    ``hot`` copies is cut into parts of about that many rows, and its vector is
    repeated for each part, so that no join key is larger.
    """
    keyed = df.withColumn("_h", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    reps = keyed.groupBy("_h").agg(F.min(text_col).alias(text_col))
    copies = keyed.groupBy("_h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot)
    # there are at most rows / hot of these
    large = materialize(copies.select("_h", F.ceil(F.col("n") / hot).cast("int").alias("_parts")))
    side = bounded_broadcast(large)
    part = F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))).cast("int")
    rows = keyed.join(side, "_h", "left").withColumn("_part", part).drop("_parts")
    vectors = embed(reps).drop(text_col).join(side, "_h", "left")
    repeated = vectors.withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    ).drop("_parts")
    return rows.join(repeated, ["_h", "_part"]).drop("_h", "_part")


def mean_pool(df: DataFrame, group: str, vec: str) -> DataFrame:
    """Mean vector of every group, summed per dimension before the shuffle."""
    means = (
        df.select(group, F.posexplode(vec).alias("pos", "x"))  # a plain column
        .groupBy(group, "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    return means.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(vec)
    )
