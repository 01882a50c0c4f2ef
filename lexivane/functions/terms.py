"""Full-text terms: tokens, folding, stems and query parsing."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.functions.porter import porter_stem
from lexivane.session import ship_package


def _folds() -> tuple[str, str]:
    """Latin letters that carry exactly one mark, and their bare letters."""
    marked, bare = [], []
    for code in (*range(0x00E0, 0x0250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and parts[0].isascii() and parts[0].islower():
            marked.append(chr(code))
            bare.append(parts[0])
    return "".join(marked), "".join(bare)


FOLD_FROM, FOLD_TO = _folds()
TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def tokens(c: Column, fold: bool = True) -> Column:
    """Letter and digit runs in lower case, marks folded away."""
    low = F.lower(c)
    if fold:
        low = F.translate(low, FOLD_FROM, FOLD_TO)
    return F.regexp_extract_all(low, F.lit(TOKEN_PATTERN), F.lit(0))


@lru_cache(maxsize=1 << 18)
def _stem(word: str) -> str:
    return porter_stem(word)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda ts: None if ts is None else [_stem(t) for t in ts])


def stemmed(tokens: Column) -> Column:
    """Porter stems of an array of tokens."""
    ship_package(SparkSession.getActiveSession())
    return _stems(tokens)


def with_stems(terms: DataFrame) -> DataFrame:
    """``term`` rows with their ``stem``. Meant for distinct terms: a dictionary, not texts."""
    ship_package(terms.sparkSession)
    return terms.withColumn("stem", _stems(F.array("term"))[0])


def query_terms(q: Column) -> Column:
    """The terms of a question, all of them required.

    Each is ``struct(raw, parts, is_prefix)``. Terms of three or more characters
    match as prefixes. ``_`` and ``-`` separate words, so such a term is a
    phrase of ``parts`` of which the last one carries the prefix mark.
    """
    spaced = F.regexp_replace(F.lower(q), r"(?U)[^\w\s-]", " ")
    kept = F.transform(
        F.split(spaced, r"(?U)\s+"), lambda t: F.regexp_replace(t, "[^a-z0-9_-]", "")
    )
    return F.transform(
        F.filter(kept, lambda t: t != ""),
        lambda t: F.struct(
            t.alias("raw"),
            F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0)).alias("parts"),
            (F.length(t) >= 3).alias("is_prefix"),
        ),
    )
