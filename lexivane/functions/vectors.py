"""Vector expressions over ``ARRAY<FLOAT|DOUBLE>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexivane.config import DEFAULTS
from lexivane.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit length; the zero vector stays zero."""
    return let(
        norm(v),
        lambda n: F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(
            F.transform(v, lambda x: x.cast("double") / n)
        ),
    )


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def zero_fallback(v: Column, dim: int) -> Column:
    """A failed embedding (NULL, or of the wrong size) becomes the zero vector."""
    return let(v, lambda x: F.when(F.size(x) == dim, x).otherwise(zeros(dim)))


def truncate_tokens(tokens: Column, max_tokens: int = DEFAULTS.max_tokens) -> Column:
    return F.slice(tokens, 1, max_tokens)
