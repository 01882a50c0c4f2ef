"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

# rows of one tile: what a window orders in one task, whatever the size of the table
TILE_ROWS = 16_384


def query(name: str, sql: str | None = None):
    """Registers ``f(spark, sf_dir)`` and, if there is one, the SQL that checks it."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_list(text: Column) -> Column:
    """The words of a text, as an array without empty entries."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def fresh(df: DataFrame, name: str) -> str:
    """A name for an internal column that ``df`` does not have (names are not case sensitive)."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def tiles(rows: int, groups: int = 1) -> int:
    """Tiles for each of ``groups`` groups, so that a tile stays near TILE_ROWS."""
    return max(1, -(-rows // (TILE_ROWS * groups)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: lambdas over an expression would
    compute it again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)
