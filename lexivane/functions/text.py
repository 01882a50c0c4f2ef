"""String expressions. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Everything Python's str.strip() treats as white space.
SPACES = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Inside a lambda an expression used twice would be evaluated twice; a
    one-element ``transform`` binds it to a variable instead.
    """
    return F.transform(F.array(value), body)[0]


def unnest(df: DataFrame, items: Column, *keep, start: int = 1) -> DataFrame:
    """One row per element: ``keep`` columns, ``pos`` (from ``start``) and ``item``.

    The outer form is used and its NULL rows are dropped afterwards. The plain
    form would have the optimizer filter on the array's size first, and so
    compute the whole array expression twice.
    """
    return (
        df.select(*keep, F.posexplode_outer(items).alias("pos", "item"))
        .filter(F.col("pos").isNotNull())
        .withColumn("pos", F.col("pos") + start)
    )


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def token_estimate(c: Column) -> Column:
    """One token per four code points, rounded down."""
    return F.floor(F.length(c) / 4).cast("int")


def slugify(c: Column) -> Column:
    kept = F.regexp_replace(F.lower(c), r"(?U)[^a-zA-Z0-9\s-]", "")
    return F.btrim(F.regexp_replace(kept, r"(?U)[\s-]+", "-"), F.lit("-"))


def anchor(heading: Column) -> Column:
    return F.when(heading == "", F.lit("")).otherwise(F.concat(F.lit("#"), slugify(heading)))


def anchor_link(url: Column, mark: Column) -> Column:
    """``url`` with its fragment replaced by ``mark``; a bare or empty mark
    leaves the page address (an empty one keeps the old fragment)."""
    page = F.substring_index(url, "#", 1)
    return F.when(mark == "", url).when(mark == "#", page).otherwise(F.concat(page, mark))


def normalize_markdown(c: Column) -> Column:
    """Strip every line and keep one blank line of each run of them."""
    lines = F.transform(F.split(c, "\n"), strip)
    return let(
        lines,
        lambda ls: strip(
            F.array_join(
                F.filter(ls, lambda l, i: (l != "") | (i == 0) | (F.get(ls, i - 1) != "")), "\n"
            )
        ),
    )


def join_nonblank(parts: Column, sep: str) -> Column:
    return F.array_join(F.filter(F.transform(parts, strip), lambda p: p != ""), sep)


def stem_to_title(c: Column) -> Column:
    """File or path stem as a heading: ``_`` and ``-`` to spaces, and a capital after
    each character that is no letter."""
    runs = F.regexp_extract_all(F.translate(c, "_-", "  "), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    capital = F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, 2, 1 << 30))))
    return F.array_join(capital, "")


def extract_title_md(content: Column, path: Column) -> Column:
    """Title from the first ten lines of markdown, else from the file name."""
    heads = F.transform(F.slice(F.split(content, "\n"), 1, 10), strip)

    def is_title(l: Column) -> Column:
        # a stripped line cannot be just "# ", so every branch yields text
        return (
            l.startswith("# ")
            | l.startswith("## ")
            | ((l != "") & ~l.startswith("```") & (F.length(l) < 100))
        )

    first = F.get(F.filter(heads, is_title), F.lit(0))
    text = (
        F.when(first.startswith("# "), strip(F.substring(first, 3, 1 << 30)))
        .when(first.startswith("## "), strip(F.substring(first, 4, 1 << 30)))
        .otherwise(first)
    )
    name = F.substring_index(path, "/", -1)
    return F.coalesce(text, stem_to_title(F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")))


def valid_utf8(raw: Column) -> Column:
    """Binary to text, dropping bytes that are not UTF-8.

    Only rows with bad bytes take the repair path. The engine marks those bytes
    with U+FFFD, so marks already in the text are set aside while the new ones
    are removed.
    """
    aside = "\ufdd0\ufdd1\ufdd0"
    text = raw.cast("string")
    marked = F.make_valid_utf8(F.replace(text, F.lit("\ufffd"), F.lit(aside)))
    repaired = F.replace(F.replace(marked, F.lit("\ufffd"), F.lit("")), F.lit(aside), F.lit("\ufffd"))
    return F.when(F.is_valid_utf8(text), text).otherwise(repaired)


# ---- fixed values: patterns of both conversions, whose order decides the result ----
MDX_PARTS = (r"import.*?from.*?;", r"(?s)<[A-Z][^>]*>.*?</[A-Z][^>]*>", r"<[A-Z][^>]*/>", r"\{[^}]*\}")
RST_STEPS = (
    (r"(?d)\.\. [^:]+::.*?\n", ""),
    (r"(?d)\.\. [^:]+:.*?\n", ""),
    (r"(?dmU)^([A-Z][A-Z\s]+)$", "# $1"),
    (r"(?dmU)^([A-Z][a-z\s]+)$", "## $1"),
    (r"(?sU)::\s*\n(.*?)(?=\n\S|\z)", "```\n$1\n```"),
)
# ---- end of fixed values ----


def mdx_to_markdown(c: Column) -> Column:
    """Drop imports, components and brace expressions, in that order."""
    for pattern in MDX_PARTS:
        c = F.regexp_replace(c, pattern, "")
    return strip(c)


def rst_to_markdown(c: Column) -> Column:
    """Directives out, capitalised lines to headings, ``::`` blocks fenced."""
    for pattern, new in RST_STEPS:
        c = F.regexp_replace(c, pattern, new)
    return c
