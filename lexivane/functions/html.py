"""HTML expressions over the raw page."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexivane.functions.markup import RAW, block_markdown, first_subtree, has_class, without_raw, without_subtrees
from lexivane.functions.text import (
    LINE_BREAKS,
    blank_to_null,
    join_nonblank,
    let,
    normalize_markdown,
    stem_to_title,
    strip,
)
from lexivane.functions.urls import url_host, url_path

# The named entities of HTML 4 and "apos"; "amp" is decoded after all others.
ENTITIES = {n: chr(p) for n, p in name2codepoint.items() if n != "amp"} | {"apos": "'"}
BASIC_ENTITIES = ("lt", "gt", "quot", "apos", "nbsp")  # besides "amp"


def _code_point(code: Column) -> Column:
    """Text of a numeric entity: decimal, or hexadecimal after an ``x``."""
    is_hex = F.lower(F.left(code, F.lit(1))) == "x"
    digits = F.when(is_hex, F.substring(code, 2, 16)).otherwise(F.hex(code.try_cast("bigint")))
    return F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")


def decode_named(c: Column, names) -> Column:
    """Entities of these names and "amp" alone."""
    for name in names:
        c = F.replace(c, F.lit(f"&{name};"), F.lit(ENTITIES[name]))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def decode_entities(c: Column) -> Column:
    """Numeric entities and those with a name in HTML 4."""
    codes = F.array_distinct(F.regexp_extract_all(c, F.lit(r"&#([xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});"), F.lit(1)))
    c = F.when(
        F.contains(c, F.lit("&#")),
        F.aggregate(
            codes,
            c,
            lambda acc, n: F.replace(acc, F.concat(F.lit("&#"), n, F.lit(";")), _code_point(n)),
        ),
    ).otherwise(c)
    # only the names that the page uses are replaced
    table = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    names = F.array_distinct(F.regexp_extract_all(c, F.lit(r"&([A-Za-z][A-Za-z0-9]*);"), F.lit(1)))
    named = F.aggregate(
        names, c, lambda acc, n: F.coalesce(F.replace(acc, F.concat(F.lit("&"), n, F.lit(";")), F.element_at(table, n)), acc)
    )
    c = F.when(c.rlike("&[A-Za-z]"), named).otherwise(c)
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


# fixed values: the patterns of the conversion and their order decide the result
MARKDOWN_STEPS = (
    (r"(?s)<h1[^>]*>(.*?)</h1>", "# $1"),
    (r"(?s)<h2[^>]*>(.*?)</h2>", "## $1"),
    (r"(?s)<h3[^>]*>(.*?)</h3>", "### $1"),
    (r"(?s)<h4[^>]*>(.*?)</h4>", "#### $1"),
    (r"(?s)<pre[^>]*><code[^>]*>(.*?)</code></pre>", "```\n$1\n```"),
    (r"(?d)<code[^>]*>(.*?)</code>", "`$1`"),
    (r"<ul[^>]*>|</ul>|<ol[^>]*>|</ol>", ""),
    (r"(?s)<li[^>]*>(.*?)</li>", "- $1"),
    (r"(?s)<p[^>]*>(.*?)</p>", "$1\n\n"),
    (r"<[^>]+>", ""),
    (r"(?U)\n\s*\n\s*\n", "\n\n"),
)


def html_to_markdown(c: Column) -> Column:
    """Headings, code, lists and paragraphs to markdown; other tags dropped.

    Entities are left as they are, and nothing is inserted before a heading.
    """
    for pattern, new in MARKDOWN_STEPS:
        c = F.regexp_replace(c, pattern, new)
    return strip(c)


def strip_boilerplate(c: Column, tags, classes=()) -> Column:
    """Drop comments, then the listed elements and the div/section elements whose class
    holds one of ``classes``, each with all that is in it."""
    c = without_raw(c, tuple(t for t in tags if t in RAW))
    listed = [t for t in tags if t not in RAW]

    def pick(name: Column, token: Column) -> Column:
        return name.isin(*listed) | (name.isin("div", "section") & has_class(token, classes))

    return without_subtrees(c, pick) if listed or classes else c


def page_text(c: Column, entities=None) -> Column:
    """All readable text of a page: no scripts, styles, comments or doctype.
    ``entities``: the only names to be decoded."""
    c = strip_boilerplate(c, ("script", "style"))
    text = F.regexp_replace(c, r"<[^>]+>", "")
    return decode_entities(text) if entities is None else decode_named(text, entities)


def visible_text_flat(c: Column) -> Column:
    """Cleaned page as one line, single spaces between the pieces."""
    text = let(F.regexp_replace(c, r"<[^>]+>", ""), decode_entities)
    return join_nonblank(F.split(text, LINE_BREAKS + "|  "), " ")


def main_region(c: Column, classes=()) -> Column:
    """Inner HTML of the first ``main`` or ``article``, else of the first div of a
    content class, else the whole page."""
    ladder = [F.nullif(first_subtree(c, lambda name, t: name.isin("main", "article")), F.lit(""))]
    if classes:
        ladder.append(F.nullif(first_subtree(c, lambda name, t: (name == "div") & has_class(t, classes)), F.lit("")))
    return F.coalesce(*ladder, c)


def visible_text_lines(c: Column, classes=()) -> Column:
    """Main region of a cleaned page, one line per piece of text."""
    region = let(c, lambda x: main_region(x, classes))
    text = let(F.regexp_replace(region, r"<[^>]+>", "\n"), decode_entities)
    return join_nonblank(F.split(text, "\n"), "\n")


def main_article_markdown(c: Column, base: Column | None = None) -> Column:
    """Markdown of a page's article, lines stripped and blank lines single. Links and
    images are made absolute if ``base``, the page's address, is given."""
    # each step is bound once: the next one uses it more than once
    region = let(without_raw(c), lambda x: main_region(x))
    return let(let(block_markdown(region, base), decode_entities), normalize_markdown)


def element_text(c: Column, pattern: str, group: int) -> Column:
    """Stripped text of the first match; NULL when it is missing or blank."""
    inner = F.regexp_extract(c, pattern, group)
    return blank_to_null(decode_entities(F.regexp_replace(inner, r"<[^>]+>", "")))


_TITLE = (r"(?is)<title[^>]*>(.*?)</title\s*>", 1)
_H1 = (r"(?is)<h1[^>]*>(.*?)</h1\s*>", 1)
_ROLE = (r"(?is)<(\w+)[^>]*\srole=[\"']heading[\"'][^>]*>(.*?)</\1\s*>", 2)


def _classed(name: str) -> tuple[str, int]:
    return (rf"(?is)<(\w+)[^>]*\sclass=[\"'](?:[^\"']*\s)?{name}(?:\s[^\"']*)?[\"'][^>]*>(.*?)</\1\s*>", 2)


def extract_title(html: Column, url: Column, ladder: str = "title") -> Column:
    """Page title by one of three ladders.

    ``title``: title element, last path part, host.
    ``h1``: title element, first h1, last path part, ``Untitled``.
    ``focused``: first non-blank of h1, title, heading role, ``page-title`` and
    ``doc-title`` classes, else the last path part as words, ``Documentation``.
    """
    tail = F.nullif(F.substring_index(url_path(url), "/", -1), F.lit(""))
    if ladder == "title":
        return F.coalesce(element_text(html, *_TITLE), tail, url_host(url))
    if ladder == "h1":
        return F.coalesce(
            element_text(html, *_TITLE), element_text(html, *_H1), tail, F.lit("Untitled")
        )
    if ladder == "focused":
        rungs = (_H1, _TITLE, _ROLE, _classed("page-title"), _classed("doc-title"))
        return F.coalesce(
            *[element_text(html, *r) for r in rungs], stem_to_title(tail), F.lit("Documentation")
        )
    raise ValueError(f"unknown ladder {ladder!r}")
