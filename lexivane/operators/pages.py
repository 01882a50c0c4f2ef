"""Pages: choice, quality, links, and what fails on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivane.config import (
    BROAD_BOILERPLATE,
    BROAD_KEYWORDS,
    BROAD_MIN_KEYWORDS,
    FOCUSED_BOILERPLATE,
    FOCUSED_BOILERPLATE_CLASSES,
    FOCUSED_KEYWORDS,
    FOCUSED_MAIN_CLASSES,
    MIN_CONTENT_CHARS,
    MIN_PAGE_CHARS,
)
from lexivane.functions.html import (
    extract_title,
    main_article_markdown,
    page_text,
    strip_boilerplate,
    visible_text_flat,
    visible_text_lines,
)
from lexivane.functions.text import strip, unnest, word_count
from lexivane.functions.urls import normalize_url, url_host, url_join, url_page
from lexivane.session import bounded_broadcast


def seed_select(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pages named in the seed list (``url``), compared in normal form."""
    wanted = seeds.select(normalize_url(F.col("url")).alias("seed")).distinct()
    return pages.join(
        bounded_broadcast(wanted), normalize_url(pages["url"]) == F.col("seed"), "left_semi"
    )


def split_ok_quarantine(docs: DataFrame, stage: str, key: str, content: str):
    """Documents that carry text, and a record of those that do not."""
    text = F.col(content)
    error = F.when(text.isNull(), "missing").when(strip(text) == "", "empty")
    marked = docs.withColumn("_error", error)
    ok = marked.filter(F.col("_error").isNull()).drop("_error")
    bad = marked.filter(F.col("_error").isNotNull()).select(
        F.col(key).cast("string").alias("doc_key"),
        F.lit(stage).alias("stage"),
        F.col("_error").alias("error"),
    )
    return ok, bad


def _keyword_count(low: Column, keywords) -> Column:
    total = F.lit(0)
    for word in keywords:
        total = total + F.contains(low, F.lit(word)).cast("int")
    return total


def page_quality(pages: DataFrame, mode: str, entities=None) -> DataFrame:
    """Adds ``is_doc``, judged on the page before anything is removed from it. Its length
    is that of the decoded text; ``entities`` names the only ones to be decoded."""
    text = page_text(F.col("html"), entities)
    with_text = pages.withColumn("_text", text).withColumn("_low", F.lower("_text"))
    enough = F.length("_text") >= MIN_PAGE_CHARS
    if mode == "broad":
        verdict = enough & (_keyword_count(F.col("_low"), BROAD_KEYWORDS) >= BROAD_MIN_KEYWORDS)
    elif mode == "focused":
        html = F.col("html")
        structured = html.rlike(r"(?i)<(code|pre|h[1-4])[\s>]") | F.contains("_text", F.lit("```"))
        verdict = enough & (_keyword_count(F.col("_low"), FOCUSED_KEYWORDS) >= 1) & structured
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return with_text.withColumn("is_doc", verdict).drop("_text", "_low")


def min_content(docs: DataFrame, n: int = MIN_CONTENT_CHARS) -> DataFrame:
    """Documents of at least ``n`` characters, with their ``word_count``."""
    return docs.filter(F.length("content") >= n).withColumn(
        "word_count", word_count(F.col("content"))
    )


def clean_pages(pages: DataFrame, mode: str = "article") -> DataFrame:
    """Pages to documents: ``doc_key, url, title, content, domain``.

    ``article`` takes the main region as markdown, ``broad`` and ``focused`` the
    visible text of pages that pass the quality test.
    """
    url, html = F.col("url"), F.col("html")
    if mode == "article":
        content, title = main_article_markdown(html, url), extract_title(html, url, "title")
    elif mode == "broad":
        pages = page_quality(pages, mode).filter("is_doc")
        content = visible_text_flat(strip_boilerplate(html, BROAD_BOILERPLATE))
        title = extract_title(html, url, "h1")
    else:
        pages = page_quality(pages, mode).filter("is_doc")
        clean = strip_boilerplate(html, FOCUSED_BOILERPLATE, FOCUSED_BOILERPLATE_CLASSES)
        content = visible_text_lines(clean, FOCUSED_MAIN_CLASSES)
        title = extract_title(html, url, "focused")
    docs = pages.select(
        F.col("page_id").cast("string").alias("doc_key"),
        "url",
        title.alias("title"),
        content.alias("content"),
        url_host(url).alias("domain"),
    )
    return docs if mode == "article" else min_content(docs)


def page_hrefs(html: Column) -> Column:
    """Distinct link targets of one page, as they are written."""
    return F.array_distinct(
        F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    )


def resolved(base: Column, href: Column) -> Column:
    return url_join(base, F.replace(href, F.lit("&amp;"), F.lit("&")))


def page_links(html: Column, base: Column) -> Column:
    """Distinct absolute targets of the links of one page."""
    return F.array_distinct(F.transform(page_hrefs(html), lambda h: resolved(base, h)))


def extract_links(
    pages: DataFrame, allow=(), base: Column | None = None, same_host: bool = False
) -> DataFrame:
    """``src, dst`` of links whose target holds one of ``allow``.

    Targets are resolved against ``base`` (the page itself by default). The
    broad form drops fragment and query; ``same_host`` keeps both but leaves the
    host. Duplicates go within the page, so nothing is shuffled.
    """
    url = F.col("url")
    base = url if base is None else base
    links = page_links(F.col("html"), base)
    if allow:
        hit = lambda u: F.exists(F.array(*[F.lit(a) for a in allow]), lambda a: F.contains(u, a))
        links = F.filter(links, hit)
    if same_host:
        links = F.filter(links, lambda u: url_host(u) == url_host(base))
    else:
        links = F.array_distinct(F.transform(links, url_page))
    return unnest(pages, links, url.alias("src")).select("src", F.col("item").alias("dst"))
