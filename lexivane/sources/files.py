"""Documentation trees on disk or object storage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.config import (
    API_EXCLUDED_PARTS,
    API_EXTENSIONS,
    API_ROOT,
    CORPUS_EXCLUDED_DIRS,
    DOC_EXTENSIONS,
    FOCUSED_GLOBS,
    MAX_FILE_BYTES,
    NON_DOC_NAMES,
)
from lexivane.functions.html import html_to_markdown
from lexivane.functions.text import (
    extract_title_md,
    mdx_to_markdown,
    rst_to_markdown,
    strip,
    valid_utf8,
)


def scan_docs(spark: SparkSession, root: str, exts=DOC_EXTENSIONS) -> DataFrame:
    """``path, modificationTime, length, content`` of every file below ``root``
    with one of the extensions. ``content`` is read only if it is used."""
    names = ",".join(e.lstrip(".") for e in exts)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*.{{{names}}}")
        .load(root)
    )


def decode_text(files: DataFrame, raw: str = "content") -> DataFrame:
    """``text`` from binary ``content``; unreadable and empty files are dropped."""
    keep = [c for c in files.columns if c != raw]
    return files.select(*keep, valid_utf8(F.col(raw)).alias("text")).filter(F.length("text") > 0)


def glob_pattern(glob: str) -> str:
    """A ``**`` glob as a regular expression over a relative path."""
    out = ""
    for piece in re.split(r"(\*\*/|\*\*|\*|\?)", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(piece, re.escape(piece))
    return f"^{out}$"


def _contains_any(c: Column, parts) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | F.contains(c, F.lit(part))
    return hit


def filter_files(
    files: DataFrame,
    exclude=(),
    max_bytes: int | None = MAX_FILE_BYTES,
    deny_names=NON_DOC_NAMES,
    include_globs=(),
    under: str | None = None,
    exts=(),
    root: str = "",
) -> DataFrame:
    """Files chosen by path, size and name. Paths come out distinct.

    The size test reaches the file listing, so large files are never opened.
    """
    path = F.col("path")
    relative = F.substring(path, len(root.rstrip("/")) + 2, 1 << 20) if root else path
    keep = ~_contains_any(path, exclude)
    if max_bytes is not None:
        keep = keep & (F.col("length") <= max_bytes)
    if deny_names:
        keep = keep & ~F.substring_index(path, "/", -1).isin(*deny_names)
    if under:
        keep = keep & relative.startswith(under)
    if exts:
        keep = keep & relative.rlike("(" + "|".join(re.escape(e) for e in exts) + ")$")
    if include_globs:
        keep = keep & relative.rlike("|".join(f"({glob_pattern(g)})" for g in include_globs))
    return files.filter(keep).dropDuplicates(["path"])


def filter_corpus_files(
    files: DataFrame, root: str = "", max_bytes: int = MAX_FILE_BYTES
) -> DataFrame:
    return filter_files(files, exclude=CORPUS_EXCLUDED_DIRS, max_bytes=max_bytes, root=root)


def filter_api_files(
    files: DataFrame, root: str = "", max_bytes: int = MAX_FILE_BYTES
) -> DataFrame:
    return filter_files(
        files,
        exclude=API_EXCLUDED_PARTS,
        max_bytes=max_bytes,
        under=API_ROOT,
        exts=API_EXTENSIONS,
        root=root,
    )


def select_focused_files(files: DataFrame, root: str = "") -> DataFrame:
    return filter_files(files, max_bytes=None, deny_names=(), include_globs=FOCUSED_GLOBS, root=root)


def dispatch_by_ext(files: DataFrame, root: str = "") -> DataFrame:
    """``path, text`` -> ``url, title, content, source``, converted by extension."""
    path, text = F.col("path"), F.col("text")
    relative = F.substring(path, len(root.rstrip("/")) + 2, 1 << 20) if root else path
    content = (
        F.when(path.endswith(".rst"), rst_to_markdown(text))
        .when(path.endswith(".mdx"), mdx_to_markdown(text))
        .when(path.rlike(r"\.html?$"), html_to_markdown(text))
        .otherwise(text)
    )
    return (
        files.select(relative.alias("source"), content.alias("content"))
        .filter(strip(F.col("content")) != "")
        .select(
            F.concat(F.lit("file://"), "source").alias("url"),
            extract_title_md(F.col("content"), F.col("source")).alias("title"),
            "content",
            "source",
        )
    )


def load_docs(spark: SparkSession, root: str, choose=filter_corpus_files) -> DataFrame:
    """Tree to documents: scan, choose, decode, convert."""
    base = root if "://" in root or root.startswith("file:") else f"file:{root}"
    files = choose(scan_docs(spark, root), root=base)
    return dispatch_by_ext(decode_text(files.select("path", "content")), root=base).withColumn(
        "doc_key", F.col("source")
    )
