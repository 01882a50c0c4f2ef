"""Heading-aware chunking. One narrow stage: a document's sections, sentences
and chunks are array expressions over its row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivane.config import DEFAULTS
from lexivane.functions.text import anchor, anchor_link, let, strip, token_estimate, unnest

_HEADING = r"(?sU)^(#{1,6})\s+(.+)"
_STRINGS = "array<string>"
_SPANS = "array<struct<first:int,last:int,tokens:int>>"


def _heading_marks(lines: Column, track_fences: bool) -> Column:
    """Lines that open a section: the first line and every heading."""
    fenced = (
        # odd number of fence lines before the line means it is inside a fence
        let(
            F.transform(lines, lambda l: F.startswith(F.ltrim(l), F.lit("```")).cast("int")),
            lambda f: F.aggregate(
                f,
                F.struct(F.lit(0).alias("on"), F.array().cast("array<int>").alias("out")),
                lambda acc, x: F.struct(
                    ((acc["on"] + x) % 2).alias("on"),
                    F.concat(acc["out"], F.array(acc["on"])).alias("out"),
                ),
                lambda acc: acc["out"],
            ),
        )
        if track_fences
        else F.lit(None).cast("array<int>")
    )

    def mark(inside: Column):
        def of(line: Column, i: Column) -> Column:
            candidate = line.startswith("#")
            if track_fences:
                candidate = candidate & (F.get(inside, i) == 0)
            level = F.when(candidate, F.length(F.regexp_extract(line, _HEADING, 1)))
            return F.struct(
                (i + 1).alias("at"),
                F.coalesce(level, F.lit(0)).alias("level"),
                F.when(candidate, strip(F.regexp_extract(line, _HEADING, 2)))
                .otherwise("")
                .alias("text"),
            )

        return of

    opens = lambda m: (m["level"] > 0) | (m["at"] == 1)
    if not track_fences:
        return F.filter(F.transform(lines, mark(fenced)), opens)
    return let(fenced, lambda inside: F.filter(F.transform(lines, mark(inside)), opens))


def heading_paths(marks: Column) -> Column:
    """Path of every mark. A heading keeps the first ``level - 1`` entries of the
    path before it, so a skipped level does not leave a gap."""

    def step(acc: Column, m: Column) -> Column:
        stack = F.when(m["level"] == 0, acc["stack"]).otherwise(
            F.concat(F.slice(acc["stack"], 1, F.greatest(m["level"] - 1, F.lit(0))), F.array(m["text"]))
        )
        return let(
            stack,
            lambda s: F.struct(
                s.alias("stack"),
                F.concat(
                    acc["out"],
                    F.array(F.when(F.size(s) == 0, "Introduction").otherwise(F.array_join(s, " > "))),
                ).alias("out"),
            ),
        )

    empty = F.array().cast(_STRINGS)
    return F.aggregate(
        marks,
        F.struct(empty.alias("stack"), empty.alias("out")),
        step,
        lambda acc: acc["out"],
    )


def sections(content: Column, track_fences: bool = False) -> Column:
    """``array<struct(heading_path, anchor, content)>``; blank sections dropped.

    A heading line opens a section and belongs to it. Lines before the first
    heading form a section of their own.
    """

    def build(lines: Column, marks: Column, paths: Column) -> Column:
        def one(k: Column) -> Column:
            begin = marks[k - 1]["at"]
            end = F.coalesce(F.get(marks, k)["at"], F.size(lines) + 1)
            return F.struct(
                F.get(paths, k - 1).alias("heading_path"),
                anchor(marks[k - 1]["text"]).alias("anchor"),
                strip(F.array_join(F.slice(lines, begin, end - begin), "\n")).alias("content"),
            )

        return F.filter(
            F.transform(F.sequence(F.lit(1), F.size(marks)), one), lambda s: s["content"] != ""
        )

    return let(
        F.split(content, "\n"),
        lambda lines: let(
            _heading_marks(lines, track_fences),
            lambda marks: let(heading_paths(marks), lambda paths: build(lines, marks, paths)),
        ),
    )


def sentences(text: Column) -> Column:
    """Sentences of a section; heading, fence and list lines stay whole."""

    def of_line(line: Column) -> Column:
        whole = F.left(line, F.lit(1)).isin("#", "-", "*", "+") | line.startswith("```")
        parts = F.filter(
            F.transform(F.split(line, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != ""
        )
        return F.when(line == "", F.array().cast(_STRINGS)).when(whole, F.array(line)).otherwise(parts)

    return F.flatten(F.transform(F.transform(F.split(text, "\n"), strip), of_line))


def overlap_suffix(tk: Column, first: Column, last: Column, overlap: int) -> Column:
    """Longest run of sentences that ends at ``last``, starts no earlier than
    ``first`` and has at most ``overlap`` tokens: ``struct(n, tokens)``."""
    return F.aggregate(
        F.reverse(F.slice(tk, first, last - first + 1)),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("tokens"), F.lit(False).alias("full")),
        lambda acc, t: F.when(
            acc["full"] | (acc["tokens"] + t > overlap),
            F.struct(acc["n"].alias("n"), acc["tokens"].alias("tokens"), F.lit(True).alias("full")),
        ).otherwise(
            F.struct(
                (acc["n"] + 1).alias("n"),
                (acc["tokens"] + t).alias("tokens"),
                F.lit(False).alias("full"),
            )
        ),
    )


def pack_spans(tk: Column, size: int, overlap: int) -> Column:
    """Greedy packing over sentence token counts: ``array<struct(first, last,
    tokens)>`` of 1-based sentence ranges. Only numbers are carried along."""

    def state(first, tokens, out) -> Column:
        return F.struct(
            first.cast("int").alias("first"), tokens.cast("int").alias("tokens"), out.alias("out")
        )

    def step(acc: Column, i: Column) -> Column:
        t = F.get(tk, i - 1)
        span = F.struct(
            acc["first"].alias("first"), (i - 1).alias("last"), acc["tokens"].alias("tokens")
        )
        restart = let(
            overlap_suffix(tk, acc["first"], i - 1, overlap),
            lambda o: state(
                i - o["n"], o["tokens"] + t, F.concat(acc["out"], F.array(span).cast(_SPANS))
            ),
        )
        full = (acc["tokens"] + t > size) & (i > acc["first"])
        return F.when(full, restart).otherwise(state(acc["first"], acc["tokens"] + t, acc["out"]))

    n = F.size(tk)
    return F.aggregate(
        F.sequence(F.lit(1), n),
        state(F.lit(1), F.lit(0), F.array().cast(_SPANS)),
        step,
        lambda acc: F.concat(
            acc["out"],
            F.array(
                F.struct(acc["first"].alias("first"), n.alias("last"), acc["tokens"].alias("tokens"))
            ).cast(_SPANS),
        ),
    )


def pack(content: Column, size: int, overlap: int) -> Column:
    """Chunks of one section: ``array<struct(content, token_count)>``."""
    whole = F.array(
        F.struct(content.alias("content"), token_estimate(content).alias("token_count"))
    )

    def split_up(ss: Column) -> Column:
        return let(
            F.transform(ss, token_estimate),
            lambda tk: F.transform(
                pack_spans(tk, size, overlap),
                lambda p: F.struct(
                    F.array_join(F.slice(ss, p["first"], p["last"] - p["first"] + 1), " ").alias(
                        "content"
                    ),
                    p["tokens"].alias("token_count"),
                ),
            ),
        )

    return F.when(token_estimate(content) <= size, whole).otherwise(let(sentences(content), split_up))


def split_sections(docs: DataFrame, track_fences: bool = False) -> DataFrame:
    """``doc_key, url, title, content`` -> one row per section."""
    found = sections(F.col("content"), track_fences)
    return unnest(docs, found, "doc_key", "url", "title").select(
        "doc_key",
        "url",
        "title",
        F.col("pos").alias("section_seq"),
        "item.heading_path",
        "item.anchor",
        "item.content",
    )


def pack_chunks(
    rows: DataFrame, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap
) -> DataFrame:
    """Rows with ``content`` (sections) -> one row per chunk, ``chunk_seq`` from 1
    within the row."""
    keep = [c for c in rows.columns if c != "content"]
    text = strip(F.col("content"))
    packed = F.when(text != "", pack(text, size, overlap))
    return unnest(rows, packed, *keep).select(
        *keep, F.col("pos").alias("chunk_seq"), "item.content", "item.token_count"
    )


def chunk_id(doc_key: Column, seq: Column) -> Column:
    return F.concat(doc_key, F.lit(":"), seq.cast("string"))


def link_chunks(chunks: DataFrame) -> DataFrame:
    """Previous and next ids across a document. ``n_chunks`` comes with the row,
    so the neighbours' ids follow from the sequence number alone."""
    seq, key = F.col("chunk_seq"), F.col("doc_key")
    return chunks.select(
        chunk_id(key, seq).alias("chunk_id"),
        "*",
        F.when(seq > 1, chunk_id(key, seq - 1)).alias("prev_id"),
        F.when(seq < F.col("n_chunks"), chunk_id(key, seq + 1)).alias("next_id"),
    ).drop("n_chunks")


def chunk_documents(
    docs: DataFrame,
    size: int = DEFAULTS.chunk_size,
    overlap: int = DEFAULTS.chunk_overlap,
    track_fences: bool = False,
) -> DataFrame:
    """``doc_key, url, title, content`` -> the ``chunks`` table."""

    def of_section(s: Column, i: Column) -> Column:
        return F.transform(
            pack(s["content"], size, overlap),
            lambda c: F.struct(
                s["heading_path"].alias("heading_path"),
                s["anchor"].alias("anchor"),
                (i + 1).alias("section_seq"),
                c["content"].alias("content"),
                c["token_count"].alias("token_count"),
            ),
        )

    chunks = F.flatten(F.transform(sections(F.col("content"), track_fences), of_section))
    packed = docs.select("doc_key", "url", "title", chunks.alias("cs"))
    rows = unnest(
        packed, F.col("cs"), "doc_key", "url", "title", F.size("cs").alias("n_chunks")
    ).select(
        "doc_key",
        F.col("url").alias("source_url"),
        "title",
        "item.heading_path",
        anchor_link(F.col("url"), F.col("item.anchor")).alias("anchor_link"),
        "item.section_seq",
        F.col("pos").alias("chunk_seq"),
        "item.content",
        "item.token_count",
        "n_chunks",
    )
    return link_chunks(rows)
