"""HTML as tag events: subtrees by a depth stack, and markdown of blocks.

A page is cut into tokens, which are tags or runs of text; tags of elements within a line
(``INLINE``) are part of the text. A stack of open elements
is carried over them by ``aggregate``: an end tag closes the nearest open element of its
name and all that are open in it, and one without such an element is ignored. So nested
elements end where they end, and an element that is never closed ends with its parent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexivane.functions.text import let
from lexivane.functions.urls import url_join

# fixed values: the elements of HTML without content, and those whose content is no markup
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
RAW = ("script", "style")
# fixed values: elements that stand on lines of their own
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "header", "main", "nav", "p", "section", "summary", "table", "tbody", "thead",
)

# fixed values: elements within a line, which hold no blocks
INLINE = (
    "a", "abbr", "b", "br", "cite", "code", "em", "font", "i", "img", "kbd", "mark", "q", "s", "samp", "small", "span", "strong",
    "sub", "sup", "time", "tt", "u", "var", "wbr",
)

# a run of text and tags within a line (in pieces, as Java's expressions recurse), a tag, or a stray sign
TOKEN = rf"(?is)(?:[^<]++|</?(?:{'|'.join(INLINE)})(?=[\s/>])[^>]*+>){{1,200}}|<[!/]?[A-Za-z][^>]*+>|<"
CHUNK = 256
OPEN, CLOSE, TEXT, OTHER = 1, 2, 0, 3


def without_raw(c: Column, tags=RAW) -> Column:
    """Comments and raw elements away; these do not nest."""
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    for tag in tags:
        c = F.regexp_replace(c, rf"(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>", "")
    return c


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def tag_name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))


def token_kind(token: Column, name: Column) -> Column:
    """Void and self-closed elements, which hold nothing, are OTHER, as is a doctype."""
    tag = F.length(token) > 1
    return (
        F.when(~token.startswith("<") | ~tag | name.isin(*INLINE), F.lit(TEXT))
        .when(token.startswith("</"), F.lit(CLOSE))
        .when(token.startswith("<!") | token.endswith("/>") | name.isin(*VOID), F.lit(OTHER))
        .otherwise(F.lit(OPEN))
    )


def attribute(token: Column, name: str) -> Column:
    """Value of a quoted or bare attribute; empty where it is missing."""
    found = F.regexp_extract(token, rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0)
    return F.regexp_replace(F.regexp_replace(found, rf"(?is)^\s{name}\s*=\s*", ""), "^[\"']|[\"']$", "")


def subtrees(toks: Column, pick: Callable[[Column, Column], Column]) -> Column:
    """``array<struct<a, b, closed>>``: first and last token of the outermost elements
    that ``pick(name, token)`` takes; ``closed``: the last one is its own end tag."""

    def mark(t: Column) -> Column:
        name = tag_name(t)
        return F.struct(token_kind(t, name).alias("kind"), name.alias("name"), pick(name, t).alias("pick"))

    marks = F.transform(toks, mark)
    spans = F.expr("cast(array() as array<struct<a: int, b: int, closed: boolean>>)")
    zero = F.struct(
        F.lit(0).alias("i"), F.expr("cast(array() as array<string>)").alias("stack"), F.lit(0).alias("level"), F.lit(0).alias("start"), spans.alias("spans")
    )

    def step(acc: Column, m: Column) -> Column:
        found = F.array_position(acc["stack"], m["name"]).cast("int")
        stack = (
            F.when(m["kind"] == OPEN, F.array_prepend(acc["stack"], m["name"]))
            .when((m["kind"] == CLOSE) & (found > 0), F.slice(acc["stack"], found + 1, F.size(acc["stack"])))
            .otherwise(acc["stack"])
        )
        inside = acc["level"] > 0
        starts = ~inside & (m["kind"] == OPEN) & m["pick"]
        ends = inside & (F.size(stack) < acc["level"])
        own = found == F.size(acc["stack"]) - acc["level"] + 1
        span = F.struct(acc["start"].alias("a"), F.when(own, acc["i"]).otherwise(acc["i"] - 1).alias("b"), own.alias("closed"))
        return F.struct(
            (acc["i"] + 1).alias("i"),
            stack.alias("stack"),
            F.when(starts, F.size(stack)).when(ends, 0).otherwise(acc["level"]).alias("level"),
            F.when(starts, acc["i"]).otherwise(acc["start"]).alias("start"),
            F.when(ends, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    def finish(acc: Column) -> Column:
        rest = F.struct(acc["start"].alias("a"), (acc["i"] - 1).alias("b"), F.lit(False).alias("closed"))
        return F.when(acc["level"] > 0, F.array_append(acc["spans"], rest)).otherwise(acc["spans"])

    return F.aggregate(marks, zero, step, finish)


def without_subtrees(c: Column, pick: Callable[[Column, Column], Column]) -> Column:
    """The page without the elements that ``pick`` takes, whole subtrees."""

    def rest(toks: Column, spans: Column) -> Column:
        ends = F.concat(F.transform(spans, lambda s: s["a"]), F.array(F.size(toks)))
        begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["b"] + 1))
        gaps = F.transform(F.arrays_zip(begins.alias("a"), ends.alias("z")), lambda g: F.slice(toks, g["a"] + 1, g["z"] - g["a"]))
        return F.array_join(F.flatten(gaps), "")

    return let(tokens(c), lambda toks: let(subtrees(toks, pick), lambda spans: rest(toks, spans)))


def first_subtree(c: Column, pick: Callable[[Column, Column], Column]) -> Column:
    """What stands in the first element that ``pick`` takes; null if there is none."""

    def inner(toks: Column, span: Column) -> Column:
        n = span["b"] - span["a"] - F.when(span["closed"], 1).otherwise(0)
        return F.when(span.isNotNull(), F.array_join(F.slice(toks, span["a"] + 2, n), ""))

    return let(tokens(c), lambda toks: let(F.get(subtrees(toks, pick), F.lit(0)), lambda span: inner(toks, span)))


def has_class(token: Column, classes) -> Column:
    return attribute(token, "class").rlike("(?i)" + "|".join(classes)) if classes else F.lit(False)


def scan(items: Column, zero: Column, step, emit, kind: str = "string") -> Column:
    """``emit(state before, item)``, of type ``kind``, for each item, the state carried
    by ``step``.

    Results are gathered in chunks, so that a long list is not copied for each item.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")
    lists = F.expr(f"cast(array() as array<array<{kind}>>)")
    n = F.size(items)
    firsts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    chunks = F.transform(firsts, lambda k: F.slice(items, k * CHUNK + 1, CHUNK))

    def one(x: Column, t: Column) -> Column:
        return F.struct(step(x["s"], t).alias("s"), F.array_append(x["out"], emit(x["s"], t)).alias("out"))

    def many(acc: Column, chunk: Column) -> Column:
        got = F.aggregate(chunk, F.struct(acc["s"].alias("s"), none.alias("out")), one)
        return let(got, lambda g: F.struct(g["s"].alias("s"), F.array_append(acc["out"], g["out"]).alias("out")))

    return F.flatten(F.aggregate(chunks, F.struct(zero.alias("s"), lists.alias("out")), many)["out"])


# marks of inline elements and line breaks until all text is known; not in texts
LINK, TARGET, LINK_END, BOLD, BOLD_END, SLANT, SLANT_END, LINE = "\x01\x02\x03\x04\x05\x06\x0e\x0f"
_MARKS = LINK + TARGET + LINK_END + BOLD + BOLD_END + SLANT + SLANT_END + LINE


LISTS = r"(?i)</?(?:ul|ol|li|pre)(?=[\s/>])[^>]*>"


def _lists_and_pre(c: Column) -> Column:
    """List items and preformatted text as lines, white space elsewhere as one blank.

    Only the tags of lists and ``pre`` need to know what they stand in, so the scan goes
    over these alone, each with what follows it.
    """
    plain = lambda x: F.regexp_replace(x, r"\s+", " ")
    zero = F.struct(F.expr("cast(array() as array<struct<ordered: boolean, n: int>>)").alias("lists"), F.lit(0).alias("pre"))

    def mark(tag: Column, rest: Column) -> Column:
        return F.struct(tag_name(tag).alias("name"), (~tag.startswith("</")).alias("opens"), rest.alias("rest"))

    def depth_of_pre(s: Column, t: Column) -> Column:
        return F.when(t["name"] == "pre", F.greatest(s["pre"] + F.when(t["opens"], 1).otherwise(-1), F.lit(0))).otherwise(s["pre"])

    def step(s: Column, t: Column) -> Column:
        is_list = t["name"].isin("ul", "ol")
        rest = F.slice(s["lists"], 2, F.size(s["lists"]))
        top = F.get(s["lists"], F.lit(0))
        new = F.struct((t["name"] == "ol").alias("ordered"), F.lit(0).alias("n"))
        counted = F.struct(top["ordered"].alias("ordered"), (top["n"] + 1).alias("n"))
        held = (
            F.when(is_list & t["opens"], F.array_prepend(s["lists"], new))
            .when(is_list & (F.size(s["lists"]) > 0), rest)
            .when((t["name"] == "li") & t["opens"] & (F.size(s["lists"]) > 0), F.array_prepend(rest, counted))
            .otherwise(s["lists"])
        )
        return F.struct(held.alias("lists"), depth_of_pre(s, t).alias("pre"))

    def emit(s: Column, t: Column) -> Column:
        depth, top = F.size(s["lists"]), F.get(s["lists"], F.lit(0))
        number = F.when(F.coalesce(top["ordered"], F.lit(False)), F.concat((top["n"] + 1).cast("string"), F.lit(". "))).otherwise("- ")
        item = F.concat(F.lit(LINE), F.repeat(F.lit("  "), F.greatest(depth - 1, F.lit(0))), number)
        inner = F.when(t["opens"], depth > 0).otherwise(depth > 1)
        piece = (
            F.when(t["name"] == "li", F.when(t["opens"], item).otherwise(""))
            .when(t["name"] == "pre", F.when(t["opens"], "\n\n```\n").otherwise("\n```\n\n"))
            .otherwise(F.when(inner, LINE).otherwise("\n\n"))
        )
        rest = F.when(depth_of_pre(s, t) > 0, F.regexp_replace(t["rest"], r"</?[A-Za-z][^>]*>", "")).otherwise(plain(t["rest"]))
        return F.concat(piece, rest)

    def put(b: Column) -> Column:
        marks = F.transform(b["tags"], lambda tag, i: mark(tag, F.get(b["gaps"], i + 1)))
        return F.concat(plain(F.get(b["gaps"], F.lit(0))), F.array_join(scan(marks, zero, step, emit), ""))

    both = F.struct(F.regexp_extract_all(c, F.lit(LISTS), F.lit(0)).alias("tags"), F.split(c, LISTS, -1).alias("gaps"))
    return F.when(c.rlike(LISTS), let(both, put)).otherwise(plain(c))


def _targets(text: Column, base: Column | None) -> Column:
    """Link and image tags with their targets, absolute if ``base`` is given."""
    absolute = (lambda u: F.when(u == "", u).otherwise(url_join(base, u))) if base is not None else (lambda u: u)
    marked = F.regexp_replace(text, r"(?is)<(a|img)(\s[^>]*)?/?>", f"{LINK}$1$2{TARGET}")

    def one(part: Column, i: Column) -> Column:
        tag, rest = F.substring_index(part, TARGET, 1), F.substr(part, F.instr(part, TARGET) + 1)
        image = F.concat(F.lit("!["), attribute(tag, "alt"), F.lit("]("), absolute(attribute(tag, "src")), F.lit(")"), rest)
        link = F.concat(F.lit(LINK), absolute(attribute(tag, "href")), F.lit(TARGET), rest)
        return F.when(i == 0, part).when(F.lower(F.left(tag, F.lit(1))) == "i", image).otherwise(link)

    return F.array_join(F.transform(F.split(marked, LINK), one), "")


def block_markdown(c: Column, base: Column | None = None) -> Column:
    """Markdown of a page or a part of it, entities not yet decoded.

    Blocks, headings of six levels, list items (numbered in ``ol``, indented by their
    depth) and rows of tables stand on lines of their own; links and images get
    absolute targets if ``base`` is given; emphasis that is never closed is dropped;
    white space of the source is one blank, but in ``pre``.
    """
    text = _targets(let(F.translate(without_raw(c), _MARKS, ""), _lists_and_pre), base)
    end = r"(?=[\s/>])[^>]*>"
    steps = [(rf"(?i)<h{n}{end}", "\n\n" + "#" * n + " ") for n in range(1, 7)]
    steps += [
        (rf"(?i)</h[1-6]{end}|</?(?:{'|'.join(BLOCKS)}){end}", "\n\n"),
        (rf"(?i)<br{end}", "\n"),
        (rf"(?i)<hr{end}", "\n\n---\n\n"),
        (rf"(?i)</?code{end}", "`"),
        (rf"(?i)<tr{end}", "\n| "),
        (rf"(?i)</t[dh]{end}", " | "),
        (rf"(?i)</a{end}", LINK_END),
        (rf"(?i)<(?:b|strong){end}", BOLD),
        (rf"(?i)</(?:b|strong){end}", BOLD_END),
        (rf"(?i)<(?:i|em){end}", SLANT),
        (rf"(?i)</(?:i|em){end}", SLANT_END),
        (r"(?s)<[!/]?[A-Za-z][^>]*>", ""),
        (f"{LINK}([^{TARGET}]+){TARGET}\\s*([^{LINK_END}{LINK}]*?[^{LINK_END}{LINK}\\s])\\s*{LINK_END}", "[$2]($1)"),
        (f"{LINK}[^{TARGET}]*{TARGET}", ""),
        (f"{BOLD}([^{BOLD}{BOLD_END}\n]+){BOLD_END}", "**$1**"),
        (f"{SLANT}([^{SLANT}{SLANT_END}\n]+){SLANT_END}", "*$1*"),
        (f"[{LINK_END}{BOLD}{BOLD_END}{SLANT}{SLANT_END}]", ""),
        (f"{LINE}(?: ?{LINE})*", "\n"),
        (r"(?m)^#{1,6}\s*$", ""),
    ]
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return text
