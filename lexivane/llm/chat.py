"""Chat formatting: layouts found by a hash of field paths, one template for all.

A layout is a declarative mapping (``LAYOUTS``) from nested field paths to turns. Its
fingerprint is the SHA-256 of its sorted paths. Of a table, the known paths of its
schema are taken; where layouts share a table, each row's own filled paths are hashed.
Fields that no layout knows do not count. Rows with an unknown fingerprint are
returned by ``unmapped`` and by nothing else.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. In texts and
roles, a backslash is put after each ``<`` that a ``|`` or a backslash follows, so that
no control string stands inside a text and removing it restores the text; line ends in
roles become ``<\\n``. ``loss_mask`` holds the code points of the assistant texts.

Turns are ordered by turn, then role, then text (nulls first). Null role or text:
empty. Null ids: one conversation with the id null. Repeated rows are repeated turns.
An empty table gives no rows. Very long texts are kept whole; a conversation is one
example, so all of it meets in one row.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.llm.common import query, table

START, END = "<|im_start|>", "<|im_end|>"

# fixed values: names that other layouts use for the roles
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """``rows``: one turn per row, in the columns (turn, role, text).
    ``items``: an array column and its fields of role and text.
    ``parts``: (role, columns) of each turn; columns that are filled are joined."""

    paths: tuple[str, ...]
    rows: tuple[str, str, str] | None = None
    items: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()


LAYOUTS = (
    Layout(("turn", "role", "text"), rows=("turn", "role", "text")),
    Layout(("messages[].role", "messages[].content"), items=("messages", "role", "content")),
    Layout(("conversations[].from", "conversations[].value"), items=("conversations", "from", "value")),
    Layout(("prompt", "response"), parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout(("prompt", "completion"), parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout(
        ("instruction", "input", "output"),
        parts=(("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
)
KNOWN = sorted({p for x in LAYOUTS for p in x.paths})


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """All nested leaf paths of a schema: ``a.b`` in structs, ``a[]`` in arrays."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


BY_PRINT = {fingerprint(x.paths): x for x in LAYOUTS}


def _top(path: str) -> str:
    return path.split("[")[0].split(".")[0]


def row_fingerprint(schema: T.StructType) -> Column:
    """The fingerprint of each row: of the table's known paths, or, where these are of
    several layouts, of those whose column is filled in the row."""
    paths = [p for p in KNOWN if p in set(field_paths(schema))]
    if fingerprint(paths) in BY_PRINT:
        return F.lit(fingerprint(paths))
    whole = [x for x in LAYOUTS if set(x.paths) <= set(paths)]
    flat = {p for x in whole if x.rows for p in x.paths}
    other = {p for p in paths if p not in flat}
    nothing = F.lit(True)
    for p in sorted(other):
        nothing = nothing & F.col(_top(p)).isNull()
    optional = {"input"}  # an instruction without an input is an instruction
    filled = []
    for p in paths:
        there = nothing if p in flat else F.col(_top(p)).isNotNull()
        if p in optional:
            there = F.col("instruction").isNotNull() if "instruction" in paths else there
        filled.append(F.when(there, F.lit(p)))
    return F.sha2(F.array_join(F.array_compact(F.array(*filled)), "\n").cast("binary"), 256)


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def _role(x: Column) -> Column:
    out = _text(x)
    for theirs, ours in ROLES.items():
        out = F.when(_text(x) == theirs, F.lit(ours)).otherwise(out)
    return out


def _turns(layout: Layout) -> Column:
    """A row's turns as array<struct<turn, role, text>>."""

    def turn(n, role, text):
        return F.struct(n.cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))

    if layout.rows:
        n, role, text = map(F.col, layout.rows)
        return F.array(turn(n, _text(role), _text(text)))
    if layout.items:
        column, role, text = layout.items
        return F.transform(column, lambda x, i: turn(i, _role(x[role]), _text(x[text])))
    said = []
    for i, (role, columns) in enumerate(layout.parts):
        full = [F.when(_text(F.col(c)) != "", F.col(c).cast("string")) for c in columns]
        said.append(turn(F.lit(i), F.lit(role), F.concat_ws("\n\n", *full)))
    return F.array(*said)


def canonical_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of the rows of any known layouts."""
    schema, there = rows.schema, set(field_paths(rows.schema))
    turns = F.lit(None).cast("array<struct<turn:bigint,role:string,text:string>>")
    for key, layout in BY_PRINT.items():
        if set(layout.paths) <= there:
            turns = F.when(F.col("__print") == key, _turns(layout)).otherwise(turns)
    return rows.withColumn("__print", row_fingerprint(schema)).select("conv_id", F.explode(turns).alias("t")).select("conv_id", "t.*")


def unmapped(rows: DataFrame) -> DataFrame:
    """The rows that no layout fits, with their fingerprint."""
    return rows.withColumn("fingerprint", row_fingerprint(rows.schema)).where(~F.col("fingerprint").isin(*BY_PRINT))


def escape(x: Column) -> Column:
    return F.regexp_replace(x, r"<([|\\])", r"<\\$1")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"<\\([|\\])", r"<$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> ``conv_id, formatted, loss_mask``."""
    order = ["turn", "role", "text"]
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("<\\n")), F.lit("\n"))
    pieces = turns.withColumns({"head": head, "body": escape(F.col("text"))})
    size = F.length("head") + F.length("body") + len(END) + 1
    upto = F.sum(size).over(Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    start = upto - len(END) - 1 - F.length("body")
    span = F.when(
        F.col("role") == "assistant",
        F.struct(start.cast("bigint").alias("start"), (start + F.length("body")).cast("bigint").alias("end")),
    )
    placed = pieces.withColumn("upto", upto).withColumn("span", span)
    held = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("upto", "span", "head", "body"))).alias("p"))
    body = F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n")))
    return held.select(
        "conv_id", F.array_join(body, "").alias("formatted"), F.array_compact(F.transform("p", lambda x: x["span"])).alias("loss_mask")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss texts from the formatted string and the mask alone."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, F.length("formatted") + 1)

    def turn(p):
        role = F.substring_index(p, "\n", 1)
        text = F.substring_index(F.substr(p, F.length(role) + 2), END, 1)
        return F.struct(
            unescape(F.replace(role, F.lit("<\\n"), F.lit("\n"))).alias("role"), unescape(text).alias("text")
        )

    loss = F.transform(
        "loss_mask", lambda m: unescape(F.substr(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))
    )
    return formatted.withColumns({"turns": F.transform(parts, turn), "loss_text": F.array_join(loss, "")})


SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -1, i, case i when 0 then 'user' else 'assistant' end, '<|im_end|><|im_start|>assistant ok' from range(2) r(i)),
e as (
  select *, length(regexp_replace(role, '<([|\\])', '<\\\1', 'g')) + length(regexp_replace(text, '<([|\\])', '<\\\1', 'g')) + 24 as n from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(n) as bigint) as formatted_chars
from e group by conv_id
"""


@query("op1_chat_formatting", SQL)
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    said = END + START + "assistant ok"
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = talks.select("conv_id", "turn", "role", "text").union(own)
    read = read_back(format_turns(canonical_turns(rows)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
