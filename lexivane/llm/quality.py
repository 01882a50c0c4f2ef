"""Quality rules: a table of thresholds compiled into one projection.

``RULES`` names a measure, its least and its greatest allowed value. Measures are
column expressions over one text, so all rules are one narrow Spark projection
without functions of the user's. A document is kept if no rule fails.

Null or empty text: no words, hence not kept. Repeated rows are judged one by one, an
empty table gives no rows, and columns of other names are ignored (``judge`` keeps
them; its own columns replace columns of the same name).

Repeated windows are found by sorting numbers: a window's hash with its position in
the low bits. Windows that share the kept bits of the hash are then compared as
strings, so the count is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.llm.common import BLANKS, fresh, let, query, table, text_or_empty, word_list

SYMBOLS = "#*$%&|<>"

# fixed values: frequent function words of English, French, German and Spanish
STOP_WORDS = (
    "the of and to in that is for with on be as was it at by from this have are or not "
    "la le de et les des en du que un une est pour dans au qui sur par avec "
    "der die das den und mit ist zu von im dem ein eine nicht auf sich auch "
    "el los las y se del con por su para como más al lo o"
).split()

# measure, least, greatest; None: no bound
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 50, None),
    ("repeat_word_ratio", None, 0.5),
    ("mean_word_chars", 2.5, 12),
    ("symbol_ratio", None, 0.25),
    ("stop_words", 2, None),
    ("stop_word_ratio", 0.05, None),
    ("dup_line_ratio", None, 0.5),
)
BASE = ("n_words", "repeat_word_ratio")

SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (
  select *, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) as grams,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
  from d),
u as (select doc_id, t, unnest(grams) as gram, unnest(range(1, len(grams) + 1)) as i from g),
r as (
  select doc_id, t, i, least(3, coalesce(lead(i) over (partition by doc_id, t order by i) - i, 3)) as fresh
  from (select *, count(*) over (partition by doc_id, t, gram) as n from u) where n > 1),
rep as (select doc_id, t, sum(fresh) as n from r group by doc_id, t),
m as (
  select g.doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
    length(regexp_replace(g.t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, len(lines) as n_lines,
    len(list_filter(w, lambda x: list_contains({stop}, regexp_replace(lower(x), '[.,]', '', 'g')))) as stops
  from g left join rep on g.doc_id = rep.doc_id and g.t = rep.t)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and word_chars >= 2.5 * n_words and word_chars <= 12 * n_words
    and n_symbols <= 0.25 * n_words and stops >= 2 and stops >= 0.05 * n_words and n_dup_lines <= 0.5 * n_lines as kept
from m
""".replace("{stop}", "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]")


def repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more in ``w``."""
    last = F.size(w) - 3
    none = F.array().cast("array<bigint>")
    hashes = F.when(
        last >= 1,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
    ).otherwise(none)

    def exact(h: Column) -> Column:
        return let(F.length(F.bin(F.size(h).cast("long"))), lambda bits: _covered(w, h, bits))

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(h)))


def _covered(w: Column, h: Column, bits: Column) -> Column:
    def tag(x):  # the hash without its lowest bits
        return F.call_function("shiftright", x, bits)

    def neighbour(key, sorted_: Column, x: Column, k: Column) -> Column:
        """Whether ``x`` at ``k`` has the key of the entry before or after it."""
        before = (k > 0) & (key(F.get(sorted_, F.greatest(k - 1, F.lit(0)))) == key(x))
        return before | F.coalesce(key(F.get(sorted_, k + 1)) == key(x), F.lit(False))

    packed = F.sort_array(
        F.transform(h, lambda x, i: F.call_function("shiftleft", tag(x), bits).bitwiseOR(i.cast("long")))
    )
    like = let(packed, lambda p: F.filter(p, lambda x, k: neighbour(tag, p, x, k)))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1

    def gram(x):
        i = x.bitwiseAND(mask).cast("int")
        return F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))

    grams = F.sort_array(F.transform(like, gram))
    same = let(grams, lambda g: F.filter(g, lambda x, k: neighbour(lambda e: e["g"], g, x, k)))
    starts = F.sort_array(F.transform(same, lambda x: x["i"]))
    fresh = let(
        starts,
        lambda s: F.transform(s, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - i, F.lit(3)))),
    )
    return F.aggregate(fresh, F.lit(0), lambda a, x: a + x)


def counts(text: Column) -> Column:
    """All counts of a text as one struct."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])

    def of(w: Column, ls: Column) -> Column:
        plain = F.transform(w, lambda x: F.translate(F.lower(x), ".,", ""))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(plain, lambda x: F.array_contains(stops, x))).cast("long").alias("stop_words"),
        )

    return let(F.struct(word_list(text).alias("w"), lines.alias("l")), lambda b: of(b["w"], b["l"]))


def _measures(c: Column) -> dict[str, Column]:
    """name: (numerator, denominator); compared as products, without division."""
    one = F.lit(1)
    return {
        "n_words": (c["n_words"], one),
        "repeat_word_ratio": (c["n_repeat_words"], c["n_words"]),
        "mean_word_chars": (c["word_chars"], c["n_words"]),
        "symbol_ratio": (c["n_symbols"], c["n_words"]),
        "stop_words": (c["stop_words"], one),
        "stop_word_ratio": (c["stop_words"], c["n_words"]),
        "dup_line_ratio": (c["n_dup_lines"], c["n_lines"]),
    }


def failed(c: Column, rules=RULES) -> Column:
    """The table as one condition: true where a rule fails."""
    out, measures = F.lit(False), _measures(c)
    for name, least, most in rules:
        top, base = measures[name]
        if least is not None:
            out = out | (top < F.lit(least) * base)
        if most is not None:
            out = out | (top > F.lit(most) * base)
    return out


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """Adds the counts, ``base_failed`` and ``kept``."""
    base = tuple(r for r in rules if r[0] in BASE)
    own = fresh(docs, "counts")
    held = docs.withColumn(own, counts(text_or_empty()))
    c = F.col(own)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return held.withColumns(
        {n: c[n] for n in names} | {"base_failed": failed(c, base), "kept": ~failed(c, rules)}
    ).drop(own)


def kept_rows(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns as they are."""
    own = fresh(docs, "counts")
    return docs.withColumn(own, counts(text_or_empty())).where(~failed(F.col(own), rules)).drop(own)


@query("op5_quality_rules", SQL)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
