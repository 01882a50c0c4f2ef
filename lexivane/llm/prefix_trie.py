"""Prefix trie of conversations, with count-min screening of prefix digests.

A prefix of ``d`` turns is known by 128 bits: the exclusive or of a hash of each turn
and its place, so running values come from sums over tiles and no conversation has to
meet in one task. Counts of all prefixes go into a count-min sketch of ``LANES`` rows.
An estimate is never too small, so one that says 1 proves that a prefix is of one
conversation alone; from the first such prefix on, the conversation's tail is a chain of
its own and is emitted where it stands. Only prefixes that may be shared are shuffled by
digest and grouped exactly; the sketch decides what is moved, never what is returned.
Its width follows the number of prefixes up to ``WIDTH`` bits a row, which bounds what
is broadcast; a fuller sketch sends more prefixes to the exact grouping.

A node is named by its smallest member and its depth. A member that is smallest at one
depth is so at all greater ones; so leaves, children and saved tokens of a whole subtree
are sums over the members of its top, without a walk over the levels.

Turns are ordered by turn (null first), then by the MD5 of role and text. Null role or
text: empty. Null ids: no conversation, their rows take no part. Repeated rows are
repeated turns. Very long texts are hashed whole, at the start. An empty table has no
node, not even a root. Further columns are ignored. The ids that end at one node are
hashed in one task, as SHA-256 runs through them in order, but as a stream.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexivane.llm.common import WORD, query, table, tiles
from lexivane.session import bounded_broadcast, materialize

LANES = 2
WIDTH = 1 << 25  # bits a row of the sketch at most: 8 MiB for two rows
CELLS = 4  # bits for each prefix, below that bound
PAGE = 32_768  # bits of one of Spark's bitmaps

EMPTY = hashlib.sha256(b"").hexdigest()

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, turn_hash, words, tile``: turns in order, counted from 1.

    Rows are range-sorted by conversation and turn without their texts. A tile is a part
    of one range that belongs to one conversation, so a long one is many tiles.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    narrow = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("turn_hash"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["turn", "turn_hash", "row"]
    ranged = narrow.repartitionByRange(tiles(conversations.count()), "conv_id", *order)
    ranged = materialize(ranged.withColumn("tile", F.spark_partition_id()))
    rank = F.row_number().over(Window.partitionBy("conv_id", "tile").orderBy(*order))
    rows = ranged.withColumn("pos", rank.cast("long"))
    counts = ranged.groupBy("conv_id", "tile").agg(F.count(F.lit(1)).alias("n"))
    return _continued(rows, counts, {"n": ("pos", lambda own, before: own + before)}, F.sum).select(
        "conv_id", "pos", "turn_hash", "words", "tile"
    )


def _continued(rows: DataFrame, totals: DataFrame, columns: dict, total) -> DataFrame:
    """Running values within (conv_id, tile) carried on from the tiles before.

    ``columns``: total's column -> (running column, how the two are put together). A
    tile begins inside a conversation at most once, so few totals are joined.
    """
    before = Window.partitionBy("conv_id").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("conv_id", "tile", *[(total[c] if isinstance(total, dict) else total)(c).over(before).alias(f"before_{c}") for c in columns])
    starts = starts.where(" or ".join(f"before_{c} is not null" for c in columns))
    joined = rows.join(bounded_broadcast(materialize(starts)), ["conv_id", "tile"], "left")
    for c, (running, put) in columns.items():
        joined = joined.withColumn(running, put(F.col(running), F.coalesce(f"before_{c}", F.lit(0).cast("long"))))
    return joined.drop(*[f"before_{c}" for c in columns])


def grafted(ordered: DataFrame, family: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths after the first turns of each conversation ``c`` are replaced
    by as many of conversation ``c - c % family``: crc32(c) mod (``most`` + 1) of them."""
    first = F.when(F.col("pos") <= most, F.struct("pos", "turn_hash", "words"))
    own = materialize(
        ordered.groupBy("conv_id").agg(
            F.max("pos").alias("n_own"), F.min("tile").alias("first_tile"), F.sort_array(F.collect_list(first)).alias("first")
        )
    )
    heads = own.select(F.col("conv_id").alias("base"), F.col("first").alias("head"))
    cut = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    convs = (
        own.drop("first")
        .withColumns({"base": F.col("conv_id") - F.col("conv_id") % family, "cut": cut})
        .join(heads, "base", "left")
        .withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("cut").cast("int")))
        .withColumn("n_head", F.size("head").cast("long"))
        .withColumn("n", F.col("n_head") + F.greatest(F.col("n_own") - F.col("cut"), F.lit(0)))
    )
    convs = materialize(convs)
    put = convs.select("conv_id", F.explode("head").alias("x"), F.col("first_tile").alias("tile"))
    kept = ordered.join(convs.select("conv_id", "cut", "n_head"), "conv_id").where("pos > cut")
    turns = kept.select("conv_id", (F.col("pos") - F.col("cut") + F.col("n_head")).alias("pos"), "turn_hash", "words", "tile")
    turns = turns.unionByName(put.select("conv_id", "x.pos", "x.turn_hash", "x.words", "tile"))
    return turns, convs.select("conv_id", "n")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, depth, x1, x2, words, upto, ends``: each prefix with its digest, the
    words up to its last turn, and whether the conversation ends with it."""
    place = [F.xxhash64(F.lit(i), "pos", "turn_hash").alias(f"y{i}") for i in (1, 2)]
    hashed = materialize(turns.select("conv_id", "tile", "pos", "words", *place))
    run = Window.partitionBy("conv_id", "tile").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = hashed.withColumns({"x1": F.bit_xor("y1").over(run), "x2": F.bit_xor("y2").over(run), "upto": F.sum("words").over(run)})
    totals = hashed.groupBy("conv_id", "tile").agg(F.bit_xor("y1").alias("y1"), F.bit_xor("y2").alias("y2"), F.sum("words").alias("words"))
    together = {
        "y1": ("x1", lambda own, before: own.bitwiseXOR(before)),
        "y2": ("x2", lambda own, before: own.bitwiseXOR(before)),
        "words": ("upto", lambda own, before: own + before),
    }
    rows = _continued(rows, totals, together, {"y1": F.bit_xor, "y2": F.bit_xor, "words": F.sum})
    return rows.join(convs, "conv_id").select(
        "conv_id", F.col("pos").alias("depth"), "x1", "x2", "words", "upto", (F.col("pos") == F.col("n")).alias("ends")
    )


def _cells(width: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(100 + i), "x1", "x2"), F.lit(width)).alias(f"cell{i}") for i in range(LANES)]


def sketch(rows: DataFrame, n_prefixes: int) -> tuple[int, np.ndarray]:
    """Width, and the count-min sketch's rows as bits: whether a counter is above 1.

    Counters are summed before the shuffle, so a task sends ``LANES * WIDTH`` at most;
    the driver gets bitmaps of a fixed size.
    """
    width = min(WIDTH, max(PAGE, 1 << (CELLS * n_prefixes).bit_length()))
    met = rows.select(F.posexplode(F.array(*_cells(width))).alias("lane", "cell"))
    full = met.groupBy("lane", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    at = F.col("cell") + 1  # Spark counts bitmap bits from 1
    pages = full.groupBy("lane", F.bitmap_bucket_number(at).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    bits = np.zeros((LANES, width // 8), np.uint8)
    for r in pages.collect():
        first = (r["page"] - 1) * PAGE // 8
        bits[r["lane"], first : first + PAGE // 8] = np.frombuffer(r["bits"], np.uint8)
    return width, bits


def screened(rows: DataFrame, n_prefixes: int) -> DataFrame:
    """``rows`` with ``alone``: the sketch's estimate of the prefix is 1."""
    width, bits = sketch(rows, n_prefixes)
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    kept = rows.columns

    def look_up(batches):
        table = shared.value
        for b in batches:
            several = np.ones(b.num_rows, bool)
            for i in range(LANES):
                cell = b.column(f"cell{i}").to_numpy()
                several &= (table[i, cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(~several)], [*kept, "alone"])

    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.select(*kept, *_cells(width)).mapInArrow(look_up, f"{fields}, alone boolean")


def _hash_ends(batches):
    """SHA-256 of the ids of each (conv_id, depth), met in order, as a stream."""
    now, state = None, None
    for b in batches:
        node, depth, ids = (b.column(i).to_numpy() for i in range(3))
        cuts = np.flatnonzero((np.diff(node) != 0) | (np.diff(depth) != 0)) + 1
        done = []
        for a, z in zip([0, *cuts], [*cuts, len(node)]):
            if a == z:
                continue
            key, text = (int(node[a]), int(depth[a])), ",".join(map(str, ids[a:z].tolist())).encode()
            if key == now:
                state.update(b"," + text)
                continue
            if now is not None:
                done.append((*now, state.hexdigest()))
            now, state = key, hashlib.sha256(text)
        yield _ends_table(done)
    if now is not None:
        yield _ends_table([(*now, state.hexdigest())])


def _ends_table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["conv_id", "depth", "ends_sha256"])


def trie_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes (``NODES``) of conversations given as ``conv_id, pos, turn_hash, words,
    tile`` and ``conv_id, n`` (also those without turns)."""
    whole = convs.agg(F.sum("n"), F.min("conv_id"), F.count(F.lit(1)), F.count_if(F.col("n") == 0)).first()
    n_prefixes, least, n_convs, n_blank = (whole[i] or 0 for i in range(4))
    rows = materialize(screened(materialize(prefixes(turns, convs)), n_prefixes))
    tails = rows.where("alone").groupBy("conv_id").agg(F.min("depth").alias("tail"))
    convs = materialize(convs.join(tails, "conv_id", "left"))
    rows = materialize(rows.drop("alone").join(convs, "conv_id"))

    # possibly shared prefixes, grouped exactly; all conversations are in the root
    maybe = rows.where("tail is null or depth < tail")
    groups = maybe.groupBy("depth", "x1", "x2").agg(
        F.min("conv_id").alias("head"), F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("ends")).alias("n_ends")
    )
    zero = F.lit(0).cast("long")
    root = convs.select(
        "conv_id", "n", "tail", zero.alias("depth"), zero.alias("words"), zero.alias("upto"), (F.col("n") == 0).alias("ends"),
        F.lit(least).cast("long").alias("head"), F.lit(n_convs).cast("long").alias("n_convs"), F.lit(n_blank).cast("long").alias("n_ends"),
    )
    members = materialize(maybe.join(groups, ["depth", "x1", "x2"]).drop("x1", "x2").unionByName(root))

    # of each conversation: the depth from which it is the smallest member, the words up
    # to there, and whether it is the smallest of a childless node
    own = F.col("conv_id") == F.col("head")
    known = members.groupBy("conv_id").agg(
        F.min(F.when(own, F.col("depth"))).alias("m"),
        F.coalesce(F.max(F.when(~own, F.col("upto"))), zero).alias("spared"),
        F.max(own & F.col("ends") & (F.col("n_ends") == F.col("n_convs"))).alias("leaf"),
    )
    full = members.join(known, "conv_id").withColumns(
        {"m": F.least("m", "tail"), "leaf": (F.col("leaf") | F.col("tail").isNotNull()).cast("long")}
    )
    full = materialize(full)
    child = (F.col("m") <= F.col("depth") + 1) & (F.col("depth") < F.col("n"))
    nodes = full.groupBy(F.col("head").alias("conv_id"), "depth").agg(
        F.max("n_convs").alias("n_convs"),
        F.count_if(child).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(zero, F.col("spared") - (F.col("upto") - F.col("words")))).alias("saved_tokens"),
    )
    below = full.where(child).select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("head").alias("parent_conv_id"), "n", "tail")
    ending = full.where("ends").select("head", "depth", "conv_id")
    ends = ending.repartition("head", "depth").sortWithinPartitions("head", "depth", "conv_id").mapInArrow(
        _hash_ends, "conv_id long, depth long, ends_sha256 string"
    )
    names = [c.split()[0] for c in NODES.split(", ")]
    inner = (
        nodes.join(below.select("conv_id", "depth", "parent_conv_id"), ["conv_id", "depth"], "left")
        .join(ends, ["conv_id", "depth"], "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
        .select(*names)
    )
    deeper = rows.where("depth > tail").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "n")
    alone = below.where("depth = tail").select(*deeper.columns).unionByName(deeper)
    last = F.col("depth") == F.col("n")
    ones = {"n_convs": F.lit(1).cast("long"), "n_children": (~last).cast("long"), "n_leaves": F.lit(1).cast("long"), "saved_tokens": zero}
    sha = F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY))
    return inner.unionByName(alone.withColumns(ones | {"ends_sha256": sha}).select(*names))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of (conv_id, turn, role, text) rows: one row per node (``NODES``)."""
    ordered = materialize(ordered_turns(conversations))
    return trie_nodes(ordered, ordered.groupBy("conv_id").agg(F.max("pos").alias("n")))


def node_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` of ``prefix_trie`` with ``role`` and ``text`` of their last turn."""
    ordered = ordered_turns(conversations).select("conv_id", F.col("pos").alias("depth"), "turn_hash")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn_hash = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    texts = conversations.select("conv_id", turn_hash.alias("turn_hash"), role.alias("role"), text.alias("text"))
    named = nodes.join(ordered, ["conv_id", "depth"], "left")
    return named.join(texts.dropDuplicates(["conv_id", "turn_hash"]), ["conv_id", "turn_hash"], "left").drop("turn_hash")


SQL = r"""
with t as (
  select conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} as x,
    row_number() over (partition by conv_id order by turn nulls first, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos
  from conversations where conv_id is not null),
c as (select conv_id, list(x order by pos) as own from t group by conv_id),
h as (
  select conv_id, own, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, length(s) + 1),
    lambda i: list_transform(range(0, 8), lambda k: cast((ascii(s[i]) >> k) & 1 as bigint))))),
    lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 4 as h
  from (select *, cast(conv_id as varchar) as s from c)),
b as (
  select h.conv_id, coalesce(c.own[1:h.h], []) || coalesce(h.own[h.h + 1:], []) as ts
  from h left join c on c.conv_id = h.conv_id - h.conv_id % 20),
m as (
  select conv_id, d, ts[1:d] as p, case when d > 0 then ts[1:d - 1] end as parent, d = len(ts) as ends,
    case when d > 0 then len(regexp_extract_all(ts[d].t, '[^\x20\x09-\x0D]+')) else 0 end as words
  from (select *, unnest(range(0, len(ts) + 1)) as d from b)),
node as (
  select d, p, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from m group by d, p),
kids as (select parent as p, count(*) as n_children from node where d > 0 group by parent),
below as (
  select a.p, count(*) filter (where k.p is null) as n_leaves, sum((v.n_convs - 1) * v.words) as saved_tokens
  from node a join node v on v.d >= a.d and v.p[1:a.d] = a.p left join kids k on k.p = v.p
  group by a.p)
select node.conv_id, cast(node.d as bigint) as depth, up.conv_id as parent_conv_id, node.n_convs,
  coalesce(n_children, 0) as n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, node.ends_sha256
from node left join kids on kids.p = node.p join below on below.p = node.p left join node up on up.p = node.parent
"""


@query("op11_conversation_prefix_trie", SQL)
def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = grafted(materialize(ordered_turns(table(spark, sf_dir, "conversations"))))
    return trie_nodes(turns, convs)
