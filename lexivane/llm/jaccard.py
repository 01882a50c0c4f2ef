"""Links between texts by Jaccard similarity of word n-grams, and their components.

Adaptive multi-match prefixes. A text's n-grams, in the order of their hashes, are cut
to a prefix: two texts at the threshold share at least l n-grams in their first
``size - needed + l``. An n-gram in more than ``HOT`` sets is hot and is not looked up;
a prefix with h hot entries is lengthened until l - h matches of others must remain.
Beyond that each text lengthens its prefix by the number of extra matches with the
least estimated cost: entries read, and candidates, of which each needs all matches.

1. One pass over the texts makes a set's identity and its n-grams below a fixed hash, the
   region, where frequencies are counted over all sets. Equal sets are one node. The
   region is somewhat wider (``MARGIN``) than most prefixes are long.
2. Nodes whose prefix ends there are done. The others (short, or with many hot
   entries) read the rest of their n-grams, counted among themselves; no other node
   has a prefix that reaches so far, so all nodes agree on what is hot.
3. Nodes that share enough entries are candidates. A list holds at most ``HOT`` nodes.
4. Nodes with too few entries that are not hot even in their whole set (families of
   many near copies) are candidates of each other where they share an entry that is not
   hot in their shortest prefixes. By hot entries there they are joined by a few pivots; those still apart from the largest
   component of their family are compared with all of the family, block by block.
5. Candidates are verified on their whole sets; nodes known to be connected by a first
   round of one candidate each are not verified again.

Null or empty texts have no n-grams, link with nothing and are their own component.
Null ids: such rows join sets as others do, and never give their component its id; a
component of null ids only has the id null. Repeated rows are equal sets. An empty
table gives no rows. Columns of other names are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.llm import hashing
from lexivane.llm.common import fresh, query, table
from lexivane.llm.components import components
from lexivane.session import bounded_broadcast, materialize, settled, ship_package

HOT = 32
MARGIN = 1.45  # the region is this often the share of a set that its shortest prefix takes
MOST = (1 << 31) - 1  # the ``l`` of dense nodes
EXTRA = (0, 2, 5)  # extra matches that a prefix may ask for
VERIFY = 8.0  # cost of a candidate, in list entries
HASHES = 1 << 63
PIVOT_ROUNDS, PIVOT_LISTS = 3, 4
BLOCK = 512  # nodes of a side of a block
SLICE = 4096  # entries that a matrix product takes at once


def _sets(words: int, low: float, high: float):
    """doc_id, text -> doc_id, node, n, below, toks: the n-grams within a hash region.

    ``node`` identifies the whole set, ``below`` counts its n-grams below the region.
    """

    def run(batches):
        a, z = int(low * HASHES), int(high * HASHES)
        for batch in batches:
            node, size, below, toks, at = [], [], [], [], [0]
            for _, h, _, _ in hashing.batch_words(batch.column("text")):
                s = np.unique(hashing.grams(h, words))
                i, j = np.searchsorted(s, (a, z))
                own = s[i:] if high >= 1 else s[i:j]
                total = hashing.mix(s.astype(np.uint64)).sum(dtype=np.uint64) + np.uint64(len(s))
                node.append(int(hashing.mix(total.reshape(1))[0] >> np.uint64(1)))
                size.append(len(s))
                below.append(int(i))
                toks.append(own)
                at.append(at[-1] + len(own))
            flat = np.concatenate(toks) if toks else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(below, pa.int64()), lists],
                ["doc_id", "node", "n", "below", "toks"],
            )

    return run


def token_sets(docs: DataFrame, words: int, low: float, high: float) -> DataFrame:
    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_sets(words, low, high), f"doc_id {kind}, node bigint, n bigint, below bigint, toks array<bigint>")


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("x", "y"))
            nx, ny = (np.append(0, np.cumsum(batch.column(c).value_lengths().to_numpy(zero_copy_only=False))) for c in ("x", "y"))
            keep = []
            for k in range(batch.num_rows):
                p, q = x[nx[k] : nx[k + 1]], y[ny[k] : ny[k + 1]]
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                same = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(q) else 0
                keep.append(100 * same >= percent * (len(p) + len(q) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets reach the threshold."""
    x = sets.select(F.col("node").alias("a"), F.col("toks").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("toks").alias("y"))
    return materialize(pairs.select("a", "b").join(x, "a").join(y, "b").mapInArrow(_verify(percent), "a bigint, b bigint"))


def _spare(n: Column, percent: int) -> Column:
    """Prefix length that leaves at least one shared n-gram: size - needed + 1."""
    return n - F.ceil(n * F.lit(percent) / F.lit(100)) + 1


def _planned(nodes: DataFrame, percent: int) -> DataFrame:
    """Chooses each node's prefix. Adds ``p`` (its end, null if beyond ``known``),
    ``l`` (shared n-grams it implies) and ``k`` (of these, not hot at least).

    ``nodes``: node, n, known (entries whose frequency is known), hits (pos, tok, df
    of those in two sets or more).
    """
    hot = F.sort_array(F.transform(F.filter("hits", lambda h: h["df"] > HOT), lambda h: h["pos"]))

    def option(extra: int) -> Column:
        start = (_spare(F.col("n"), percent) + extra).cast("int")
        end = F.aggregate("__hot", start, lambda p, x: F.when(x < p, p + 1).otherwise(p))
        read = F.aggregate(
            F.filter("hits", lambda h: (h["df"] <= HOT) & (h["pos"] < end)), F.lit(0).cast("bigint"), lambda s, h: s + h["df"] - 1
        )
        cost = read * (1 + VERIFY / (1 + extra))
        fits = end <= F.col("known")
        return F.when(
            fits,
            F.struct(cost.alias("cost"), end.alias("p"), (end - start + 1 + extra).cast("int").alias("l"), F.lit(1 + extra).alias("k")),
        )

    return nodes.withColumn("__hot", hot).withColumn("__o", F.least(*[option(e) for e in EXTRA])).select(
        "node", "n", "label", "known", "hits", "__o.p", "__o.l", "__o.k"
    )


def _hits(tokens: DataFrame) -> DataFrame:
    """tokens (node, pos, tok) -> node, hits: those found in two nodes or more."""
    df = tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return tokens.join(df, "tok").groupBy("node").agg(F.collect_list(F.struct("pos", "tok", "df")).alias("hits"))


def _positions(nodes: DataFrame, first: Column) -> DataFrame:
    return nodes.select("node", first.alias("first"), F.posexplode("toks").alias("i", "tok")).select(
        "node", (F.col("i") + F.col("first")).cast("int").alias("pos"), "tok"
    )


def _with_hits(nodes: DataFrame, hits: DataFrame) -> DataFrame:
    empty = F.array().cast("array<struct<pos:int,tok:bigint,df:bigint>>")
    return nodes.join(hits, "node", "left").withColumn("hits", F.coalesce("hits", empty))


def _list_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Candidates from lists of at most HOT nodes: pairs with enough shared entries.

    Of two dense nodes one ``early`` entry is enough: their first shared n-gram is in the
    shortest prefix of both, so it is met here or, if it is hot, in a long list.
    """
    lists = entries.groupBy("tok").agg(F.sort_array(F.collect_set(F.struct("node", "n", "l", "k", "early"))).alias("s")).where("size(s) > 1")
    x = lists.select("s", F.explode("s").alias("x"))
    y = x.select("x", F.explode(F.filter("s", lambda e: e["node"] > F.col("x.node"))).alias("y"))
    fit = (F.least("x.n", "y.n") * 100) >= (F.greatest("x.n", "y.n") * percent)
    asked = (
        F.when(F.col("x.l") < F.col("y.l"), F.col("x.k"))
        .when(F.col("y.l") < F.col("x.l"), F.col("y.k"))
        .otherwise(F.greatest("x.k", "y.k"))
    )
    return (
        y.where(fit & ((F.least("x.l", "y.l") < MOST) | (F.col("x.early") & F.col("y.early"))))
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), asked.alias("asked"))
        .groupBy("a", "b", "asked")
        .count()
        .where("count >= asked")
        .select("a", "b")
    )


def similar_sets(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``docs``."""
    region = min(1.0, MARGIN * (100 - percent) / 100)
    rows = materialize(token_sets(docs, words, 0.0, region))
    nodes = materialize(
        rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("label"), F.first("n").alias("n"), F.first("toks").alias("toks"))
    )
    near = materialize(
        _planned(
            _with_hits(
                nodes.select("node", "n", "label", F.size("toks").alias("known")), _hits(_positions(nodes, F.lit(0)))
            ),
            percent,
        )
    )
    open_ = near.where("p is null")
    own = docs.select("doc_id", "text")
    # texts of the nodes that need more than the region
    far_sets = materialize(
        token_sets(_rows_of(own, open_), words, region, 1.0)
        .groupBy("node")
        .agg(F.first("below").alias("below"), F.first("toks").alias("toks"))
        .join(open_.select("node"), "node", "left_semi")
    )
    more = _hits(_positions(far_sets, F.col("below"))).withColumnRenamed("hits", "more")
    whole = open_.join(more, "node", "left").select(
        "node", "n", "label", F.col("n").cast("int").alias("known"),
        F.concat("hits", F.coalesce("more", F.array().cast("array<struct<pos:int,tok:bigint,df:bigint>>"))).alias("hits"),
    )
    far = materialize(_planned(whole, percent))
    dense = far.where("p is null")
    every = near.where("p is not null").union(far.where("p is not null")).union(
        dense.select("node", "n", "label", "known", "hits", F.col("n").cast("int"), F.lit(MOST), F.lit(1))
    )
    entries = every.select("node", "n", "l", "k", F.explode(F.filter("hits", lambda h: (h["df"] <= HOT) & (h["pos"] < F.col("p")))).alias("h"))
    early = (F.col("h.pos") < _spare(F.col("n"), percent)).alias("early")
    pairs = materialize(_list_pairs(entries.select("node", "n", "l", "k", early, F.col("h.tok").alias("tok")), percent))
    long_ = F.sort_array(F.filter("hits", lambda h: (h["df"] > HOT) & (h["pos"] < _spare(F.col("n"), percent))))
    lists = materialize(
        dense.select("node", "n", F.posexplode(long_).alias("nth", "h")).select("node", "n", "nth", F.col("h.tok").alias("tok"))
    )
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(lists.select("node")).distinct()
    wanted = materialize(nodes.select("node", "label").join(involved, "node", "left_semi"))
    sets = materialize(
        token_sets(_rows_of(own, wanted), words, 0.0, 1.0)
        .groupBy("node")
        .agg(F.first("toks").alias("toks"))
        .join(wanted.select("node"), "node", "left_semi")
    )

    # one candidate per node first; then those that are still apart
    links = verified(pairs.groupBy("b").agg(F.min("a").alias("a")), sets, percent)
    found = components(links)
    apart = _apart(pairs, found)
    links = links.union(verified(apart, sets, percent))
    found = components(links)
    links = materialize(_dense_links(lists, sets, links, found, percent))
    found = components(links)

    roots = materialize(nodes.select("node", "label").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")))
    ids = roots.groupBy("root").agg(F.min("label").alias("component_id"))
    named = roots.join(ids, "root").select("node", "component_id")
    return (
        rows.select("doc_id", "node", "n")
        .join(named, "node", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", F.when(F.col("n") == 0, F.col("doc_id"))).alias("component_id"))
    )


def _mixed(lists: DataFrame, found: DataFrame) -> DataFrame:
    """The lists whose nodes are not all in one component, with ``comp``."""
    at = lists.join(found, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    apart = at.groupBy("tok").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("tok")
    return at.join(apart, "tok")


def _dense_links(lists: DataFrame, sets: DataFrame, links: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """``links`` and those between nodes of long lists (node, n, pos, tok).

    A few rounds join most of a family by pivots of some of its lists. What is still
    apart is compared by blocks of a family: the nodes outside its largest component
    with all of its nodes. Blocks count shared entries as matrix products and give
    links only, so pairs are never rows.
    """
    starts = lists.where(F.col("nth") < PIVOT_LISTS).select("node", "n", "tok")
    for step in range(PIVOT_ROUNDS):
        at = materialize(_mixed(starts, found))
        draw = F.xxhash64("node", F.lit(step))  # other members become the pivots
        chosen = at.groupBy("tok", F.pmod(draw, F.lit(1 << step)).alias("part"))
        pivots = chosen.agg(F.min_by(F.struct("node", "n", "comp"), draw).alias("q")).select("tok", "q")
        put = at.join(pivots, "tok").where("q.comp <> comp")
        put = put.where((F.least("n", "q.n") * 100) >= (F.greatest("n", "q.n") * percent))
        tried = put.select(F.least("node", "q.node").alias("a"), F.greatest("node", "q.node").alias("b")).distinct()
        links = materialize(links.union(verified(tried, sets, percent)))
        found = components(links)

    at = materialize(_mixed(lists.select("node", "n", "tok"), found))
    heads = at.groupBy("tok").agg(F.min("node").alias("b"))
    families = components(at.join(heads, "tok").select(F.col("node").alias("a"), "b"))
    members = at.select("node", "comp").distinct().join(families.withColumnRenamed("root", "family"), "node")
    sizes = members.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("m"))
    largest = sizes.groupBy("family").agg(F.max_by("comp", F.struct("m", "comp")).alias("most"), F.sum("m").alias("m"), F.max("m").alias("k"))
    placed = materialize(members.join(largest, "family"))

    def blocks(rows: DataFrame, own: Column, other: Column, side: str) -> DataFrame:
        """Each node once for each block of the other side; a side has size / BLOCK parts."""
        n, m = F.ceil(own / F.lit(BLOCK)), F.ceil(other / F.lit(BLOCK))
        mine = F.pmod(F.xxhash64("node"), n)
        names = ("i", "j") if side == "L" else ("j", "i")
        keyed = rows.select("family", "node", "comp", mine.alias(names[0]), F.explode(F.sequence(F.lit(0).cast("bigint"), m - 1)).alias(names[1]))
        return keyed.select("family", "i", "j", "node", "comp", F.lit(side).alias("side"))

    few, all_ = F.col("m") - F.col("k"), F.col("m")
    left = blocks(placed.where("comp <> most"), few, all_, "L")
    right = blocks(placed, all_, few, "R")
    dealt = left.union(right).join(sets, "node")
    more = dealt.groupBy("family", "i", "j").applyInArrow(_block_links(percent), "a bigint, b bigint")
    return links.union(more)


def _block_links(percent: int):
    def run(block: pa.Table) -> pa.Table:
        side = np.array(block.column("side").to_pylist())
        node, comp = (block.column(c).to_numpy() for c in ("node", "comp"))
        lists = block.column("toks").combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        toks, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
        left, right = np.flatnonzero(side == "L"), np.flatnonzero(side == "R")
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        words, code = np.unique(toks, return_inverse=True)
        is_left = side[row] == "L"
        both = np.zeros((2, len(words)), bool)
        both[0, code[is_left]], both[1, code[~is_left]] = True, True
        new = np.cumsum(both.all(0)) - 1  # only words of both sides can be shared
        keep = both.all(0)[code]
        code, row = new[code[keep]], row[keep]
        place = np.zeros(len(size), np.int64)
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        same = np.zeros((len(left), len(right)))
        order = np.argsort(code, kind="stable")
        code, row = code[order], row[order]
        edge = np.searchsorted(code, np.arange(0, int(code[-1]) + 1 + SLICE, SLICE)) if len(code) else [0]
        for a, z in zip(edge[:-1], edge[1:]):
            low = code[a] if z > a else 0
            x, y = np.zeros((len(left), SLICE), np.float32), np.zeros((len(right), SLICE), np.float32)
            own, is_l = row[a:z], side[row[a:z]] == "L"
            at = code[a:z] - (low // SLICE) * SLICE
            x[place[own[is_l]], at[is_l]] = 1
            y[place[own[~is_l]], at[~is_l]] = 1
            same += x @ y.T
        total = size[left][:, None] + size[right][None, :]
        apart = comp[left][:, None] != comp[right][None, :]
        l, r = np.nonzero(apart & (100 * same >= percent * (total - same)))
        # one link for each two components is enough
        _, one = np.unique(np.stack([comp[left[l]], comp[right[r]]]), axis=1, return_index=True)
        a, b = node[left[l[one]]], node[right[r[one]]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with the least id of their component, once each, with all
    their columns. Rows with a null id stay where their component has no other id."""
    own = fresh(docs, "keep")

    def heads() -> DataFrame:
        ids = similar_sets(docs, words, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        return ids.select(F.col("doc_id").alias(own)).distinct()

    keep = settled(docs.sparkSession, heads)
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi").dropDuplicates(["doc_id", "text"])


def _rows_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows whose id is the label of one of ``nodes`` (rows of other sets among them)."""
    own = fresh(docs, "label")
    labels = bounded_broadcast(nodes.select(F.col("label").alias(own)).distinct())
    return docs.join(labels, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends are not known to be connected."""
    a = found.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = found.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return (
        pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    )


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) end) as g
  from w),
n as (select doc_id, cast(len(g) as bigint) as n_shingles from s),
t as (select doc_id, hash(unnest(g)) as x from s),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as same from t a join t b on a.x = b.x and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id),
link as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b
  where 100 * same >= 85 * (x.n_shingles + y.n_shingles - same)),
reach(doc_id, low) as (
  select doc_id, doc_id from n
  union
  select link.b, reach.low from reach join link on link.a = reach.doc_id)
select doc_id, any_value(n_shingles) as n_shingles, min(low) as component_id from reach join n using (doc_id) group by doc_id
"""


@query("op9_ngram_jaccard_join", SQL)
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"), words=4, percent=85)
