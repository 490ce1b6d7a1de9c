"""Conversation prefix trie: which conversations share their first turns, by fixed-length block hashing.

A turn is the digest of its role and text. A conversation's turns lie in blocks of BLOCK turns; a prefix has a key of
two 62-bit sums of hashes of (depth, turn digest), so that the keys at the ends of blocks are running sums over blocks.
Conversations are grouped by the successive digests of their blocks first: copies of a block after the same prefix
become one row with a count, however many conversations have them. Where all that go on after a prefix have the same
block, its turns are nodes as they stand; only blocks whose siblings diverge are grouped again turn by turn.

Sums over subtrees need no rounds: a node belongs to its smallest member, so the nodes that belong to a conversation are
the end of its path; what they hold is summed once, and goes to every node above them on that path, by whole blocks
first. The lists of ends are joined in chunks of conversation ids and hashed chunk by chunk in order.

Skew: turns are numbered by (conversation, range of turn numbers) and gathered by (conversation, block); counts and sums
are partial aggregates; joins from children to a common parent are left to Spark's split of skewed joins. A running sum
over a conversation's blocks is one task's, a row a block.

Nulls and edge cases: rows without a conv_id take no part; a null turn comes first; a null role or text is empty; turns
with equal numbers are ordered by role, then text, and repeated rows are turns of their own; texts and conversations of
any length are read whole; an empty table has no nodes, not even the root; columns other than conv_id, turn, role and
text are ignored, whatever their names. Two different prefixes with equal keys would be one node: 124 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from levelframe.llm.common import saved, words_of, written

BLOCK = 4
#: Turn numbers, and conversation ids, that are gathered at once.
TURN_RANGE, ID_RANGE = 1024, 4096
MOST_HEAD = 3
KEY = (1 << 62) - 1
NODE = ["depth", "key1", "key2"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest and words of every turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("range", F.coalesce(F.floor(F.col("turn") / TURN_RANGE).cast("long"), F.lit(-(1 << 62))))
    inside = F.row_number().over(W.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.select("conv_id", "range", inside.alias("pos"), digest.alias("digest"), F.size(words_of(F.col("text"))).cast("long").alias("words"))
    counts = rows.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("conv_id", "range", before.alias("before"))
    return rows.join(counts, ["conv_id", "range"]).select("conv_id", (F.col("pos") + F.col("before")).alias("pos"), "digest", "words")


def rebuilt(turns: DataFrame, step: int = 20) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, words) and (conv_id, length) with the first h turns taken from conversation c - c % step.

    turns should be a saved table.
    """
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_HEAD + 1)).cast("int")
    convs = convs.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % step).alias("base"))
    first = turns.filter((F.col("pos") <= MOST_HEAD) & (F.col("conv_id") % step == 0)).groupBy(F.col("conv_id").alias("base"))
    heads = first.agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("head"))
    empty = F.array().cast("array<struct<pos:long,digest:string,words:long>>")
    convs = convs.join(heads, "base", "left").select("conv_id", "n", "h", F.slice(F.coalesce("head", empty), F.lit(1), F.col("h")).alias("head"))
    convs = saved(convs)
    lengths = convs.select("conv_id", (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length"))
    head = convs.select("conv_id", F.posexplode("head").alias("at", "t")).select("conv_id", (F.col("at") + 1).cast("long").alias("depth"), "t.digest", "t.words")
    own = turns.join(convs.select("conv_id", "h", F.size("head").alias("k")), "conv_id").filter("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).cast("long").alias("depth"), "digest", "words")
    return head.unionByName(own), lengths


def _blocks(turns: DataFrame) -> DataFrame:
    """conv_id, block, before1, before2 (the key before the block), digest, and turns: (depth, words, key1, key2)."""
    added = [F.xxhash64(F.lit(k), "depth", "digest").bitwiseAND(F.lit(KEY)).alias(f"h{k}") for k in (1, 2)]
    rows = turns.select("conv_id", F.expr(f"(depth - 1) div {BLOCK}").alias("block"), F.struct("depth", "digest", "words", *added).alias("t"))
    rows = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("t")).alias("t"))  # BLOCK turns at most
    upto = lambda field, end: F.aggregate(F.slice("t", F.lit(1), end), F.lit(0).cast("long"), lambda s, x: (s + x[field]).bitwiseAND(F.lit(KEY)))
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({f"s{k}": upto(f"h{k}", F.size("t")) for k in (1, 2)})
    rows = rows.withColumns({f"before{k}": F.coalesce(F.pmod(F.sum(F.col(f"s{k}").cast("decimal(38,0)")).over(earlier), F.lit(KEY + 1).cast("decimal(38,0)")).cast("long"), F.lit(0).cast("long")) for k in (1, 2)})

    def key(k: int, i: Column) -> Column:
        return (F.col(f"before{k}") + upto(f"h{k}", i)).bitwiseAND(F.lit(KEY)).alias(f"key{k}")

    keyed = F.transform("t", lambda x, i: F.struct(x["depth"].alias("depth"), x["words"].alias("words"), key(1, i + 1), key(2, i + 1)))
    digest = F.sha2(F.array_join(F.transform("t", lambda x: x["digest"]), ""), 256)
    return rows.select("conv_id", "block", "before1", "before2", digest.alias("digest"), keyed.alias("turns"))


EDGE = ["block", "before1", "before2", "digest"]


def _turn_rows(edges: DataFrame, *keep: str) -> DataFrame:
    """The turns of blocks as nodes, with the key of the node above."""
    rows = edges.select(*keep, "before1", "before2", "turns", F.posexplode("turns").alias("i", "t"))
    above = [F.when(F.col("i") == 0, F.col(f"before{k}")).otherwise(F.col("turns")[F.col("i") - 1][f"key{k}"]).alias(f"above{k}") for k in (1, 2)]
    return rows.select("t.depth", "t.key1", "t.key2", *above, "t.words", *keep)


def _nodes(blocks: DataFrame, lengths: DataFrame) -> DataFrame:
    """depth, key1, key2, above1, above2, words, n_convs, conv_id of every node, the root included."""
    edges = saved(blocks.groupBy(*EDGE).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns")))
    after = edges.groupBy("block", "before1", "before2").agg(F.count(F.lit(1)).alias("ways"), F.first(F.struct("n_convs", "conv_id", "turns")).alias("e"))
    alone = _turn_rows(after.filter("ways = 1").select("before1", "before2", "e.*"), "n_convs", "conv_id")
    parting = edges.join(after.filter("ways > 1").select("block", "before1", "before2"), ["block", "before1", "before2"], "left_semi")
    refined = _turn_rows(parting, "n_convs", "conv_id").groupBy(*NODE).agg(
        F.first("above1").alias("above1"), F.first("above2").alias("above2"), F.first("words").alias("words"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id")
    )
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    root = lengths.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("key1"), zero.alias("key2"), none.alias("above1"), none.alias("above2"), zero.alias("words"), "n_convs", "conv_id")
    return alone.unionByName(refined).unionByName(root)


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's list of ids, from its chunks in order; a node's chunks lie in one partition."""
    node, digest, out = None, None, []

    def rows(found: list) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [[]] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*NODE, "ends_sha256"])

    for batch in batches:
        for *now, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
            if now != node:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = now, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield rows(out)
        out = []
    if node is not None:
        yield rows([(*node, digest.hexdigest())])


def _ends(blocks: DataFrame, lengths: DataFrame) -> DataFrame:
    """depth, key1, key2, ends_sha256 of the nodes at which conversations end."""
    last = F.element_at("turns", -1)
    ended = blocks.select("conv_id", last.alias("t")).join(lengths, "conv_id").filter(F.col("t.depth") == F.col("length")).select("conv_id", "t.depth", "t.key1", "t.key2")
    zero = F.lit(0).cast("long")
    turnless = lengths.filter("length = 0").select("conv_id", zero.alias("depth"), zero.alias("key1"), zero.alias("key2"))
    chunk = F.floor(F.col("conv_id") / ID_RANGE).alias("chunk")
    rows = ended.unionByName(turnless).groupBy(*NODE, chunk).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))  # ID_RANGE ids at most
    rows = rows.select(*NODE, "chunk", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    return rows.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").mapInArrow(_joined_ids, "depth long, key1 long, key2 long, ends_sha256 string")


def _below(blocks: DataFrame, owners: DataFrame) -> DataFrame:
    """depth, key1, key2, saved, leaves: what other conversations' own nodes add to the nodes above them.

    owners: conv_id, top (depth of its first own node, over 0), saved, leaves (sums over its own nodes).
    """
    sums = [F.sum(c).alias(c) for c in ("saved", "leaves")]
    above = blocks.join(owners, "conv_id").filter(F.col("turns")[0]["depth"] < F.col("top"))
    whole = F.element_at("turns", -1)["depth"] < F.col("top")
    by_block = above.filter(whole).groupBy(*EDGE).agg(*sums, F.first("turns").alias("turns"))
    by_block = by_block.select(F.explode("turns").alias("t"), "saved", "leaves")
    within = above.filter(~whole).select(F.explode(F.filter("turns", lambda t: t["depth"] < F.col("top"))).alias("t"), "saved", "leaves")
    rows = by_block.unionByName(within).select("t.depth", "t.key1", "t.key2", "saved", "leaves")
    zero = F.lit(0).cast("long")
    root = owners.select(zero.alias("depth"), zero.alias("key1"), zero.alias("key2"), "saved", "leaves")
    return rows.unionByName(root).groupBy(*NODE).agg(*sums)


def trie(conversations: DataFrame, step: int = 20) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, lengths = rebuilt(written(numbered_turns(conversations)), step)
    blocks = written(_blocks(turns))
    nodes = written(_nodes(blocks, lengths))
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above1").alias("key1"), F.col("above2").alias("key2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    # a conversation's own nodes, from its end up
    own = W.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, 0)
    saved_here, leaf = (F.col("n_convs") - 1) * F.col("words"), F.when(F.col("n_children") == 0, 1).otherwise(0)
    nodes = written(nodes.withColumns({"own_saved": F.sum(saved_here).over(own), "own_leaves": F.sum(leaf).over(own)}))
    top = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("own_saved").alias("saved"), F.max("own_leaves").alias("leaves"))
    below = _below(blocks, saved(top.filter("top > 0")))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key1").alias("above1"), F.col("key2").alias("above2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(below, NODE, "left").join(_ends(blocks, lengths), NODE, "left").join(above, ["depth", "above1", "above2"], "left")
    total = lambda own, more: (F.col(own) + F.coalesce(F.col(more), F.lit(0))).cast("long")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", total("own_leaves", "leaves").alias("n_leaves"), total("own_saved", "saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from levelframe.session import table

    return trie(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i)
  )
),
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t), tab
),
r AS (
  SELECT c.conv_id, t.pos AS k, digest, words FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 3 + t.pos AS k, digest, words FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h
),
n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS depth, digest, words FROM r),
m AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS depth, '' AS path, CAST(0 AS BIGINT) AS words, CAST(NULL AS VARCHAR) AS above FROM c
  UNION ALL SELECT m.conv_id, n.depth, sha256(m.path || n.digest), n.words, m.path FROM m JOIN n ON n.conv_id = m.conv_id AND n.depth = m.depth + 1
),
ends AS (SELECT conv_id, arg_max(path, depth) AS path FROM m GROUP BY conv_id),
lists AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM ends GROUP BY path),
nodes AS (SELECT path, any_value(depth) AS depth, any_value(above) AS above, any_value(words) AS words, count(*) AS n_convs, min(conv_id) AS conv_id FROM m GROUP BY path),
kids AS (SELECT above AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above),
under AS (SELECT DISTINCT a.path, b.path AS low FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (
  SELECT u.path, CAST(sum((x.n_convs - 1) * x.words) AS BIGINT) AS saved_tokens, CAST(sum(CASE WHEN k.path IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves
  FROM under u JOIN nodes x ON x.path = u.low LEFT JOIN kids k ON k.path = u.low GROUP BY u.path
)
SELECT nodes.conv_id, nodes.depth, p.conv_id AS parent_conv_id, nodes.n_convs, coalesce(kids.n_children, 0) AS n_children, sums.n_leaves, sums.saved_tokens, coalesce(lists.ends_sha256, sha256('')) AS ends_sha256
FROM nodes JOIN sums ON sums.path = nodes.path LEFT JOIN kids ON kids.path = nodes.path LEFT JOIN lists ON lists.path = nodes.path LEFT JOIN nodes p ON p.path = nodes.above
"""
