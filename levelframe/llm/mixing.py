"""Mixing sources to target weights by blocks.

A source's target number of words comes from weights, a budget and a limit on repeats. Its documents are dealt by
hash to about sqrt(n) blocks. The mix takes whole passes over a source as often as they fit, then its permuted
blocks in turn up to the block in which the target lies, and in that block the documents in hash order up to the
one nearest to the target. So a document's fate follows from four numbers of its source and its own hash.

The draws (block and pass) go to output shards by a splitting tree: each node splits its draws among its two halves
by ranking them by a fresh hash, which makes the sources' counts in a half multivariate hypergeometric; the leaves
give exact quotas of each source for each shard. Each source then deals its permuted blocks to the shards by these
quotas, and every shard orders its documents by hash.

Nulls and edge cases: a null or empty text has size 0 and is taken with its block; a null source is a source of its
own, last in order; repeated rows share their hash and their fate; so do documents of
equal hash; a text of any length is counted whole; an empty table gives an empty mix; other columns
are kept by mixed() and ignored by taken().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from levelframe.llm.common import numbered, saved, small_enough

#: Weights of the sources in the order of their names, over and over.
WEIGHTS = (5, 2, 1)
#: The mix holds so much of all words.
BUDGET = 1.5
#: No source, and so no document, is taken more often.
MAX_REPEATS = 2
SHARDS = 64
SEED = 11


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _hash(*parts) -> Column:
    return F.xxhash64(F.lit(SEED), *parts)


def measured(docs: DataFrame, keep: list) -> DataFrame:
    """keep, and __source, size and the document's hash."""
    return docs.select(*keep, F.col("source").alias("__source"), word_count(F.col("text")).alias("__size"), _hash("doc_id", F.crc32("text"), F.xxhash64("text")).alias("__hash"))


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = MAX_REPEATS) -> DataFrame:
    """(__source, n, source_size, target) of (__source, __size) rows: shares by weight, held down to repeats times
    the source's size, the excess reshared until none is above.

    Sources that are held down are those with the least room for their weight, so that one pass over the sources
    in that order finds the share of the others. One row a source: small.
    """
    per = sizes.groupBy("__source").agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("source_size"))
    place = (F.row_number().over(W.orderBy(F.col("__source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), place + 1))
    per = per.withColumn("room", repeats * F.col("source_size") / F.col("w"))
    order = W.orderBy("room", F.col("__source").asc_nulls_last())
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    held = F.coalesce(F.sum(repeats * F.col("source_size")).over(before), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    share = (budget * F.sum("source_size").over(everything) - held) / rest
    per = per.withColumn("share", share)
    level = F.min(F.when(F.col("share") <= F.col("room"), F.struct("room", "share"))).over(everything)["share"]
    target = F.least((repeats * F.col("source_size")).cast("double"), F.coalesce(level * F.col("w"), F.lit(float("inf"))))
    return per.select("__source", "n", "source_size", target.alias("target"))


def _bucket(buckets: Column) -> Column:
    return F.pmod(F.xxhash64("__hash"), buckets)


def plan(measures: DataFrame) -> DataFrame:
    """One row a source: its target, whole passes, number of blocks, and the block and hash up to which it is
    taken once more."""
    per = saved(
        targets(measures)
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn("buckets", F.ceil(F.sqrt("n")))
    )
    same = measures["__source"].eqNullSafe(per["__source"])
    dealt = measures.join(small_enough(per.select("__source", "buckets")), same).select(measures["__source"], "__size", "__hash", _bucket(F.col("buckets")).alias("block"))
    blocks = dealt.groupBy("__source", "block").agg(F.sum("__size").alias("words"))
    # the block in which the rest ends
    ends = F.sum("words").over(W.partitionBy("__source").orderBy("block"))
    edge = blocks.withColumn("before", ends - F.col("words")).alias("b").join(per.alias("p"), F.col("b.__source").eqNullSafe(F.col("p.__source")))
    edge = edge.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))).select("p.__source", "block", (F.col("rest") - F.col("before")).alias("left"))
    inside = dealt.alias("d").join(small_enough(edge).alias("e"), F.col("d.__source").eqNullSafe(F.col("e.__source")) & (F.col("d.block") == F.col("e.block"))).select("e.__source", "e.block", "left", "__size", "__hash")
    upto = F.sum("__size").over(W.partitionBy("__source").orderBy("__hash"))
    last = inside.withColumn("upto", upto).filter(F.col("upto") - F.col("__size") / 2 <= F.col("left")).groupBy("__source").agg(F.max("__hash").alias("edge_hash"))
    edge = edge.alias("e").join(last.alias("l"), F.col("e.__source").eqNullSafe(F.col("l.__source")), "left").select("e.__source", F.col("block").alias("edge_block"), "edge_hash")
    return saved(per.alias("p").join(edge.alias("e"), F.col("p.__source").eqNullSafe(F.col("e.__source")), "left").select("p.*", "edge_block", "edge_hash"))


def with_copies(rows: DataFrame, per: DataFrame) -> DataFrame:
    """rows (with __source, __hash) and the columns of the plan, the row's block and how often it is taken.

    A source that takes no block more has passes alone.
    """
    p = small_enough(per.withColumnRenamed("__source", "__of"))
    out = rows.join(p, F.col("__source").eqNullSafe(F.col("__of")), "left").drop("__of").withColumn("block", _bucket(F.col("buckets")))
    more = (F.col("block") < F.col("edge_block")) | ((F.col("block") == F.col("edge_block")) & (F.col("__hash") <= F.col("edge_hash")))
    return out.withColumn("copies", (F.col("passes") + F.coalesce(more, F.lit(False)).cast("long")).cast("long"))


def shard_quotas(draws: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(__source, shard, quota) by the splitting tree over (__source, block, pass): about sqrt(n) rows a source."""
    depth = max(1, (shards - 1).bit_length())
    nodes = draws.select("__source", "block", "pass", F.lit(0).alias("node"))
    width = 1 << depth
    for level in range(depth):
        # ranks without gathering a node's draws in one task: near the root a node has those of all sources
        nodes = saved(nodes)
        totals = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("total"))
        ranked = numbered(nodes, ["node"], _hash(F.lit(level), "__source", "block", "pass"), "rank").join(F.broadcast(totals), "node")
        # leaves beyond the shards get nothing: split by the number of real shards on either side
        half = width >> (level + 1)
        first = F.col("node") * (2 * half)
        left = F.least(F.lit(shards), first + half) - first
        right = F.greatest(F.lit(0), F.least(F.lit(shards), first + 2 * half) - first - half)
        goes_left = F.col("rank") < F.round(F.col("total") * left / (left + right))
        nodes = ranked.select("__source", "block", "pass", (F.col("node") * 2 + F.when(goes_left, 0).otherwise(1)).alias("node"))
    return nodes.groupBy("__source", F.col("node").alias("shard")).agg(F.count(F.lit(1)).alias("quota"))


def dealt_draws(measures: DataFrame, per: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(__source, block, pass, shard): every draw of a block in its output shard."""
    draws = saved(with_copies(measures.select("__source", "__hash"), per).groupBy("__source", "block").agg(F.max("copies").alias("copies")).filter("copies > 0").select("__source", "block", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("pass")))
    quotas = shard_quotas(draws, shards)
    by = W.partitionBy("__source")
    quotas = quotas.withColumn("end", F.sum("quota").over(by.orderBy("shard"))).select(F.col("__source").alias("__of"), "shard", (F.col("end") - F.col("quota")).alias("start"), "end")
    place = F.row_number().over(by.orderBy(_hash(F.lit("deal"), "block", "pass"), "block", "pass")) - 1
    ranked = draws.withColumn("place", place)
    return ranked.join(quotas, F.col("__source").eqNullSafe(F.col("__of")) & (F.col("place") >= F.col("start")) & (F.col("place") < F.col("end"))).select("__source", "block", "pass", "shard")


def _dealt(docs: DataFrame, shards: int) -> DataFrame:
    """(__row, mix_pass, mix_shard, mix_key): each document as often as its block's draws take it."""
    slim = saved(measured(docs, []))
    per = plan(slim)
    deals = saved(dealt_draws(slim, per, shards)).withColumnRenamed("block", "__block").withColumnRenamed("__source", "__of")
    rows = with_copies(measured(docs, [F.struct(*docs.columns).alias("__row")]), per).filter("copies > 0")
    rows = rows.select("__row", "__source", "__hash", "block", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("mix_pass"))
    same = F.col("__source").eqNullSafe(F.col("__of")) & (F.col("block") == F.col("__block")) & (F.col("mix_pass") == F.col("pass"))
    rows = rows.join(small_enough(deals), same)
    return rows.select("__row", "mix_pass", F.col("shard").alias("mix_shard"), _hash(F.lit("order"), "__hash", "mix_pass").alias("mix_key"))


def mixed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The mix: each document as often as it is taken, with its output shard and a key to order the shard by.

    Columns: those of docs, then mix_pass, mix_shard, mix_key.
    """
    return _dealt(docs, shards).select("__row.*", "mix_pass", "mix_shard", "mix_key")


def mix_of(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of the mix with the columns of docs alone, shard by shard in the order of their keys: documents that
    are taken twice come twice."""
    return _dealt(docs, shards).orderBy("mix_shard", "mix_key").select("__row.*")


def reported(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """How many words of each document the dealt draws take, with its source's size and target, and the shard of each
    pass."""
    measures = saved(measured(docs, ["doc_id"]))
    per = plan(measures)
    deals = dealt_draws(measures, per, shards).groupBy("__source", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("draws"))
    deals = saved(deals).withColumnRenamed("block", "__block").withColumnRenamed("__source", "__of")
    rows = with_copies(measures, per)
    rows = rows.join(small_enough(deals), F.col("__source").eqNullSafe(F.col("__of")) & (F.col("block") == F.col("__block")), "left")
    own = F.transform(F.filter("draws", lambda d: d["pass"] <= F.col("copies")), lambda d: d["shard"])
    rows = rows.withColumn("shards", F.coalesce(own, F.array().cast("array<int>")))
    return rows.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.size("shards") * F.col("__size")).alias("taken"), "shards")


def taken(docs: DataFrame) -> DataFrame:
    """reported() without the shards."""
    return reported(docs).drop("shards")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    from levelframe.session import table

    return reported(table(spark, sf_dir, "documents"))
