"""Sharding by balanced label propagation: linked documents move towards their neighbours under exact quotas.

Documents that share a link (by default equal texts) are neighbours. They start in shards dealt by hash. In each
round the groups count their members by shard, and a group's fullest ones become its targets: as many as its size
fills, one for most. Members elsewhere ask to move to a target, each to one by its hash, if more neighbours are there
than where they are. Requests are gathered in cells (from, target, gain, hash bucket), and whole cells are granted,
largest gain first: in one kind of round while the target has room, in the other kind as far as as many ask to move
the opposite way, so that full shards swap members. A group of any size is split by its members' hashes. Rounds end
when two in turn move nothing, or after ROUNDS. What a swap of unequal cells leaves above a quota joins the documents
without links, which fill each shard up to its quota exactly, so that any two shards differ by one row at most.

Law: rows. Nulls and edge cases: a null text has size 8, a null checksum and no links; a text of any length is one
row; repeated rows are rows of their own and linked as equal texts; of equally full shards a hash decides; with fewer
rows than shards some shards stay empty; an empty table gives an empty result; assigned() keeps the columns that it
is told to and drops of its own those with the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from levelframe.llm.common import numbered, saved, written

SHARDS = 24
#: Rounds of moves at most, whether or not all is settled; groups of copies settle in a few.
ROUNDS = 8
#: Members of a group that one task joins with the group's targets.
SPLIT = 512
#: Hash buckets of the requests to a shard: the finest part of a quota that is granted at once.
CELLS = 128


def _spread(*parts) -> Column:
    return F.xxhash64(F.lit("shard"), *parts)


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard: at most one apart."""
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def _loads(linked: DataFrame, shards: int) -> list[int]:
    found = {r["label"]: r["n"] for r in linked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a shard
    return [found.get(k, 0) for k in range(shards)]


def _table(values: list[int], name: str, spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), f"__shard int, {name} long")


def _salts(size: str) -> Column:
    return F.ceil(F.col(size) / F.lit(float(SPLIT))).cast("int")


def propagate(linked: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """linked (__rid, __link, __h, __size: its group's) with a column label: its shard after the rounds."""
    spark, shards = linked.sparkSession, len(quota)
    state = saved(linked.select("__rid", "__link", "__h", F.pmod("__h", _salts("__size")).cast("int").alias("__salt"), F.pmod(_spread("__h"), F.lit(shards)).cast("int").alias("label")))
    loads, still = _loads(state, shards), 0
    for turn in range(rounds):
        swap = turn % 2 == 1
        room = _table([max(0, q - n) for q, n in zip(quota, loads, strict=True)], "room", spark)
        counts = state.groupBy("__link", "label").agg(F.count(F.lit(1)).alias("n"))
        # a group's shards, fullest first; for moves into room a full shard is a target only for those in it
        per = counts.join(F.broadcast(room), F.col("label") == F.col("__shard")).groupBy("__link").agg(
            F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("n", F.xxhash64("__link", "label").alias("tie"), "label", (F.lit(swap) | (F.col("room") > 0)).alias("open"))), asc=False).alias("at")
        )
        need = F.ceil(F.col("size") / F.lit(float(max(1, min(quota, default=1))))).cast("int")
        per = per.withColumn("need", need).withColumn("settled", F.slice("at", 1, F.col("need")))
        per = per.withColumn("targets", F.filter("settled", lambda a: a["open"])).withColumn("targets", F.when(F.size("targets") > 0, F.col("targets")).otherwise(F.slice(F.filter("at", lambda a: a["open"]), 1, 1)))
        per = per.select("__link", F.explode(F.sequence(F.lit(0), _salts("size") - 1)).alias("__salt"), F.map_from_entries(F.transform("at", lambda a: F.struct(a["label"], a["n"]))).alias("by_label"), F.transform("settled", lambda a: a["label"]).alias("settled"), F.transform("targets", lambda a: F.struct(a["label"].alias("label"), a["n"].alias("n"))).alias("targets"))
        asked = state.join(per, ["__link", "__salt"])
        target = F.when((F.size("targets") > 0) & ~F.array_contains("settled", F.col("label")), F.col("targets")[F.pmod(F.col("__h"), F.greatest(F.size("targets"), F.lit(1))).cast("int")])
        asked = asked.withColumn("__to", target).select("__rid", "__link", "__h", "__salt", "label", F.col("__to.label").alias("to"), (F.col("__to.n") - F.col("by_label")[F.col("label")] + 1).alias("gain"))
        asked = asked.withColumn("to", F.when((F.col("gain") > 0) & (F.col("to") != F.col("label")), F.col("to")))
        asked = asked.withColumn("rank", F.floor(F.log2(F.greatest(F.col("gain"), F.lit(1)).cast("double"))).cast("int")).withColumn("cell", F.pmod(_spread(F.lit("cell"), "__link"), F.lit(CELLS)).cast("int"))
        # copies of one text share a cell unless the group is larger than a cell's share of a shard
        wide = F.col("rank") >= F.lit(max(1, min(quota) // CELLS).bit_length())
        asked = saved(asked.withColumn("cell", F.when(wide, F.pmod(_spread(F.lit("cell"), "__h"), F.lit(CELLS)).cast("int")).otherwise(F.col("cell"))))
        # at most shards * shards * CELLS * 64 rows, whatever the input
        cells = asked.filter("to IS NOT NULL").groupBy("label", "to", "rank", "cell").agg(F.count(F.lit(1)).alias("n"))
        if swap:
            whole = cells.groupBy("label", "to").agg(F.sum("n").alias("n"))
            back = whole.select(F.col("label").alias("to"), F.col("to").alias("label"), F.col("n").alias("back"))
            bound = whole.join(back, ["label", "to"]).select("label", "to", F.least("n", "back").alias("room"))
            cells = cells.withColumn("upto", F.sum("n").over(W.partitionBy("label", "to").orderBy(F.desc("rank"), "cell"))).join(F.broadcast(bound), ["label", "to"])
        else:
            cells = cells.withColumn("upto", F.sum("n").over(W.partitionBy("to").orderBy(F.desc("rank"), "cell", "label"))).join(F.broadcast(room), F.col("to") == F.col("__shard"))
        granted = saved(cells.filter("upto <= room").select("label", "to", "rank", "cell", F.lit(True).alias("granted")))
        if granted.isEmpty():
            still += 1
            if still == 2:
                break
            continue
        still = 0
        moved = asked.join(F.broadcast(granted), ["label", "to", "rank", "cell"], "left")
        state = saved(moved.select("__rid", "__link", "__h", "__salt", F.when(F.col("granted"), F.col("to")).otherwise(F.col("label")).alias("label")))
        loads = _loads(state, shards)
    return state


def placed(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """rows (__rid, __link or null, __h, ..), computed once, with shard and slot."""
    spark = rows.sparkSession
    total = rows.count()
    quota = quotas(total, shards)
    sizes = rows.filter("__link IS NOT NULL").groupBy("__link").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__link", F.col("__n").alias("__size"))
    linked = rows.join(sizes, "__link").select("__rid", "__link", "__h", "__size")
    labelled = propagate(linked, quota, rounds)
    ranked = numbered(labelled.select("__rid", "label", "__h", F.xxhash64("__link").alias("__g")), ["label"], F.xxhash64("__g", "__h", "__rid"))
    kept = saved(ranked.join(F.broadcast(_table(quota, "quota", spark)), F.col("label") == F.col("__shard")).filter("position < quota").select("__rid", F.col("label").alias("shard"), F.col("position").alias("slot")))
    held = {r["shard"]: r["n"] for r in kept.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a shard
    open_, start = [], 0
    for k in range(shards):
        more = quota[k] - held.get(k, 0)
        open_.append((k, start, start + more, held.get(k, 0)))
        start += more
    free = numbered(rows.select("__rid", "__h").join(kept.select("__rid"), "__rid", "left_anti"), [], F.xxhash64("__h", "__rid"))
    gaps = spark.createDataFrame(open_, "shard int, first long, last long, held long")
    filled = free.join(F.broadcast(gaps), (F.col("position") >= F.col("first")) & (F.col("position") < F.col("last"))).select("__rid", "shard", (F.col("position") - F.col("first") + F.col("held")).alias("slot"))
    return kept.unionByName(filled)


OWN = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def assigned(docs: DataFrame, keep: list[str], shards: int = SHARDS, link: Column | None = None) -> DataFrame:
    """keep, size, text_crc32, law, shard, slot, grown_shard of each row. link: what linked rows share.

    Of the columns of keep those named as one of the six are left out.
    """
    link = F.when(F.col("text").isNotNull(), F.md5(F.col("text"))) if link is None else link
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    kept = [c for c in keep if c not in OWN]
    rows = docs.select(
        F.monotonically_increasing_id().alias("__rid"), F.struct(*kept).alias("__row"), size.alias("__bytes"), F.crc32("text").alias("__crc"), link.alias("__link"), F.xxhash64("doc_id", F.crc32("text")).alias("__h")
    )
    rows = written(rows)
    out = rows.select("__rid", "__row", "__bytes", "__crc").join(placed(rows.select("__rid", "__link", "__h"), shards), "__rid")
    return out.select("__row.*", F.col("__bytes").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    from levelframe.session import table

    return assigned(table(spark, sf_dir, "documents"), ["doc_id"])
