"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A to Z, and what they become: only ASCII letters change case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: space and the controls from tab to carriage return.
BLANK = r"[\x20\x09-\x0D]"
#: What may be broadcast.
BROADCAST_BYTES = 32 << 20


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the folder that all executors share.

    The folder is the session's spark.checkpoint.dir; only a local session without one gets its own.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="levelframe-"))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df, written once as a compressed table in the folder that all executors share, and read back.

    For large intermediate tables: smaller than a checkpoint, and later reads take only the columns they need. The
    files stay until the folder is cleared.
    """
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="levelframe-"))
        where = spark.sparkContext.getCheckpointDir()
    path = f"{where.rstrip('/')}/{spark.sparkContext.applicationId}/table-{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row: names inside lambdas would compute it for each element."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column, separator: str = f"{BLANK}+") -> Column:
    """The words between runs of separators; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def tail(array: Column, skip: int) -> Column:
    """array without its first skip elements."""
    return F.slice(array, skip + 1, F.size(array))


def upto(n: Column) -> Column:
    """[0, 1, .. n - 1]; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def window_hashes(words: Column, sizes: Sequence[int], body: Callable[[dict[int, Column]], Column]) -> Column:
    """body({size: hashes of all windows of so many words}).

    Windows of 2, 4, 8 words are hashed from their halves, others from those, so that each size costs few
    passes over the words. words should be a name bound by let().
    """
    want = sorted(set(sizes))
    powers = [1 << k for k in range(max(want).bit_length())]

    def valid(hashes: Column, size: int) -> Column:
        return F.slice(hashes, 1, F.greatest(F.size(words) - (size - 1), F.lit(0)))

    def join(left: Column, right: Column) -> Column:
        return F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))

    def doubled(have: dict[int, Column], rest: list[int]) -> Column:
        if rest:
            k = rest[0] // 2
            return let(valid(join(have[k], tail(have[k], k)), rest[0]), lambda h: doubled(have | {rest[0]: h}, rest[1:]))
        out = {}
        for size in want:
            parts = [p for p in reversed(powers) if size & p]
            hashes, at = have[parts[0]], parts[0]
            for p in parts[1:]:
                hashes = join(hashes, tail(have[p], at))
                at += p
            out[size] = valid(hashes, size)
        return body(out)

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: doubled({1: h}, powers[1:]))


#: Bits of a prefilter for each listed key, and its least and largest size. Beyond the largest the prefilter passes
#: more, and the exact join behind it does the work.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 64, 1 << 12, 1 << 22


class BitFilter:
    """Two bits for each listed 64-bit key, as one array of longs.

    It is a scalar subquery, so that no plan holds its words; constant: at most MOST_BITS / 64 words come to the driver
    and are a constant of the plan, as lambdas allow no subqueries. keys should be a saved table: it is read twice.
    """

    def __init__(self, keys: DataFrame, column: str, constant: bool = False):
        listed = max(1, keys.select(F.approx_count_distinct(column)).first()[0])
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (listed * BITS_A_KEY - 1).bit_length()))
        slots = keys.select(F.explode(F.array(*self._slots(F.col(column)))).alias("slot"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("slot", F.lit(64)).cast("int"))
        words = slots.groupBy(F.shiftright("slot", 6).cast("int").alias("at")).agg(F.bit_or(bit).alias("word"))
        if constant:
            found = {r["at"]: r["word"] for r in words.collect()}
            low = -(1 << 63)
            self.words = F.expr("array(" + ",".join("(-9223372036854775807L - 1L)" if (w := found.get(k, 0)) == low else f"{w}L" for k in range(self.bits // 64)) + ")")
            return
        every = keys.sparkSession.range(self.bits // 64).select(F.col("id").cast("int").alias("at")).join(words, "at", "left")
        ordered = F.array_sort(F.collect_list(F.struct("at", F.coalesce("word", F.lit(0)).alias("word"))))
        # a row for each of the words, at most MOST_BITS / 64, meets in one task
        self.words = saved(every.agg(F.transform(ordered, lambda x: x["word"]).alias("words"))).scalar()

    def _slots(self, key: Column) -> tuple[Column, Column]:
        return F.pmod(key, F.lit(self.bits)), F.pmod(F.shiftrightunsigned(key, 32), F.lit(self.bits))

    def may_hold(self, key: Column) -> Column:
        """False: the key is not listed. True: it may be."""
        one, two = (F.getbit(self.words[F.shiftright(slot, 6).cast("int")], F.pmod(slot, F.lit(64)).cast("int")) == 1 for slot in self._slots(key))
        return one & two


def prefix_sums(values: Column) -> Column:
    """Running totals of an int array: by chunks of about the root of its size, as appending copies the array."""

    def running(array: Column) -> Column:
        zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("sums"))
        return F.aggregate(array, zero, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.array_append(s["sums"], s["sum"] + x).alias("sums")), lambda s: s["sums"])

    def chunked(array: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(array))).cast("int"), F.lit(1))
        parts = F.transform(upto(F.ceil(F.size(array) / width).cast("int")), lambda c: running(F.slice(array, c * width + 1, width)))

        def joined(sums: Column) -> Column:
            ends = running(F.transform(sums, lambda x: F.element_at(x, -1)))
            return F.flatten(F.zip_with(sums, ends, lambda x, end: F.transform(x, lambda v: v + end - F.element_at(x, -1))))

        return let(parts, joined)

    return let(values, chunked)


def bytes_of(df: DataFrame) -> int:
    """About how many bytes the rows of df take: strings and arrays as they are, anything else as one word."""
    total = F.lit(16).cast("long")
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        total = total + F.coalesce(F.octet_length(c) if kind in ("string", "binary") else F.size(c) * 24 if kind == "array" else F.lit(8), F.lit(0))
    return df.select(F.sum(total)).first()[0] or 0


def small_enough(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if its rows take at most limit bytes; else the join is left to Spark. df is computed twice:
    it should be a saved table or little more."""
    return F.broadcast(df) if bytes_of(df) <= limit else df


def numbered(df: DataFrame, keys: Sequence[str], order: Column, name: str = "position") -> DataFrame:
    """Adds a gapless number from 0 within keys, without gathering a key's rows in one task.

    order: a 64-bit hash by which the rows are dealt to about sqrt(rows) buckets; the numbering goes bucket by
    bucket, and by the hash inside a bucket. df is computed twice: it should be a saved table or little more.
    """
    rows = df.select(F.count(F.lit(1))).first()[0]
    buckets = max(1, math.isqrt(rows))
    dealt = df.withColumn("__order", order).withColumn("__bucket", F.pmod(F.xxhash64("__order"), F.lit(buckets)))
    counts = dealt.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    by = W.partitionBy(*keys)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(by.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.drop("__n")
    inside = dealt.withColumn("__row", F.row_number().over(W.partitionBy(*keys, "__bucket").orderBy("__order")) - 1)
    same = [inside[k].eqNullSafe(counts[k]) for k in (*keys, "__bucket")]
    out = inside.join(counts, same, "inner")
    for k in (*keys, "__bucket"):
        out = out.drop(counts[k])
    return out.withColumn(name, (F.col("__before") + F.col("__row")).cast("long")).drop("__order", "__bucket", "__before", "__row")
