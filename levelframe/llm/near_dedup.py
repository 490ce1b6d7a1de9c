"""Near-duplicate documents: circulant MinHash, banding, and exact Jaccard similarity of the full shingle sets.

One permutation sends a shingle to a place on a circle of CIRCLE places; the other gives every place a rank.
Coordinate k of the signature is the least rank over the set after shifting the circle by k: two permutations, one of
them shifted, stand for all coordinates. In memory the ranks of a shingle's coordinates lie side by side.

Documents with equal sets are one class. Classes that agree on a band meet in a bucket. There each is compared with
one class, the bucket's hub: the one that meets most others over all its bands, as the origin of a family of edited
copies does. Most buckets are one component by then and are done, as no link in them could change anything. The
classes of the others are the pool. Two of them can only be linked if they share one of their rarest shingles: with a
similarity of PERCENT, the first n - ceil(n * PERCENT / 100) + 1 of each set, ordered by how many sets of the pool
have them, have one in common, and at the first that they share enough of both sets must be left. So shingles of one
set alone cost nothing, a passage that thousands of texts share is no key, and of a family only those that can still
have a partner elsewhere are compared: no link between components is left out and no group makes all its pairs.
Comparisons are made on the full sets. Components come from rounds of least labels with pointer jumping and hooking of
roots, until no label changes; the second time over the components of the first.

At similarity 0.75 a pair shares no band with probability (1 - 0.75 ** ROWS) ** BANDS, 4e-7; its sketches differ in
more than APART bits with about 3e-8.

Nulls and edge cases: without words a set is empty and linked with nothing; fewer words than a shingle make one
shingle; repeated rows are equal sets; a text of any length is worked on whole; of classes that meet as many others
the first in reading order is the hub, which changes no result; a null doc_id is a document and last in order; an
empty table gives an empty result; columns other than doc_id and text are kept by deduplicated() and ignored by
components(); doc_id may be of any type with an order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from levelframe.llm.arena import ascii_lowered, chunks, mix, word_hashes
from levelframe.llm.common import BitFilter, saved, written

SHINGLE = 5
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 75, 6
#: Coordinates of the sketch, 16 to a long, and in how many of its bits two alike may differ: at similarity 0.75 they
#: differ in 96, give or take 14.
SKETCHED, APART = 192, 172
#: Places of the circle: sets of many more shingles share coordinates with each other, which costs comparisons only.
CIRCLE_BITS = 22
SEED = 7
#: Rounds of labels after which something is wrong: a shuffled chain of 200000 links settles in 24.
ROUNDS = 200


def _ranks() -> np.ndarray:
    ranks = np.random.default_rng(SEED).permutation(1 << CIRCLE_BITS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((ranks, ranks[: BANDS * ROWS])), BANDS * ROWS)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    factors = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64))
    for _, _, b, offsets in chunks(column):
        words, first = word_hashes(ascii_lowered(b), offsets)
        sums = np.zeros(max(len(words) - SHINGLE + 1, 0), np.uint64)
        for k in range(SHINGLE):
            sums += words[k : len(words) - SHINGLE + 1 + k] * factors[k] if len(sums) else 0
        hashes = mix(sums)
        for lo, hi in zip(first[:-1], first[1:], strict=True):
            n = hi - lo
            if n >= SHINGLE:
                yield np.unique(hashes[lo : hi - SHINGLE + 1])
            elif n:
                yield mix(np.array([(words[lo:hi] * factors[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def signature(ranks: np.ndarray, places: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(places), 256):
        np.minimum(least, ranks[places[at : at + 256]].min(axis=0), out=least)
    return least


SKETCH = "__rid long, __key binary, n long, same binary, bands array<long>, sketch array<long>"


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64), pa.int64()))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranks = _ranks()
    salt, empty = mix(np.arange(1, ROWS + 2, dtype=np.uint64)), np.zeros(0, np.int64)
    for batch in batches:
        n, same, bands, sketches = [], [], [], []
        for s in shingle_sets(batch.column("text")):
            n.append(len(s))
            same.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            if len(s):
                sig = signature(ranks, (s >> np.uint64(64 - CIRCLE_BITS)).astype(np.int64)).astype(np.uint64)
                nibbles = (mix(sig[:SKETCHED]) >> np.uint64(60)).reshape(-1, 16)
                sketches.append((nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).astype(np.int64))
                sig = sig.reshape(BANDS, ROWS)
                keys = (sig * salt[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * salt[ROWS]
                bands.append(mix(keys).astype(np.int64))
            else:
                bands.append(empty)
                sketches.append(empty)
        own = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(n, pa.int64()), pa.array(same, pa.binary()), _lists(bands), _lists(sketches)], [*own, "n", "same", "bands", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [s.astype(np.int64) for s in shingle_sets(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("cid"), _lists(found)], ["cid", "set"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that pass on their full sets."""
    for batch in batches:
        good = []
        for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
            p, q = x.values.to_numpy(), y.values.to_numpy()
            both = len(np.intersect1d(p, q, assume_unique=True))
            good.append(100 * both >= PERCENT * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def labelled(edges: DataFrame) -> DataFrame:
    """(v, label): the least vertex of each vertex's component; edges (a, b), computed once.

    In a round each vertex takes the least label beside it, the label of its label, and what those that had it as
    their label found: so a whole tree of labels is hooked at once. Rounds end when no label changes.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = saved(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    for _ in range(ROUNDS):
        near = both.join(state.withColumnRenamed("v", "a"), "a").groupBy(F.col("b").alias("v")).agg(F.min("label").alias("near"))
        step = saved(state.join(near, "v").select("v", F.least("label", "near").alias("to"), F.col("label").alias("old")))
        hook = step.groupBy(F.col("old").alias("v")).agg(F.min("to").alias("hooked"))
        # jump to the label of the label
        jump = state.select(F.col("v").alias("to"), F.col("label").alias("beyond"))
        new = step.join(hook, "v", "left").join(jump, "to", "left")
        new = saved(new.select("v", F.least("to", F.coalesce("hooked", "to"), F.coalesce("beyond", "to")).alias("label"), "old"))
        settled = new.filter("label <> old").isEmpty()
        state = new.select("v", "label")
        if settled:
            return state
    raise RuntimeError(f"labels still change after {ROUNDS} rounds")


def alike(a: Column, b: Column) -> Column:
    """Whether two sketches differ in at most APART bits: where coordinates differ, two of four bits do on average."""
    differ = F.lit(0)
    for k in range(SKETCHED // 16):
        differ = differ + F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))))
    return differ <= APART


def sized(a: Column, b: Column) -> Column:
    """Whether two sizes allow a link."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


class NearDuplicates:
    """The steps over one table; every table that is used twice is saved."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select("text", F.unhex(F.sha2("text", 256)).alias("__key"))
        rows = docs.select(F.monotonically_increasing_id().alias("__rid"), F.unhex(F.sha2("text", 256)).alias("__key"), "doc_id", "text")
        kind = StructType([*StructType.fromDDL(SKETCH).fields, StructField("doc_id", docs.schema["doc_id"].dataType)])
        order = ["__rid", "__key", "doc_id", "n", "same", "bands", "sketch"]
        self.rows = written(rows.mapInArrow(_sketch, StructType([kind[c] for c in order])))
        self.classes = saved(self.rows.filter("n > 0").groupBy("same").agg(F.min("__rid").alias("cid")))
        first = self.rows.join(self.classes.select(F.col("cid").alias("__rid")), "__rid")
        self.firsts = written(first.select(F.col("__rid").alias("cid"), "__key", "n", "bands", "sketch"))

    def slots(self) -> DataFrame:
        """(key, cid, hub) of the buckets with two classes or more; the hub meets most others over all its bands."""
        slots = self.firsts.select("cid", F.explode("bands").alias("key"))
        shared = slots.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        slots = written(slots.join(shared, "key"))
        meets = slots.groupBy("cid").agg(F.sum("m").alias("meets"))
        slots = slots.join(meets, "cid")
        hubs = slots.groupBy("key").agg(F.max(F.struct("meets", (-F.col("cid")).alias("first"))).alias("h"))
        return written(slots.join(hubs.select("key", (-F.col("h.first")).alias("hub")), "key").select("key", "cid", "hub"))

    def sets_of(self, cids: DataFrame) -> DataFrame:
        """(cid, set) of distinct classes from their texts: a bit filter drops most other texts before the shuffle."""
        wanted = saved(self.firsts.join(cids, "cid").select("cid", "__key", F.xxhash64("__key").alias("h")))
        listed = BitFilter(wanted, "h")
        texts = self.docs.filter(listed.may_hold(F.xxhash64("__key"))).join(wanted, "__key")
        return written(texts.groupBy("cid").agg(F.first("text").alias("text")).mapInArrow(_sets, "cid long, set array<long>"))

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The saved pairs (a, b) that are links on their full sets."""
        a = sets.select(F.col("cid").alias("a"), F.col("set").alias("sa"))
        b = sets.select(F.col("cid").alias("b"), F.col("set").alias("sb"))
        return saved(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(_linked, "a long, b long"))

    def star(self, slots: DataFrame) -> DataFrame:
        """Pairs a < b of each class with the hubs of its buckets, those that pass the sizes and sketches."""
        pairs = slots.filter("cid <> hub").select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct()
        of = lambda c: self.firsts.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
        pairs = pairs.join(of("a"), "a").join(of("b"), "b").filter(sized(F.col("na"), F.col("nb")) & alike(F.col("sa"), F.col("sb")))
        return saved(pairs.select("a", "b"))

    def pool(self, slots: DataFrame, labels: DataFrame) -> DataFrame:
        """(cid, n, label, sketch) of the classes in buckets with several components."""
        named = slots.select("key", "cid").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        several = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
        inside = named.join(several, "key").select("cid", "label").distinct()
        return saved(inside.join(self.firsts.select("cid", "n", "sketch"), "cid"))

    @staticmethod
    def rarest(pool: DataFrame, sets: DataFrame) -> DataFrame:
        """(shingle, cid, n, label, at): the rarest shingles of each class, that another class of the pool has and
        that two linked sets cannot both lack; at is the shingle's place in the set's order."""
        each = pool.select("cid", "n", "label").join(sets, "cid").select("cid", "n", "label", F.explode("set").alias("shingle"))
        often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        shared = each.join(often, "shingle").groupBy("cid").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.sort_array(F.collect_list(F.struct("m", "shingle"))).alias("s"))
        # those of this set alone stand first and have no partner
        alone = (F.col("n") - F.size("s")).cast("int")
        first = (F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1).cast("int")
        keys = F.transform(F.slice("s", 1, F.greatest(first - alone, F.lit(0))), lambda x, i: F.struct(x["shingle"].alias("shingle"), (i + alone).alias("at")))
        return saved(shared.select("cid", "n", "label", F.explode(keys).alias("k")).select("k.shingle", "cid", "n", "label", "k.at"))

    def across(self, pool: DataFrame, sets: DataFrame) -> DataFrame:
        """Saved pairs a < b of classes of different components that can be linked."""
        keys = self.rarest(pool, sets)
        # an overlap of at least PERCENT / (100 + PERCENT) of both sizes must be left in both sets from here on
        least = lambda n, m: PERCENT * (n + m)
        left = (100 + PERCENT) * (F.col("n") - F.col("at"))
        shortest = keys.groupBy("shingle").agg(F.min("n").alias("short"))
        able = keys.join(shortest, "shingle").filter(left >= least(F.col("n"), F.col("short"))).drop("short")
        several = able.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("shingle")
        able = saved(able.join(several, "shingle").join(pool.select("cid", "sketch"), "cid"))
        x, y = able.alias("x"), able.alias("y")
        both = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
        near = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.label") < F.col("y.label")) & ((100 + PERCENT) * both >= least(F.col("x.n"), F.col("y.n")))
        pairs = x.join(y, near & sized(F.col("x.n"), F.col("y.n")) & alike(F.col("x.sketch"), F.col("y.sketch")))
        return saved(pairs.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct())

    def links(self) -> DataFrame | None:
        """(cid, label) of the classes that are linked with another."""
        slots = self.slots()
        if slots.isEmpty():
            return None
        sets = self.sets_of(slots.select("cid").distinct())
        labels = labelled(self.verified(self.star(slots), sets)).withColumnRenamed("v", "cid")
        pool = self.pool(slots, labels)
        if pool.isEmpty():
            return labels
        edges = self.verified(self.across(pool, sets), sets)
        if edges.isEmpty():
            return labels
        # between the components found so far
        name = lambda v: F.coalesce(F.col(f"l{v}.label"), F.col(v)).alias(v)
        edges = edges.join(labels.alias("la"), F.col("a") == F.col("la.cid"), "left").join(labels.alias("lb"), F.col("b") == F.col("lb.cid"), "left").select(name("a"), name("b"))
        joined = labelled(edges).withColumnRenamed("label", "least")
        every = labels.join(joined, labels["label"] == joined["v"], "left").select("cid", F.coalesce("least", "label").alias("label"))
        single = joined.select(F.col("v").alias("cid"), F.col("least").alias("label")).join(labels.select("cid"), "cid", "left_anti")
        return saved(every.unionByName(single))

    def components(self) -> DataFrame:
        """(__rid, __key, doc_id, n_shingles, component_id, first) of each row; first: the row that stays."""
        labels = self.links()
        named = self.classes.withColumn("label", F.col("cid")) if labels is None else self.classes.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        rows = self.rows.select("__rid", "__key", "doc_id", "n", "same").join(named.select("same", "label"), "same", "left")
        # a row without words is a component of its own
        rows = written(rows.select("__rid", "__key", "doc_id", "n", F.when(F.col("n") > 0, F.col("label")).otherwise(-1 - F.col("__rid")).alias("label")))
        head = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__rid")).alias("h"))
        out = rows.join(head.select("label", F.col("h.doc_id").alias("component_id"), F.col("h.__rid").alias("first")), "label")
        return out.select("__rid", "__key", "doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("first") == F.col("__rid")).alias("first"))


def components(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: its set's size, its component, whether it has the component's least doc_id."""
    return NearDuplicates(docs).components().select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, all columns."""
    names = docs.columns
    found = saved(NearDuplicates(docs).components())
    # what goes, by id and text; of rows with the same id and text one stays
    gone = found.groupBy("doc_id", "__key").agg(F.max("first").alias("stays"), F.count(F.lit(1)).alias("m"))
    gone = saved(gone.filter("NOT stays OR m > 1").select(F.col("doc_id").alias("__id"), F.col("__key").alias("__k"), "stays"))
    rows = docs.select(F.struct(*names).alias("__row"), F.col("doc_id").alias("__d"), F.unhex(F.sha2("text", 256)).alias("__t"))
    same = F.col("__d").eqNullSafe(F.col("__id")) & F.col("__t").eqNullSafe(F.col("__k"))
    kept = rows.join(gone, same, "left_anti")
    repeated = gone.filter("stays")
    if repeated.isEmpty():
        return kept.select("__row.*")
    one = rows.join(repeated, same, "left_semi").groupBy("__d", "__t").agg(F.first("__row").alias("__row"))
    return kept.select("__row").unionByName(one.select("__row")).select("__row.*")


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    from levelframe.session import table

    return components(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * m >= 75 * (p.n + q.n - m)),
r AS (
  WITH RECURSIVE reach(a, b) AS (
    SELECT doc_id, doc_id FROM d
    UNION
    SELECT reach.a, t.y FROM reach JOIN (SELECT x, y FROM e UNION ALL SELECT y, x FROM e) t ON reach.b = t.x
  ) SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT r.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id, r.doc_id = r.component_id AS kept FROM r LEFT JOIN n USING (doc_id)
"""
