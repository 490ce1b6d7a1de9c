"""Hard negatives: for every anchor and each of its nearest rows of the same label, the best rows of other labels whose
score lies in a window below that positive's.

Slot-decomposed selection: the upper limits of an anchor's positives cut the scores into disjoint slots. Each task keeps
the best few of every slot for its anchors and rows (a combiner), these are reduced by anchor and slot, and a window's
rows are the best of its own slot and all lower ones, merged once from above: its lower limit only cuts the end off.

Anchors and rows are dealt to cells, so many anchors and so many rows each, and a cell's rows stream past its anchors in
batches: scores are products of two small matrices, and memory is bounded by the anchors of a cell. No row meets the
driver, nothing is broadcast, and both passes (positives, then slots) cost the product of anchors and rows, as every
anchor asks for all rows. Scores are whole numbers: exact in doubles where they stay below 2 ** 53, else in 64-bit
integers; beyond these an error is raised.

Nulls and edge cases: rows with a null id, label or vector, or a null or non-finite component take no part; of anchors
with equal ids the smallest by label and vector asks, while every repeated row can be found; a row is no positive of an
anchor with its own id; shorter vectors count as filled with zeros, vectors of any length are read whole; ties go to the
smaller id; with fewer rows than asked for, all are returned; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levelframe.llm.common import written

POSITIVES, NEGATIVES = 5, 3
#: A window, in hundredths of the positive's score.
LOW, HIGH = 50, 95
#: Anchors of a cell, rows that a cell is meant for, and parts of the rows at most (cells grow beyond).
ANCHORS, ROWS, MOST_PARTS = 4096, 2048, 1024
#: Rows and anchors that are multiplied at once.
AT_ONCE = 1024
LEAST = np.iinfo(np.int64).min
BEST = "anchor_id long, slot int, score long, vec_id long"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and vector (array of longs, floor(256 * x)) of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(~bad)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vector"))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """The vectors as rows of doubles or, where they need it, of 64-bit integers."""
    flat, offsets = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = min(a.shape[1], b.shape[1])
    if not d:
        return np.zeros((len(a), len(b)), np.int64)
    a, b = a[:, :d], b[:, :d]
    bound = int(np.abs(a.astype(np.float64)).max(initial=0)) * int(np.abs(b.astype(np.float64)).max(initial=0)) * d
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound >= 1 << 63:
        raise ValueError("scores beyond 64 bits")
    return a @ b.T


def _ranked(scores: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The best keep along the last axis: by score from above, then by id."""
    order = np.lexsort((ids, -scores), axis=-1)[..., :keep]
    return np.take_along_axis(scores, order, -1), np.take_along_axis(ids, order, -1)


class _Found:
    """The best so far for each anchor and slot of a cell."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, slots: int, keep: int):
        self.ids, self.labels, self.vectors, self.keep = ids, labels, vectors, keep
        # 1 - the smallest number can be negated
        self.scores, self.found = np.full((len(ids), slots, keep), LEAST + 1), np.zeros((len(ids), slots, keep), np.int64)

    def add(self, anchors: np.ndarray, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        both = np.concatenate((self.scores[anchors, slot], scores), axis=1), np.concatenate((self.found[anchors, slot], ids), axis=1)
        self.scores[anchors, slot], self.found[anchors, slot] = _ranked(*both, self.keep)

    def rows(self) -> pa.RecordBatch:
        a, s, k = np.nonzero(self.scores > LEAST + 1)
        columns = [pa.array(self.ids[a]), pa.array(s.astype(np.int32)), pa.array(self.scores[a, s, k]), pa.array(self.found[a, s, k])]
        return pa.RecordBatch.from_arrays(columns, ["anchor_id", "slot", "score", "vec_id"])


def _top(scores: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Like _ranked for ids in rising order, with few left to rank: what lies over or at the keep-th score, ties by place."""
    if scores.shape[1] <= keep:
        return scores, np.broadcast_to(ids, scores.shape)
    order = np.argsort(-scores, axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(scores, order, 1), ids[order]


def _positives(cell: _Found, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, limits: np.ndarray) -> None:
    for label in np.intersect1d(cell.labels, labels):
        own, other = np.flatnonzero(cell.labels == label), np.flatnonzero(labels == label)
        scores = _product(cell.vectors[own], vectors[other])
        scores[cell.ids[own][:, None] == ids[other]] = LEAST + 1
        cell.add(own, 0, *_top(scores, ids[other], cell.keep))


def _negatives(cell: _Found, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, limits: np.ndarray) -> None:
    scores = _product(cell.vectors, vectors)
    scores[cell.labels[:, None] == labels] = LEAST + 1
    every = np.arange(len(cell.ids))
    for slot in range(limits.shape[1]):
        high = limits[:, slot, None]
        low = limits[:, slot + 1, None] if slot + 1 < limits.shape[1] else np.full_like(high, LEAST + 1)
        # only what beats the worst that is kept can enter; ties may, by their id
        enters = (scores <= high) & (scores > low) & (scores >= cell.scores[:, slot, -1:])
        a, at = np.nonzero(enters)
        if not len(a):
            continue
        s = scores[a, at]
        order = np.lexsort((ids[at], -s, a))
        a, at, s = a[order], at[order], s[order]
        first = np.searchsorted(a, every)
        nth = np.arange(len(a)) - first[a]
        a, at, s, nth = (x[nth < cell.keep] for x in (a, at, s, nth))
        some = np.unique(a)
        best, found = np.full((len(cell.ids), cell.keep), LEAST + 1), np.zeros((len(cell.ids), cell.keep), np.int64)
        best[a, nth], found[a, nth] = s, ids[at]
        cell.add(some, slot, best[some], found[some])


def _scan(step: Callable, slots: int, keep: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams the rows of a partition's cells past their anchors; a cell's anchors come first."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, cell, limits = None, [], None, None
        for batch in batches:
            cells, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "kind"))
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for low, high in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                if cells[low] != now:
                    if cell is not None:
                        yield cell.rows()
                    now, waiting, cell = cells[low], [], None
                if kinds[low] == 0:
                    waiting.append(part)
                    continue
                if cell is None and waiting:
                    anchors = pa.Table.from_batches(waiting).combine_chunks()
                    column = lambda c: anchors.column(c).combine_chunks()  # noqa: B023, E731
                    limits = np.full((anchors.num_rows, slots), LEAST + 1)
                    for k, x in enumerate(column("limits").to_pylist()):
                        limits[k, : len(x)] = x
                    cell = _Found(column("vec_id").to_numpy(), column("label").to_numpy(), _matrix(column("vector")), slots, keep)
                if cell is None:
                    continue  # rows of a cell without anchors
                ids, labels, vectors = part.column("vec_id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("vector"))
                order = np.argsort(ids, kind="stable")
                for k in range(0, len(order), AT_ONCE):
                    at = order[k : k + AT_ONCE]
                    step(cell, ids[at], labels[at], vectors[at], limits)
        if cell is not None:
            yield cell.rows()

    return of


def _cells(rows: DataFrame, anchors: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """Both sides dealt to the cells: cell, kind (0 anchor, 1 row), vec_id, label, vector, limits."""
    n, m = sizes
    blocks, parts = max(1, -(-m // ANCHORS)), min(MOST_PARTS, max(1, -(-n // ROWS)))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    asked = anchors.withColumn("part", every(parts)).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    # by place, not by id: an id may recur without end
    dealt = rows.withColumn("block", every(blocks)).withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)))
    cell = (F.col("block") * parts + F.col("part")).cast("int").alias("cell")
    none = F.array().cast("array<long>")
    both = asked.select(cell, F.lit(0).alias("kind"), "vec_id", "label", "vector", "limits").unionByName(dealt.select(cell, F.lit(1).alias("kind"), "vec_id", "label", "vector", none.alias("limits")))
    return both.repartitionById(blocks * parts, F.col("cell")).sortWithinPartitions("cell", "kind")


def _best(cells: DataFrame, step: Callable, slots: int, keep: int) -> DataFrame:
    """anchor_id, slot and its best: (negated score, vec_id) in order."""
    found = cells.mapInArrow(_scan(step, slots, keep), BEST)
    item = F.struct((-F.col("score")).alias("less"), "vec_id")  # keep for each of MOST_PARTS parts at most
    return found.groupBy("anchor_id", "slot").agg(F.slice(F.sort_array(F.collect_list(item)), 1, keep).alias("best"))


def mined(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, embedding; anchor: which rows ask. A negative's score lies between low and high hundredths
    of the positive's, both included.
    """
    rows = written(usable(vectors))
    own = rows.filter(anchor).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("a")).select("vec_id", "a.label", "a.vector")
    anchors = written(own)
    sizes = rows.count(), anchors.count()
    none = F.array().cast("array<long>")
    near = _best(_cells(rows, anchors.withColumn("limits", none), sizes), _positives, 1, positives)
    # whole numbers: 100 * x <= high * p and low * p <= 100 * x
    floor = lambda x: F.expr(f"({x} - pmod({x}, 100L)) div 100")
    near = near.select("anchor_id", F.posexplode("best").alias("nth", "p")).select("anchor_id", "nth", F.col("p.vec_id").alias("positive_id"), (-F.col("p.less")).alias("positive_score"))
    near = near.withColumns({"upper": floor(f"({high}L * positive_score)"), "lower": -floor(f"({-low}L * positive_score)")}).filter("lower <= upper")
    near = written(near.select("anchor_id", F.struct("nth", "positive_id", "positive_score", "upper", "lower").alias("p")).groupBy("anchor_id").agg(F.collect_list("p").alias("positives")))
    limits = near.select(F.col("anchor_id").alias("vec_id"), F.sort_array(F.array_distinct(F.transform("positives", lambda p: p["upper"])), asc=False).alias("limits"))
    asking = anchors.join(limits, "vec_id")
    slots = _best(_cells(rows, asking, sizes), _negatives, positives, negatives)
    merged = slots.groupBy("anchor_id").agg(F.sort_array(F.flatten(F.collect_list("best"))).alias("items"))  # positives * negatives items
    of = F.filter("items", lambda x: (-x["less"] <= F.col("p.upper")) & (-x["less"] >= F.col("p.lower")))
    out = near.join(merged, "anchor_id").select("anchor_id", F.explode("positives").alias("p"), "items")
    out = out.select("anchor_id", "p", F.posexplode(F.slice(of, 1, negatives)).alias("k", "x"))
    return out.select("anchor_id", "p.positive_id", (F.col("k") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("negative_id"), "p.positive_score", (-F.col("x.less")).alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from levelframe.session import table

    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 3
"""
