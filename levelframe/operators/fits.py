"""Line fits on point arrays, hypotheses from point pairs, and their clustering.

Points are array of struct(x, y) of doubles. Fits are expressions over a row's own points. Hypotheses have two forms:
searched() looks through a frame's pairs in the frame's row, on Arrow batches, and keeps the best few with their
inliers, without a shuffle; hypotheses() gives a row for each pair, for queries that want all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from levelframe.functions.arrays import indices, let, mean, total
from levelframe.functions.lines import line

INLIER = 3.0
MAX_POINTS = 400
TOP_K = 8
OVERLAP = 0.7
#: Fixed value: the tuning constant of the Huber weight.
HUBER = 1.345
POINTS = "array<struct<x:double,y:double>>"
BATCH, ENOUGH = 50, 0.75
#: Distances that a search holds at once: 16 MB.
AT_ONCE = 2_000_000
FOUND = "array<struct<n:int,i:int,j:int,line:struct<vx:double,vy:double,x0:double,y0:double>,refit:struct<vx:double,vy:double,x0:double,y0:double>,inliers:array<int>>>"
_LINE = pa.struct([(k, pa.float64()) for k in ("vx", "vy", "x0", "y0")])
FOUND_ARROW = pa.list_(pa.struct([("n", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("line", _LINE), ("refit", _LINE), ("inliers", pa.list_(pa.int32()))]))


def ols(points: Column) -> Column:
    """struct(slope, intercept) of least squares of y on x; null below two points or without spread in x."""

    def of(p: Column) -> Column:
        n = F.size(p).cast("double")
        sx, sy = total(F.transform(p, lambda q: q["x"])), total(F.transform(p, lambda q: q["y"]))
        sxx, sxy = total(F.transform(p, lambda q: q["x"] * q["x"])), total(F.transform(p, lambda q: q["x"] * q["y"]))
        slope = (n * sxy - sx * sy) / F.nullif(n * sxx - sx * sx, F.lit(0.0))
        return F.when((n >= 2) & slope.isNotNull(), F.struct(slope.alias("slope"), ((sy - slope * sx) / n).alias("intercept")))

    return let(points, of)


def _weighted_line(p: Column, w: Column) -> Column:
    """The line through the weighted centre along the axis of greatest spread."""

    def of(pw: Column) -> Column:
        s = total(F.transform(pw, lambda q: q["w"]))
        cx, cy = total(F.transform(pw, lambda q: q["w"] * q["x"])) / s, total(F.transform(pw, lambda q: q["w"] * q["y"])) / s

        def around(c: Column) -> Column:
            xx = total(F.transform(pw, lambda q: q["w"] * F.pow(q["x"] - c["x"], F.lit(2.0))))
            yy = total(F.transform(pw, lambda q: q["w"] * F.pow(q["y"] - c["y"], F.lit(2.0))))
            xy = total(F.transform(pw, lambda q: q["w"] * (q["x"] - c["x"]) * (q["y"] - c["y"])))
            return let(0.5 * F.atan2(2 * xy, xx - yy), lambda t: line(F.cos(t), F.sin(t), c["x"], c["y"]))

        return let(F.struct(cx.alias("x"), cy.alias("y")), around)

    return let(F.zip_with(p, w, lambda q, v: F.struct(q["x"].alias("x"), q["y"].alias("y"), v.alias("w"))), of)


def tls(points: Column) -> Column:
    """The orthogonal fit; null below two points."""
    return let(points, lambda p: F.when(F.size(p) >= 2, _weighted_line(p, F.transform(p, lambda q: F.lit(1.0)))))


def distance(p: Column, ln: Column) -> Column:
    """Of a point to a line with a direction of any length."""
    return F.abs((p["x"] - ln["x0"]) * ln["vy"] - (p["y"] - ln["y0"]) * ln["vx"]) / F.hypot(ln["vx"], ln["vy"])


def huber(points: Column, rounds: int = 12) -> Column:
    """The orthogonal fit with Huber weights: 1 up to HUBER pixels from the line, then falling with the distance."""

    def of(p: Column) -> Column:
        def step(ln: Column, _: Column) -> Column:
            weights = F.transform(p, lambda q: let(distance(q, ln), lambda r: F.when(r <= HUBER, F.lit(1.0)).otherwise(HUBER / r)))
            return _weighted_line(p, weights)

        return F.when(F.size(p) >= 2, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), _weighted_line(p, F.transform(p, lambda q: F.lit(1.0))), step))

    return let(points, of)


def subsample(points: Column, key: Column, limit: int = MAX_POINTS) -> Column:
    """At most limit points, the least by a hash of the frame and the point, in their old order: the same in any run."""

    def of(p: Column) -> Column:
        ranked = F.sort_array(F.transform(p, lambda q, i: F.struct(F.xxhash64(key, q["x"], q["y"]).alias("h"), i.alias("i"))))
        return F.transform(F.sort_array(F.transform(F.slice(ranked, 1, limit), lambda r: r["i"])), lambda i: p[i])

    return let(points, lambda p: F.when(F.size(p) <= limit, p).otherwise(of(p)))


@lru_cache(maxsize=64)
def _drawn(n: int, iterations: int, seed: int) -> np.ndarray:
    """The places i < j of pairs drawn with the seed: the same for all frames with n points."""
    rng = np.random.default_rng(seed)
    i, j = rng.integers(0, n, iterations), rng.integers(0, n - 1, iterations)
    j = j + (j >= i)
    pairs = np.stack((np.minimum(i, j), np.maximum(i, j)))
    return pairs[:, np.sort(np.unique(pairs, axis=1, return_index=True)[1])]  # a pair counts where it is drawn first


def _pairs(n: int, iterations: int | None, seed: int) -> tuple[int, object]:
    """The number of point pairs to look at, and a function from a range of them to their places i < j."""
    if iterations is None or n * (n - 1) // 2 <= iterations:
        starts = np.concatenate(([0], np.cumsum(np.arange(n - 1, 0, -1))))

        def dealt(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
            t = np.arange(lo, hi)
            i = np.searchsorted(starts, t, side="right") - 1
            return i, t - starts[i] + i + 1

        return int(starts[-1]), dealt
    pairs = _drawn(n, iterations, seed)
    return pairs.shape[1], lambda lo, hi: (pairs[0, lo:hi], pairs[1, lo:hi])


def huber_of(x: np.ndarray, y: np.ndarray, rounds: int = 12) -> dict:
    """huber() of two points or more, as values; it ends when a round changes nothing."""
    w, at = np.ones(len(x)), None
    for turn in range(rounds + 1):
        if turn:
            r = np.abs((x - x0) * vy - (y - y0) * vx)
            w = HUBER / np.maximum(r, HUBER)
        n, before = w.sum(), at
        x0, y0 = w @ x / n, w @ y / n
        dx, dy = x - x0, y - y0
        wx = w * dx
        at = 0.5 * math.atan2(2 * (wx @ dy), wx @ dx - (w * dy) @ dy)
        vx, vy = math.cos(at), math.sin(at)
        if before is not None and abs(at - before) < 1e-13:
            break
    return {"vx": float(vx), "vy": float(vy), "x0": float(x0), "y0": float(y0)}


def hubers_of(x: np.ndarray, y: np.ndarray, lit: np.ndarray, rounds: int = 12) -> list[dict]:
    """huber_of() of each row's points, side by side; lit: rows x points, 1 where a point is the row's, else 0."""
    found, rows, w, at = [{} for _ in lit], np.arange(len(lit)), lit, None
    for turn in range(rounds + 1):
        if turn:
            r = np.abs(dx * vy[:, None] - dy * vx[:, None])
            w = lit * (HUBER / np.maximum(r, HUBER))
        n, before = w.sum(axis=1), at
        x0, y0 = w @ x / n, w @ y / n
        dx, dy = x - x0[:, None], y - y0[:, None]
        wx, wy = w * dx, w * dy
        along = np.einsum("ij,ij->i", wx, dx) - np.einsum("ij,ij->i", wy, dy)
        at = 0.5 * np.arctan2(2 * np.einsum("ij,ij->i", wx, dy), along)
        vx, vy = np.cos(at), np.sin(at)
        over = np.full(len(at), turn == rounds) if before is None or turn == rounds else np.abs(at - before) < 1e-13
        if over.any():
            for k in np.flatnonzero(over):
                found[rows[k]] = {"vx": float(vx[k]), "vy": float(vy[k]), "x0": float(x0[k]), "y0": float(y0[k])}
            rest = ~over
            if not rest.any():
                break
            rows, lit, at, vx, vy, dx, dy = rows[rest], lit[rest], at[rest], vx[rest], vy[rest], dx[rest], dy[rest]
    return found


def _lit(found: list[np.ndarray], n: int) -> np.ndarray:
    lit = np.zeros((len(found), n))
    for row, at in zip(lit, found, strict=True):
        row[at] = 1
    return lit


def _best(x: np.ndarray, y: np.ndarray, near: float, k: int, least: int, ratio: float | None, iterations: int | None, seed: int) -> list[tuple]:
    """(n, i, j, vx, vy, places of the inliers) of the k lines that best_pairs() finds."""
    n = len(x)
    if n < 2:
        return []
    total_, pairs = _pairs(n, iterations, seed)
    step = BATCH if ratio is not None else max(1, AT_ONCE // n)
    best: list[tuple] = []
    for lo in range(0, total_, step):
        i, j = pairs(lo, min(lo + step, total_))
        dx, dy = x[j] - x[i], y[j] - y[i]
        size = np.hypot(dx, dy)
        some = size > 1e-6
        i, j, vx, vy = i[some], j[some], dx[some] / size[some], dy[some] / size[some]
        off = vy[:, None] * x
        off -= vx[:, None] * y
        off -= (vy * x[i] - vx * y[i])[:, None]
        hit = np.abs(off, out=off) < near - 5e-10  # as if rounded to nine places
        count = np.count_nonzero(hit, axis=1)
        first = np.argsort(-count, kind="stable")[:k]
        best += [(-int(count[t]), lo, int(t), int(i[t]), int(j[t]), float(vx[t]), float(vy[t]), np.flatnonzero(hit[t])) for t in first if count[t] >= least]
        best = sorted(best, key=lambda b: b[:3])[:k]
        if ratio is not None and best and -best[0][0] >= int(ratio * n):
            break
    return [(-b[0], *b[3:]) for b in best]


def _through(x: np.ndarray, y: np.ndarray, i: int, vx: float, vy: float) -> dict:
    return {"vx": vx, "vy": vy, "x0": float(x[i]), "y0": float(y[i])}


def best_pairs(x: np.ndarray, y: np.ndarray, near: float, k: int, least: int, ratio: float | None, iterations: int | None, seed: int) -> list[dict]:
    """The k lines through two of the points with the most inliers, ties by the order of the pairs; with a ratio the
    search ends with the first batch after which the best line has that share of the points."""
    found = _best(x, y, near, k, least, ratio, iterations, seed)
    return [{"n": n, "i": i, "j": j, "line": _through(x, y, i, vx, vy), "refit": huber_of(x[at], y[at]), "inliers": at} for n, i, j, vx, vy, at in found]


def best_lines(x: np.ndarray, y: np.ndarray, near: float, k: int, iterations: int | None, seed: int) -> list[tuple[dict, dict, int]]:
    """(line, refit, n) of best_pairs()."""
    found = _best(x, y, near, k, 2, None, iterations, seed)
    refits = hubers_of(x, y, _lit([at for *_, at in found], len(x)))
    return [(_through(x, y, i, vx, vy), refit, n) for (n, i, _, vx, vy, _), refit in zip(found, refits, strict=True)]


def best_clusters(x: np.ndarray, y: np.ndarray, near: float, k: int, iterations: int | None, seed: int, most: int | None = None, overlap: float = OVERLAP) -> list[dict]:
    """merged() of the k lines that best_pairs() finds, as values; the first most of them, as only these are refitted."""
    found = [at for *_, at in _best(x, y, near, k, 2, None, iterations, seed)]
    lit = _lit(found, len(x))
    shared, used, unions = lit @ lit.T, set(), []
    for seed_ in range(len(found)):
        if seed_ not in used:
            members = [m for m in range(seed_ + 1, len(found)) if m not in used and shared[seed_, m] / max(len(found[seed_]), len(found[m])) > overlap]
            used |= {seed_, *members}
            unions.append(np.flatnonzero(lit[[seed_, *members]].any(axis=0)))
    unions.sort(key=len, reverse=True)  # the earlier of equals stays first
    return [{"cluster": c, "line": huber_of(x[at], y[at]), "confidence": len(at) / len(x), "n": len(at)} for c, at in enumerate(unions[:most], start=1)]


def _rows(xs: pa.Array, ys: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The coordinates of each row; none for null."""
    for a, b in zip(xs, ys, strict=True):
        yield (a.values.to_numpy(zero_copy_only=False), b.values.to_numpy(zero_copy_only=False)) if a.is_valid else (np.empty(0), np.empty(0))


def searched(points: Column, near: float = INLIER, k: int = TOP_K, least: int = 2, ratio: float | None = None, iterations: int | None = None, seed: int = 0) -> Column:
    """FOUND: the k best lines through two of a frame's points, the most inliers first, each with its inliers and their
    Huber fit; none for null or one point.

    iterations: so many pairs drawn with the seed instead of all, where there are more. ratio: stop early, batch by batch.
    """

    @F.arrow_udf(FOUND)
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for xs, ys in batches:
            yield pa.array([best_pairs(x, y, near, k, least, ratio, iterations, seed) for x, y in _rows(xs, ys)], FOUND_ARROW)

    return of(F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"]))


def huber_batched(points: Column) -> Column:
    """huber() on Arrow batches, for many points; it can't stand inside lambdas."""

    @F.arrow_udf("struct<vx:double,vy:double,x0:double,y0:double>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for xs, ys in batches:
            yield pa.array([huber_of(x, y) if len(x) >= 2 else None for x, y in _rows(xs, ys)], _LINE)

    return of(F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"]))


def hypotheses(frames: DataFrame, keys: list[str], points: str = "points", limit: float = INLIER, least: int = 2) -> DataFrame:
    """keys, points, i, j, line, inliers, n: a line through each pair of different points of a frame, the places of the
    points nearer than limit, and their number, where that is least or more."""
    n = F.size(points)
    first = frames.filter(n >= 2).select(*keys, points, F.explode(F.sequence(F.lit(0), n - 2)).alias("i"))
    pairs = first.select(*keys, points, "i", F.explode(F.sequence(F.col("i") + 1, n - 1)).alias("j"))
    p, q = F.col(points)[F.col("i")], F.col(points)[F.col("j")]
    size = F.hypot(q["x"] - p["x"], q["y"] - p["y"])
    lined = pairs.withColumn("line", F.when(size > 1e-6, line((q["x"] - p["x"]) / size, (q["y"] - p["y"]) / size, p["x"], p["y"]))).filter("line IS NOT NULL")
    near = let(F.col("line"), lambda ln: F.filter(F.transform(F.col(points), lambda r, k: F.when(F.round(distance(r, ln), 9) < limit, k)), lambda k: k.isNotNull()))
    return lined.withColumn("inliers", near).withColumn("n", F.size("inliers")).filter(F.col("n") >= least)


def top_k(hyps: DataFrame, keys: list[str], k: int = TOP_K) -> DataFrame:
    """The k hypotheses with the most inliers of each key, rank from 1; ties by the pair."""
    order = W.partitionBy(*keys).orderBy(F.desc("n"), "i", "j")
    return hyps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def early_stop(hyps: DataFrame, keys: list[str], points: str = "points", batch: int = BATCH, ratio: float = ENOUGH) -> DataFrame:
    """The best hypothesis of the batches, in pair order, up to the first whose best reaches the ratio of all points.

    All hypotheses are there already: searched() with a ratio is the form that saves the work after the stop.
    """
    by = W.partitionBy(*keys)
    seq = hyps.withColumn("batch", F.floor((F.row_number().over(by.orderBy("i", "j")) - 1) / batch))
    so_far = F.max("n").over(by.orderBy("batch").rangeBetween(W.unboundedPreceding, W.currentRow))
    enough = F.floor(ratio * F.size(points)).cast("int")
    seq = seq.withColumn("best", so_far).withColumn("stop", F.min(F.when(F.col("best") >= enough, F.col("batch"))).over(by))
    kept = seq.filter(F.col("stop").isNull() | (F.col("batch") <= F.col("stop")))
    return kept.withColumn("rank", F.row_number().over(by.orderBy(F.desc("n"), "i", "j"))).filter("rank = 1").drop("best", "stop", "rank")


def merged(found: Column, points: Column, overlap: float = OVERLAP) -> Column:
    """array of struct(cluster, line, confidence, n): hypotheses merged greedily, the largest first, each taking those
    not yet taken whose inliers it shares by more than overlap of the larger of the two; refitted on the union of their
    inliers; the largest union first, the earlier seed of equals.

    found: few a frame, the most inliers first, as from searched(). Empty for none.
    """

    def of(h: Column) -> Column:
        zero = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<array<int>>").alias("unions"))

        def step(s: Column, k: Column) -> Column:
            seed = h[k]["inliers"]
            joins = lambda m: (m > k) & ~F.array_contains(s["used"], m) & (F.size(F.array_intersect(seed, h[m]["inliers"])) / F.greatest(F.size(seed), F.size(h[m]["inliers"])) > overlap)
            members = F.filter(indices(F.size(h)), joins)
            union = F.array_sort(F.array_distinct(F.flatten(F.concat(F.array(seed), F.transform(members, lambda m: h[m]["inliers"])))))
            return F.when(F.array_contains(s["used"], k), s).otherwise(F.struct(F.concat(s["used"], F.array(k), members).alias("used"), F.concat(s["unions"], F.array(union)).alias("unions")))

        return F.aggregate(indices(F.size(h)), zero, step, lambda s: s["unions"])

    ordered = F.array_sort(F.transform(let(found, of), lambda u, k: F.struct((-F.size(u)).alias("neg"), k.alias("seed"), u.alias("inliers"))))
    return F.transform(ordered, lambda c, k: F.struct((k + 1).alias("cluster"), huber(inlier_points(points, c["inliers"])).alias("line"), (F.size(c["inliers"]) / F.size(points)).alias("confidence"), F.size(c["inliers"]).alias("n")))


def clusters(hyps: DataFrame, keys: list[str], points: str = "points", overlap: float = OVERLAP) -> DataFrame:
    """keys, cluster, line, confidence, n: merged() of hypotheses that are rows, few a frame, as from top_k()."""
    entry = F.struct((-F.col("n")).alias("neg"), F.col("i"), F.col("j"), F.col("inliers"))
    per = hyps.groupBy(*keys).agg(F.first(points).alias(points), F.array_sort(F.collect_list(entry)).alias("h"))
    return per.select(*keys, F.explode(merged(F.col("h"), F.col(points), overlap)).alias("c")).select(*keys, "c.*")


def ranked_results(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys and the array of the n best clusters; empty where none is."""
    return found.filter(F.col("cluster") <= n).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cluster", "line", "confidence"))).alias("results"))


def inlier_points(points: Column, inliers: Column) -> Column:
    return F.transform(inliers, lambda k: points[k])


def centre(points: Column) -> Column:
    return F.struct(mean(F.transform(points, lambda q: q["x"])).alias("x"), mean(F.transform(points, lambda q: q["y"])).alias("y"))
