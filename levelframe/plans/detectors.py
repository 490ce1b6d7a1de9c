"""Ten detection pipelines, composed from the operators.

Frames are rows of frame_id, img (the light plane) and raw (a second plane), arrays of height x width. Each pipeline
returns one row a frame: frame_id, status (failed, no_horizon, line), line, confidence, inliers, and latency_ms, the
time that the frame took in the kernels on Arrow batches. All work is inside the frame's row: no pipeline shuffles but
a8 to a10, which order the frames of a clip. Point-pair search draws Shape.iterations pairs of at most max_points points
with a seed, or looks at all pairs.

Frames may bring the planes of a likelihood stack (STACK; a7 and a8 read the first three); without them img and raw are
the stack. Planes that follow from less are made in the kernels (Shape.source) and never are columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelframe.functions import lines
from levelframe.functions.arrays import let
from levelframe.operators import batches, fits, regions, scoring, temporal

LINE = batches.LINE
FALLBACK = 0.30
#: A frame's milliseconds in kernels so far.
TOOK = "__took"
#: Fixed value: point pairs that a search draws.
ITERATIONS = 300
STACK = ("light", "a", "b", "saturation", "blue_excess")


@dataclass(frozen=True)
class Shape:
    """Size of the frames, of the morphology window, the distance of an inlier, and the parameters of the search.

    iterations: pairs drawn with the seed; None looks at all. enough: the share of points that ends an early-stop search.
    thumb: (height, width) to which likelihood candidates reduce their planes, and a sign that coherence and scenes
    reduce theirs (regions.COHERENCE_SIZE, SCENE_SIZE); None works on whole frames.
    source: for frames that bring no planes, the columns of which they are made, and a function of (height, width, names)
    that gives the function of the columns' values that makes the named planes (sources.frames.made_planes).
    """

    height: int
    width: int
    window: int = 9
    near: float = fits.INLIER
    max_points: int = fits.MAX_POINTS
    clip: tuple[str, ...] = ()
    iterations: int | None = ITERATIONS
    seed: int = 0
    top: int = fits.TOP_K
    enough: float = fits.ENOUGH
    thumb: tuple[int, int] | None = None
    source: tuple[tuple[str, ...], Callable[[int, int, tuple[str, ...]], Callable]] | None = None

    def planes(self, *names: str, when: Column | None = None) -> list[Column | batches.Planes]:
        """The named planes as a kernel's first inputs; null where when is not true."""
        columns = [F.col(c) if when is None else F.when(when, F.col(c)) for c in (self.source[0] if self.source else names)]
        return [batches.Planes(tuple(columns), self.source[1](self.height, self.width, names))] if self.source else columns

    def search(self, points: Column, k: int, ratio: float | None = None) -> Column:
        return batches.search(points, self.near, k, ratio=ratio, iterations=self.iterations, seed=self.seed)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later filters and projections read instead of computing it again."""
    return df.withColumn(name, F.explode(F.array(value)))


def timed(df: DataFrame, name: str, found: Column) -> DataFrame:
    """df with the value of a clocked kernel, its milliseconds added to those of the frame so far."""
    so_far = F.col(TOOK) if TOOK in df.columns else F.lit(0.0)
    return once(df, "__t", found).withColumns({name: F.col("__t.value"), TOOK: so_far + F.coalesce("__t.ms", F.lit(0.0))}).drop("__t")


def result(df: DataFrame, line: Column, confidence: Column, inliers: Column, abstain: Column | None = None) -> DataFrame:
    status = F.when(abstain, "no_horizon") if abstain is not None else F.when(F.lit(False), "")
    out = df.withColumn("__l", line).withColumn("status", status.when(F.col("__l").isNull(), "failed").otherwise("line"))
    ok = F.col("status") == "line"
    took = F.col(TOOK) if TOOK in df.columns else F.lit(None).cast("double")
    return out.select("frame_id", "status", F.when(ok, F.col("__l")).alias("line"), F.when(ok, confidence.cast("double")).alias("confidence"), F.when(ok, inliers.cast("int")).alias("inliers"), took.alias("latency_ms"))


def a1(frames: DataFrame, s: Shape) -> DataFrame:
    """Columns' first ground row, least squares."""
    df = with_points(frames, s, how="scan").withColumn("f", fits.ols(F.col("points")))
    line = F.when(F.col("f").isNotNull(), lines.angle_intercept_line(F.degrees(F.atan(F.col("f.slope"))), F.col("f.intercept")))
    return result(df, line, F.lit(1.0), F.size("points"))


def with_points(frames: DataFrame, s: Shape, plane: str = "img", points: str = "points", how: str = "all") -> DataFrame:
    """frames with the points of the plane's mask and its larger class's share (points + "_balance")."""
    df = timed(frames, "__e", batches.edges(*s.planes(plane), s.height, s.width, s.window, how))
    return df.withColumns({points: F.col("__e.points"), f"{points}_balance": F.col("__e.balance")}).drop("__e")


def a2(frames: DataFrame, s: Shape) -> DataFrame:
    """Robust orthogonal fit of all boundary points."""
    df = with_points(frames, s)
    return result(timed(df, "fit", batches.huber(F.col("points"))), F.col("fit"), F.lit(1.0), F.size("points"))


def sampled(df: DataFrame, points: str, s: Shape) -> DataFrame:
    return once(df, points, fits.subsample(F.col(points), F.col("frame_id"), s.max_points))


def clustered(frames: DataFrame, s: Shape, cap: bool, n: int) -> DataFrame:
    """frame_id, clusters: array of struct(cluster, line, confidence, n), the n surest first."""
    df = with_points(frames, s).select("frame_id", "points", TOOK)
    df = sampled(df, "points", s) if cap else df
    return timed(df, "clusters", batches.clusters(F.col("points"), s.near, s.top, n, s.iterations, s.seed)).select("frame_id", "clusters", TOOK)


def top_n(frames: DataFrame, s: Shape, n: int, cap: bool = True) -> DataFrame:
    """frame_id, results: the n surest clusters of each frame; empty where none is."""
    return clustered(frames, s, cap, n).select("frame_id", F.col("clusters").alias("results"))


def a3(frames: DataFrame, s: Shape, cap: bool = False) -> DataFrame:
    """Point pairs, clustered by shared inliers, the largest cluster."""
    best = once(clustered(frames, s, cap, 1), "c", F.get("clusters", F.lit(0)))
    return result(best, F.col("c.line"), F.col("c.confidence"), F.col("c.n"))


def a4(frames: DataFrame, s: Shape) -> DataFrame:
    """As a3, on at most max_points points."""
    return a3(frames, s, cap=True)


def with_best(frames: DataFrame, s: Shape, plane: str, name: str) -> DataFrame:
    """frames with struct(line, confidence, n) of the plane's early-stop search, null where no pair fits."""
    points = f"__points_{name}"
    df = sampled(with_points(frames, s, plane, points), points, s)
    df = timed(df, "__found", s.search(F.col(points), 1, s.enough))
    best, p = F.get("__found", F.lit(0)), F.col(points)
    found = F.struct(best["refit"].alias("line"), (best["n"] / F.size(p)).alias("confidence"), best["n"].alias("n"))
    return once(df, name, F.when(F.size("__found") > 0, found)).drop(points, f"{points}_balance", "__found")


def a5(frames: DataFrame, s: Shape) -> DataFrame:
    """The best point pair of the batches up to the first that is good enough."""
    df = with_best(frames, s, "img", "best")
    return result(df, F.col("best.line"), F.col("best.confidence"), F.col("best.n"))


def surer(first: Column, second: Column) -> Column:
    """Of two structs with a confidence the greater, the first of equals; null where neither is or the confidence is
    below FALLBACK."""
    won = F.when(F.coalesce(second["confidence"] > first["confidence"], first.isNull()), second).otherwise(first)
    return F.when(won["confidence"] >= FALLBACK, won)


def a6(frames: DataFrame, s: Shape) -> DataFrame:
    """As a5 on both planes, the surer one; below FALLBACK the row with the most vertical change."""
    df = with_best(with_best(frames, s, "img", "best_l"), s, "raw", "best_b")
    df = once(df, "best", surer(F.col("best_l"), F.col("best_b")))
    df = timed(df, "peak", batches.row_energy_peak(*s.planes("img", when=F.col("best").isNull()), s.height, s.width))
    return result(df, F.coalesce(F.col("best.line"), lines.line(1.0, 0.0, 0.0, F.col("peak"))), F.coalesce("best.confidence", F.lit(0.0)), F.coalesce("best.n", F.lit(0)))


def pool(frames: DataFrame, s: Shape, path: bool, sky: bool) -> DataFrame:
    """frame_id, degenerate, thumb and candidates of each frame: the best point pairs of both planes, and by choice the
    line of the likeliest boundary path and that under the top-connected sky. The score is region coherence, on the
    light and colour planes where frames bring them.

    Candidates carry the refit line, which is what a later frame compares with. A degenerate frame has none.
    """
    stack = STACK if path or sky else STACK[:3]  # the rest is for path and sky alone
    planes, edged, compared = (stack, (0, 2), 3) if s.source or set(stack) <= set(frames.columns) else (("img", "raw"), (0, 1), 2)
    size = (min(regions.COHERENCE_SIZE[0], s.height), min(regions.COHERENCE_SIZE[1], s.width)) if s.thumb else (s.height, s.width)
    sizes = {"candidates": s.thumb, "planes": size, "thumb": regions.SCENE_SIZE} if s.thumb else None
    views = batches.views_of(s.planes(*planes), s.height, s.width, s.window, edged, compared, sizes, path, sky)
    both = timed(frames.select("frame_id", *s.clip, *(c for c in (s.source[0] if s.source else planes) if c != "frame_id")), "v", views)
    fields = {k: F.col(f"v.{k}") for k in ("edges", "path", "sky", "planes", "thumb")} | {"degenerate": F.coalesce("v.degenerate", F.lit(False))}
    both = both.select("frame_id", *s.clip, TOOK, *(c.alias(f"v_{k}") for k, c in fields.items()))
    for k, name in enumerate(("L", "b")):
        edge = F.col("v_edges")[k]
        points = F.when(~F.col("v_degenerate"), F.zip_with(edge["x"], edge["y"], lambda x, y: F.struct(x.alias("x"), y.alias("y"))))
        both = sampled(both.withColumn(f"points_{name}", points), f"points_{name}", s)
    least = min(scoring.LEAST_SIDE, s.height * s.width // 4)
    edges = {name: F.col(f"points_{name}") for name in ("L", "b")}
    found = {name: F.col(f"v_{name}") for wanted, name in ((path, "path"), (sky, "sky")) if wanted}
    both = timed(both, "scored", batches.judged(F.col("v_planes"), edges, found, size, (s.height, s.width), s.near, s.top, least, s.iterations, s.seed))
    live = F.filter("scored", lambda c: scoring.gate(c["source"], c["raw"], c["line"]))
    as_candidate = F.transform(live, lambda c: F.struct(c["source"].alias("source"), scoring.place_of(c["source"], c["rank"]).alias("place"), c["raw"].alias("raw"), c["refit"].alias("line"), c["count"].alias("count")))
    return both.select("frame_id", F.col("v_degenerate").alias("degenerate"), F.col("v_thumb").alias("thumb"), *s.clip, TOOK, as_candidate.cast(f"array<{temporal.CANDIDATE}>").alias("candidates"))


def _chosen(df: DataFrame) -> DataFrame:
    r = F.col("result")
    return result(df, r["line"], F.least(F.lit(1.0), r["raw"] / (1 + r["raw"])), r["count"], abstain=r.isNull())


def a7(frames: DataFrame, s: Shape) -> DataFrame:
    """The pool's most coherent line, or none below the floor."""
    df = pool(frames, s, False, False)
    return _chosen(df.withColumn("result", temporal.chosen(F.col("candidates"), F.lit(None).cast(LINE), s.height, s.width, scoring.FLOORS[7])))


def smoothed(frames: DataFrame, s: Shape, path: bool, sky: bool, floor: float) -> DataFrame:
    """The pool's winners with the line before as a prior, scene by scene, frames in the order of frame_id."""
    df = temporal.scenes(pool(frames, s, path, sky), ["frame_id"], "thumb", list(s.clip))
    return _chosen(temporal.fold(df, [*s.clip, "scene"], "frame_id", s.height, s.width, floor, keep=(TOOK,)))


def a8(frames: DataFrame, s: Shape) -> DataFrame:
    return smoothed(frames, s, False, False, scoring.FLOORS[8])


def a9(frames: DataFrame, s: Shape) -> DataFrame:
    return smoothed(frames, s, True, False, scoring.FLOORS[9])


def a10(frames: DataFrame, s: Shape) -> DataFrame:
    return smoothed(frames, s, True, True, scoring.FLOORS[10])


#: name -> (pipeline, whether it draws with Shape.seed).
REGISTRY = {f"a{k}": (f, k > 2) for k, f in enumerate((a1, a2, a3, a4, a5, a6, a7, a8, a9, a10), start=1)}
