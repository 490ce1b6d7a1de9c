"""Sky and ground likelihoods and the boundary path with the most support.

Features are arrays of planes, each a frame's array; all is computed inside the frame's row. regions has the kernels for
frames of any size, with the same values, and the candidates from them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from levelframe.functions.arrays import indices, let, mean, median
from levelframe.operators import raster

LEAST_SCALE, MAD = 6.0, 1.4826
CLIP = 8.0
MAX_STEP, STEP_COST = 3, 0.35
SEPARATION_PATH, SEPARATION_SKY = 0.38, 0.24
PATH_MARGIN = 0.18
#: Fixed value: the weight of texture beside planes of bytes.
TEXTURE = 96.0


def location_scale(values: Column) -> Column:
    """struct(mu, scale): the median and the scaled median of distances from it, at least LEAST_SCALE."""

    def of(a: Column, mu: Column) -> Column:
        return F.struct(mu.alias("mu"), F.greatest(MAD * median(F.transform(a, lambda v: F.abs(v - mu))), F.lit(LEAST_SCALE)).alias("scale"))

    return let(values, lambda a: let(median(a), lambda mu: of(a, mu)))


def band_rows(height: int) -> tuple[int, int]:
    """Rows of the sky seed at the top and of the ground seed at the bottom."""
    return max(4, round(0.18 * height)), max(4, round(0.25 * height))


def seeds(plane: Column, height: int, width: int) -> tuple[Column, Column]:
    top, bottom = band_rows(height)
    return F.slice(plane, 1, top * width), F.slice(plane, (height - bottom) * width + 1, bottom * width)


def models(planes: Column, height: int, width: int) -> Column:
    """For each plane struct(sky, ground), each with mu and scale."""

    def of(plane: Column) -> Column:
        sky, ground = seeds(plane, height, width)
        return F.struct(location_scale(sky).alias("sky"), location_scale(ground).alias("ground"))

    return F.transform(planes, of)


def separation(model: Column) -> Column:
    """How far the two seeds are apart, in scales."""
    part = lambda m: F.pow((m["sky"]["mu"] - m["ground"]["mu"]) / (m["sky"]["scale"] + m["ground"]["scale"]), F.lit(2.0))
    return F.sqrt(mean(F.transform(model, part)))


def log_likelihood(value: Column, side: Column) -> Column:
    return -0.5 * (F.pow((value - side["mu"]) / side["scale"], F.lit(2.0)) + 2 * F.ln(side["scale"]))


def ratio(planes: Column, model: Column) -> Column:
    """Log-likelihood of sky over ground at each place, clipped."""

    def of(p: Column, m: Column) -> Column:
        def at(i: Column) -> Column:
            parts = F.zip_with(p, m, lambda q, k: log_likelihood(q[i].cast("double"), k["sky"]) - log_likelihood(q[i].cast("double"), k["ground"]))
            s = F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)
            return F.greatest(F.least(s, F.lit(CLIP)), F.lit(-CLIP))

        return F.transform(indices(F.size(p[0])), at)

    return let(planes, lambda p: let(model, lambda m: of(p, m)))


def split_scores(llr: Column, height: int, width: int, edge_cost: float = 2.0, edge: int = 3) -> Column:
    """For each column the score of each split row 0 .. height: what is above as sky, what is below as ground."""

    def of(r: Column) -> Column:
        def column(x: Column) -> Column:
            zero = F.struct(F.lit(0.0).alias("sum"), F.array(F.lit(0.0)).alias("sums"))
            sums = F.aggregate(indices(height), zero, lambda s, y: F.struct((s["sum"] + r[y * width + x]).alias("sum"), F.array_append(s["sums"], s["sum"] + r[y * width + x]).alias("sums")), lambda s: s["sums"])
            near_edge = lambda y: (y < edge) | (y > height - edge)
            return let(sums, lambda p: F.transform(p, lambda v, y: 2 * v - F.element_at(p, -1) - F.when(near_edge(y), F.lit(edge_cost)).otherwise(F.lit(0.0))))

        return F.transform(indices(width), column)

    return let(llr, of)


def best_path(scores: Column) -> Column:
    """struct(score, path): a split row for each column with the greatest sum, steps of at most MAX_STEP rows at a cost
    for each; of equal steps that from the least row, of equal ends the first."""

    def forward(sc: Column) -> Column:
        n = F.size(sc[0])
        zero = F.struct(sc[0].alias("best"), F.array().cast("array<array<int>>").alias("back"))

        def step(s: Column, column: Column) -> Column:
            def choose(v: Column, y: Column) -> Column:
                # step k comes from row y - k
                moves = F.filter(F.sequence(F.lit(-MAX_STEP), F.lit(MAX_STEP)), lambda k: (y - k >= 0) & (y - k < n))
                gains = F.transform(moves, lambda k: F.struct(F.round(s["best"][y - k] - STEP_COST * F.abs(k), 9).alias("g"), k.alias("k"), (y - k).alias("from")))
                return let(F.array_max(gains), lambda m: F.struct((m["g"] + v).alias("s"), m["from"].alias("from")))

            return let(F.transform(column, choose), lambda c: F.struct(F.transform(c, lambda q: q["s"]).alias("best"), F.array_append(s["back"], F.transform(c, lambda q: q["from"])).alias("back")))

        return F.aggregate(F.slice(sc, 2, F.size(sc)), zero, step)

    def trace(s: Column) -> Column:
        end = F.array_position(s["best"], F.array_max(s["best"])).cast("int") - 1
        path = F.aggregate(F.reverse(s["back"]), F.array(end), lambda p, b: F.concat(F.array(b[p[0]]), p))
        return F.struct(F.array_max(s["best"]).alias("score"), path.alias("path"))

    return let(scores, lambda sc: let(forward(sc), trace))


def texture_map(gray: Column, height: int, width: int) -> Column:
    """Local means of gradient size (across and down added), over its 95th percentile and clipped to 1."""
    size = let(gray, lambda a: F.zip_with(raster.sobel_x(a, height, width), raster.sobel_y(a, height, width), lambda p, q: F.abs(p) + F.abs(q)))

    def of(g: Column) -> Column:
        def scaled(s: Column) -> Column:
            at = F.lit(0.95) * (F.size(s) - 1)
            lo = F.floor(at).cast("int")
            p95 = s[lo] + (at - lo) * (F.get(s, F.least(lo + 1, F.size(s) - 1)) - s[lo])
            return let(F.greatest(p95, F.lit(1.0)), lambda t: raster.box_mean(F.transform(g, lambda v: F.least(v / t, F.lit(1.0))), height, width))

        return let(F.array_sort(g), scaled)

    return let(size, of)
