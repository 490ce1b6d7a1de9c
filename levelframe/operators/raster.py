"""Raster operators on frames held as row-major arrays: struct-free columns, one frame a row.

Every operator is an expression over the frame's own array, so a pipeline of them is one stage without shuffles.
height and width are constants of a table of equal frames. Borders: windows of minimum and maximum leave out what lies
outside, weighted windows mirror it without repeating the edge.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from levelframe.functions.arrays import indices, let

GAUSS = (1, 4, 6, 4, 1)


def _places(height: int, width: int) -> Column:
    return indices(height * width)


def _mirror(i: Column, n: int) -> Column:
    inside = F.abs(i)
    return F.when(inside > n - 1, 2 * (n - 1) - inside).otherwise(inside)


def transposed(img: Column, height: int, width: int) -> Column:
    return let(img, lambda a: F.transform(_places(height, width), lambda i: a[(i % height) * width + (i / height).cast("int")]))


def _rows(img: Column, height: int, width: int, best) -> Column:
    return let(img, lambda a: F.transform(_places(height, width), lambda i: best(a, (i / width).cast("int"), i % width)))


def _extreme(img: Column, height: int, width: int, radius: int, pick) -> Column:
    def along(a: Column, w: int):
        def at(a: Column, y: Column, x: Column) -> Column:
            lo = F.greatest(x - radius, F.lit(0))
            return pick(F.slice(a, y * w + lo + 1, F.least(x + radius, F.lit(w - 1)) - lo + 1))

        return at

    across = _rows(img, height, width, along(img, width))
    return transposed(_rows(transposed(across, height, width), width, height, along(img, height)), width, height)


def dilate(img: Column, height: int, width: int, size: int = 9) -> Column:
    return _extreme(img, height, width, size // 2, F.array_max)


def erode(img: Column, height: int, width: int, size: int = 9) -> Column:
    return _extreme(img, height, width, size // 2, F.array_min)


def close(img: Column, height: int, width: int, size: int = 9) -> Column:
    return erode(dilate(img, height, width, size), height, width, size)


def open_(img: Column, height: int, width: int, size: int = 9) -> Column:
    return dilate(erode(img, height, width, size), height, width, size)


def _ellipse(img: Column, height: int, width: int, pick) -> Column:
    """An extreme of the ellipse 5 wide and 3 high: the row's five places and those above and below."""

    def at(a: Column, y: Column, x: Column) -> Column:
        lo = F.greatest(x - 2, F.lit(0))
        row = F.slice(a, y * width + lo + 1, F.least(x + 2, F.lit(width - 1)) - lo + 1)
        return pick(F.concat(row, F.array(a[F.greatest(y - 1, F.lit(0)) * width + x], a[F.least(y + 1, F.lit(height - 1)) * width + x])))

    return _rows(img, height, width, at)


def smoothed_by_ellipse(img: Column, height: int, width: int) -> Column:
    """Close, then open with the 5 x 3 ellipse."""
    out = img
    for pick in (F.array_max, F.array_min, F.array_min, F.array_max):
        out = _ellipse(out, height, width, pick)
    return out


def gradient(img: Column, height: int, width: int) -> Column:
    """Dilation less erosion, 3 x 3."""
    return let(img, lambda a: F.zip_with(dilate(a, height, width, 3), erode(a, height, width, 3), lambda p, q: p - q))


def _weighted(img: Column, height: int, width: int, taps: tuple) -> Column:
    """A weighted window along the rows."""
    r = len(taps) // 2

    def at(a: Column, y: Column, x: Column) -> Column:
        out = F.lit(0.0)
        for k, t in enumerate(taps):
            if t:
                out = out + F.lit(float(t)) * a[y * width + _mirror(x + (k - r), width)]
        return out

    return _rows(img, height, width, at)


def separable(img: Column, height: int, width: int, across: tuple, down: tuple) -> Column:
    return transposed(_weighted(transposed(_weighted(img, height, width, across), height, width), width, height, down), width, height)


def gaussian(img: Column, height: int, width: int) -> Column:
    """5 x 5 binomial blur, rounded to whole values."""
    return F.transform(separable(img, height, width, GAUSS, GAUSS), lambda v: F.floor(v / 256 + 0.5).cast("int"))


def sobel_x(img: Column, height: int, width: int) -> Column:
    return separable(img, height, width, (-1, 0, 1), (1, 2, 1))


def sobel_y(img: Column, height: int, width: int) -> Column:
    return separable(img, height, width, (1, 2, 1), (-1, 0, 1))


def box_mean(img: Column, height: int, width: int) -> Column:
    return F.transform(separable(img, height, width, (1,) * 5, (1,) * 5), lambda v: v / 25)


def otsu_threshold(img: Column) -> Column:
    """The least threshold with the greatest variance between classes; 0 for a flat image. White is above it."""

    def of(s: Column) -> Column:
        n = F.size(s)
        whole = F.aggregate(s, F.lit(0).cast("long"), lambda t, v: t + v)

        def seen(sums: Column) -> Column:
            zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("t"))

            def step(a: Column, v: Column) -> Column:
                m, t = a["n"] + 1, a["sum"] + v
                last = (m == n) | (F.get(s, m.cast("int")) == v)
                spread = (sums * m - n * t).cast("double")
                var = F.when(last, F.lit(-1.0)).otherwise(spread * spread / (m * (n - m)).cast("double"))
                better = var > a["best"]
                return F.struct(m.alias("n"), t.alias("sum"), F.when(better, var).otherwise(a["best"]).alias("best"), F.when(better, v.cast("int")).otherwise(a["t"]).alias("t"))

            return F.aggregate(s, zero, step, lambda a: a["t"])

        return let(whole, seen)

    return let(F.array_sort(img), of)


def above(img: Column, threshold: Column) -> Column:
    """255 where the value is over the threshold, else 0."""
    return let(threshold, lambda t: F.transform(img, lambda v: F.when(v > t, 255).otherwise(0)))


def area_resize(img: Column, height: int, width: int, by: int) -> Column:
    """Means of by x by blocks."""
    h, w = height // by, width // by

    def block(a: Column, i: Column) -> Column:
        y, x = (i / w).cast("int") * by, (i % w) * by
        out = F.lit(0.0)
        for dy in range(by):
            for dx in range(by):
                out = out + a[(y + dy) * width + x + dx]
        return out / (by * by)

    return let(img, lambda a: F.transform(indices(h * w), lambda i: block(a, i)))


def area_resized(img: Column, height: int, width: int, to_height: int, to_width: int) -> Column:
    """Means of what each new place covers, for any ratio; shares of cut cells are whole numbers until the end."""

    def along(a: Column, rows: int, n: int, m: int) -> Column:
        def at(i: Column) -> Column:
            row, k = (i / m).cast("int"), i % m
            cells = F.sequence(F.floor(k * n / m).cast("int"), F.ceil((k + 1) * n / m).cast("int") - 1)
            share = lambda j: F.least((k + 1) * n, (j + 1) * m) - F.greatest(k * n, j * m)
            return F.aggregate(cells, F.lit(0.0), lambda t, j: t + a[row * n + j] * share(j)) / n

        return F.transform(indices(rows * m), at)

    across = let(img, lambda a: along(a, height, width, to_width))
    return transposed(let(transposed(across, height, to_width), lambda a: along(a, to_width, height, to_height)), to_width, to_height)


def nearest_resize(img: Column, height: int, width: int, to_height: int, to_width: int) -> Column:
    at = lambda i: F.floor((i / to_width).cast("int") * height / to_height).cast("int") * width + F.floor((i % to_width) * width / to_width).cast("int")
    return let(img, lambda a: F.transform(indices(to_height * to_width), lambda i: a[at(i)]))


def without_border(img: Column, height: int, width: int) -> Column:
    edge = lambda i: ((i / width).cast("int") == 0) | ((i / width).cast("int") == height - 1) | (i % width == 0) | (i % width == width - 1)
    return F.transform(img, lambda v, i: F.when(edge(i), F.lit(0)).otherwise(v))


def points(img: Column, width: int) -> Column:
    """The places of non-zero values, row by row, as array of struct(x, y)."""
    hit = F.filter(F.transform(img, lambda v, i: F.when(v != 0, i)), lambda i: i.isNotNull())
    return F.transform(hit, lambda i: F.struct((i % width).cast("double").alias("x"), (i / width).cast("int").cast("double").alias("y")))


def balance(mask: Column) -> Column:
    """The larger class's share."""
    share = F.size(F.filter(mask, lambda v: v > 0)) / F.size(mask)
    return F.greatest(share, 1 - share)


def column_scan(mask: Column, height: int, width: int) -> Column:
    """The first ground row of each column that has both classes, as array of struct(x, y)."""

    def of(m: Column) -> Column:
        column = lambda x: F.transform(indices(height), lambda y: m[y * width + x] > 0)
        first = lambda x: F.array_position(column(x), F.lit(False)) - 1
        both = lambda x: F.array_contains(column(x), F.lit(True)) & F.array_contains(column(x), F.lit(False))
        return F.transform(F.filter(indices(width), both), lambda x: F.struct(x.cast("double").alias("x"), first(x).cast("double").alias("y")))

    return let(mask, of)


def first_ground(mask: Column, height: int, width: int) -> Column:
    """The first ground row of each column, height where there is none."""
    return let(mask, lambda m: F.transform(indices(width), lambda x: F.coalesce(F.array_min(F.transform(indices(height), lambda y: F.when(m[y * width + x] == 0, y))), F.lit(height))))


def path_mask(path: Column, height: int, width: int) -> Column:
    """Sky above a boundary row for each column."""
    return let(path, lambda p: F.transform(indices(height * width), lambda i: F.when((i / width).cast("int") < p[i % width], 255).otherwise(0)))


def lower_envelope(mask: Column, height: int, width: int) -> Column:
    """The last sky row of each column with sky, as array of struct(x, y)."""

    def of(m: Column) -> Column:
        last = lambda x: F.array_max(F.transform(indices(height), lambda y: F.when(m[y * width + x] > 0, y)))
        found = F.transform(indices(width), lambda x: F.struct(x.cast("double").alias("x"), last(x).cast("double").alias("y")))
        return F.filter(found, lambda p: p["y"].isNotNull())

    return let(mask, of)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two masks; 1 for two empty ones."""
    both = F.size(F.filter(F.zip_with(a, b, lambda p, q: (p > 0) & (q > 0)), lambda t: t))
    any_ = F.size(F.filter(F.zip_with(a, b, lambda p, q: (p > 0) | (q > 0)), lambda t: t))
    return F.when(any_ == 0, 1.0).otherwise(both / any_)


def stretched(img: Column) -> Column:
    lo, hi = F.array_min(img).cast("double"), F.array_max(img).cast("double")
    return let(lo, lambda lo: let(hi, lambda hi: F.transform(img, lambda v: F.floor((v - lo) / F.greatest(hi - lo, F.lit(1e-6)) * 255).cast("int"))))


def components(mask: Column, height: int, width: int) -> Column:
    """8-connected components: each lit place gets the least place of its component, others -1.

    Least labels spread by one step a pass, until as many passes as places: for thumbnails.
    """
    n = height * width

    def spread(a: Column, i: Column) -> Column:
        y, x = (i / width).cast("int"), i % width
        near = []
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                inside = (y + dy >= 0) & (y + dy < height) & (x + dx >= 0) & (x + dx < width)
                label = F.get(a, (y + dy) * width + x + dx)
                near.append(F.when(inside & (label >= 0), label))
        return F.when(a[i] >= 0, F.least(*near)).otherwise(F.lit(-1))

    start = F.transform(mask, lambda v, i: F.when(v > 0, i).otherwise(F.lit(-1)))
    # a pass that changes nothing is the last that works: later ones copy
    zero = F.struct(start.alias("a"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        new = F.when(s["done"], s["a"]).otherwise(F.transform(indices(n), lambda i: spread(s["a"], i)))
        return let(new, lambda a: F.struct(a.alias("a"), (a == s["a"]).alias("done")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), zero, step, lambda s: s["a"])


def top_connected(mask: Column, height: int, width: int) -> Column:
    """Only the components that touch the two top rows."""

    def of(labels: Column) -> Column:
        top = F.filter(F.array_distinct(F.slice(labels, 1, 2 * width)), lambda v: v >= 0)
        return let(top, lambda t: F.transform(labels, lambda v: F.when(F.array_contains(t, v), 255).otherwise(0)))

    return let(components(mask, height, width), of)


def row_energy_peak(img: Column, height: int, width: int, taps: int = 15) -> Column:
    """The row with the greatest smoothed mean of absolute vertical gradients; the first of equals."""

    def of(g: Column) -> Column:
        energy = F.transform(indices(height), lambda y: F.aggregate(F.slice(g, y * width + 1, width), F.lit(0.0), lambda s, v: s + F.abs(v)) / width)

        def peak(e: Column) -> Column:
            r = taps // 2
            smooth = F.transform(indices(height), lambda y: F.aggregate(F.transform(F.sequence(F.lit(-r), F.lit(r)), lambda k: F.coalesce(F.when((y + k >= 0) & (y + k < height), e[F.least(F.greatest(y + k, F.lit(0)), F.lit(height - 1))]), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v))
            return let(F.transform(smooth, lambda v: F.round(v, 6)), lambda s: F.array_position(s, F.array_max(s)).cast("int") - 1)

        return let(energy, peak)

    return let(sobel_y(img, height, width), of)


def oriented(boundary: Column, soft_mask: Column, height: int, width: int, max_roll: float = 75.0, least: int = 8) -> Column:
    """The boundary places whose gradient is steep enough for a horizon; all of them if fewer than least remain."""
    limit = math.sin(math.radians(90 - max_roll)) ** 2
    count = lambda m: F.size(F.filter(m, lambda v: v != 0))

    def of(b: Column, m: Column) -> Column:
        keep = F.zip_with(sobel_x(m, height, width), sobel_y(m, height, width), lambda p, q: q * q > limit * (p * p + q * q + 1e-6))
        filtered = F.zip_with(b, keep, lambda v, k: F.when(k, v).otherwise(F.lit(0)))
        return let(filtered, lambda f: F.when((count(b) > least) & (count(f) >= least), f).otherwise(b))

    return let(boundary, lambda b: let(soft_mask, lambda m: of(b, m)))


def bgr_gray(b: Column, g: Column, r: Column) -> Column:
    return F.floor(0.114 * b + 0.587 * g + 0.299 * r + 0.5).cast("int")


def saturation(b: Column, g: Column, r: Column) -> Column:
    hi, lo = F.greatest(b, g, r), F.least(b, g, r)
    return F.when(hi == 0, 0).otherwise(F.floor((hi - lo) * 255.0 / F.nullif(hi, F.lit(0)) + 0.5).cast("int"))


def blue_excess(b: Column, r: Column) -> Column:
    return 128.0 + 128.0 * (b - r) / (b + r + 1.0)


def lab(b: Column, g: Column, r: Column) -> Column:
    """struct(l, a, b) of 8-bit values, scaled to 0 .. 255 with 128 for neutral a and b (D65, sRGB)."""
    linear = lambda c: F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4)))
    rl, gl, bl = linear(r), linear(g), linear(b)
    root = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116)
    x = root((0.412453 * rl + 0.357580 * gl + 0.180423 * bl) / 0.950456)
    y_lin = 0.212671 * rl + 0.715160 * gl + 0.072169 * bl
    y, z = root(y_lin), root((0.019334 * rl + 0.119193 * gl + 0.950227 * bl) / 1.088754)
    light = F.when(y_lin > 0.008856, 116 * F.cbrt(y_lin) - 16).otherwise(903.3 * y_lin)
    byte = lambda v: F.least(F.greatest(F.bround(v), F.lit(0.0)), F.lit(255.0)).cast("int")
    return F.struct(byte(light * 255 / 100).alias("l"), byte(500 * (x - y) + 128).alias("a"), byte(200 * (y - z) + 128).alias("b"))
