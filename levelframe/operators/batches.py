"""The raster, fit and scoring kernels of the detection pipelines on Arrow batches, for frames of any size.

Each is a column expression like those of raster, fits and scoring and gives the same values; the work is numpy on one
frame at a time, and Spark bounds a batch by its bytes. A null frame gives null. They can't stand inside lambdas.
clocked() forms give struct(value, ms) with the milliseconds that the frame took in the kernel. A plane is an array or
bytes, or is made in the task (Planes).
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from levelframe.functions.lines import VERTICAL
from levelframe.operators import fits, regions, scoring

_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_LINE = pa.struct([(k, pa.float64()) for k in ("vx", "vy", "x0", "y0")])
_CANDIDATE = pa.struct([("line", _LINE), ("count", pa.int32()), ("score", pa.float64())])
LINE = "struct<vx:double,vy:double,x0:double,y0:double>"
CANDIDATE = f"struct<line:{LINE},count:int,score:double>"


def _plain(v: pa.Scalar):
    """A list as an array, a list of lists as a list of arrays, bytes as an array of them, anything else as a Python value."""
    if not v.is_valid:
        return None
    if pa.types.is_binary(v.type):
        return np.frombuffer(v.as_buffer(), np.uint8)
    if not pa.types.is_list(v.type):
        return v.as_py()
    inner = v.values
    return [_plain(x) for x in inner] if pa.types.is_list(inner.type) else inner.to_pylist() if pa.types.is_struct(inner.type) else inner.to_numpy(zero_copy_only=False)


def _listed(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind)


@dataclass(frozen=True)
class Planes:
    """Planes as the first input of a kernel that decode makes, in the task, of the values of columns: what follows from
    less than its bytes need not cross to the task."""

    columns: tuple[Column, ...]
    decode: Callable[..., list]


#: Rows whose results cross to Spark at once.
AT_ONCE = 16


def clocked(kind: str, arrow: pa.DataType, of_row: Callable, *inputs: Column | Planes, build: Callable = _listed) -> Column:
    """struct(value, ms) of of_row(inputs of a row): null where it gives None; build makes an array of the values."""
    source = inputs[0] if isinstance(inputs[0], Planes) else None
    decode, n = (source.decode, len(source.columns)) if source else (lambda: [], 0)
    columns = [*source.columns, *inputs[1:]] if source else inputs

    @F.arrow_udf(f"struct<value:{kind},ms:double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            for lo in range(0, max(len(whole), 1), AT_ONCE):  # results may be larger than what they are made of
                values, took = [], []
                for row in zip(*whole.slice(lo, AT_ONCE).flatten(), strict=True):
                    given = [_plain(v) for v in row]
                    given = [*decode(*given[:n]), *given[n:]]
                    began = time.perf_counter()
                    values.append(of_row(*given))
                    took.append((time.perf_counter() - began) * 1000)
                yield pa.StructArray.from_arrays([build(values, arrow), pa.array(took, pa.float64())], ["value", "ms"])

    return of(F.struct(*(c.alias(f"c{k}") for k, c in enumerate(columns))))


def _reflected(a: np.ndarray, taps: tuple, axis: int) -> np.ndarray:
    """A weighted window along an axis; borders are mirrored without repeating the edge."""
    r = len(taps) // 2
    padded = np.pad(a, [(r, r) if k == axis else (0, 0) for k in (0, 1)], mode="reflect")
    n = a.shape[axis]
    part = lambda k: padded[k : k + n] if axis == 0 else padded[:, k : k + n]
    return sum(t * part(k) for k, t in enumerate(taps) if t)


def _dilated(a: np.ndarray, size: int) -> np.ndarray:
    return regions.extreme(a, size, np.maximum, 0)


def _eroded(a: np.ndarray, size: int) -> np.ndarray:
    return regions.extreme(a, size, np.minimum, 255)


def _counts(a: np.ndarray) -> np.ndarray:
    """How often each value from 0 to 255 (or more) occurs."""
    if a.dtype != np.uint8 or a.size % 2:
        return np.bincount(a.ravel(), minlength=256)
    two = np.bincount(a.ravel().view(np.uint16), minlength=1 << 16).reshape(256, 256)  # half as many steps
    return two.sum(axis=0) + two.sum(axis=1)


def _otsu(a: np.ndarray) -> int:
    counts = _counts(a)
    values = np.flatnonzero(counts)
    if len(values) < 2:
        return 0
    counts = counts[values]
    m, t, n, whole = np.cumsum(counts)[:-1], np.cumsum(values * counts)[:-1], a.size, int(values @ counts)
    spread = (whole * m - n * t).astype(np.float64)
    return int(values[np.argmax(spread * spread / (m * (n - m)))])


def _bytes(img: np.ndarray) -> np.ndarray:
    """A plane as bytes, if all of it are."""
    return img.astype(np.uint8) if img.dtype.kind in "iu" and img.dtype != np.uint8 and img.size and img.min() >= 0 and img.max() <= 255 else img


def _smooth(img: np.ndarray) -> np.ndarray:
    """The binomial window of five both ways, rounded."""
    taps = (1, 4, 6, 4, 1)
    if img.dtype != np.uint8:
        return (_reflected(_reflected(img.astype(np.int32), taps, 1), taps, 0) + 128) >> 8
    sums = np.pad(img, 2, mode="reflect").astype(np.uint16)
    for _ in range(4):  # a window of five is four of two; sums of bytes fit 16 bits: 255 * 256 + 128
        sums = sums[:, 1:] + sums[:, :-1]
    for _ in range(4):
        sums = sums[1:] + sums[:-1]
    sums += 128
    sums >>= 8
    return sums.astype(np.uint8)


def mask_of(img: np.ndarray, window: int, opened: bool) -> np.ndarray:
    smooth = _smooth(_bytes(img))
    mask = _dilated(np.multiply(smooth > _otsu(smooth), 255, dtype=np.uint8), window)
    # closed and opened: two erosions after each other are one of twice the reach
    return _dilated(_eroded(mask, 4 * (window // 2) + 1), window) if opened else _eroded(mask, window)


def edge_places(mask: np.ndarray, oriented: bool, max_roll: float = 75.0, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Columns and rows of the places of a mask's edge inside the frame, row by row; oriented: without those whose edge
    runs too steeply, if enough are left."""
    inner = (_dilated(mask, 3) != _eroded(mask, 3))[1:-1, 1:-1]
    y, x = np.divmod(np.flatnonzero(inner), max(inner.shape[1], 1))
    y, x = y + 1, x + 1
    if oriented and len(y) > least:
        limit = math.sin(math.radians(90 - max_roll)) ** 2
        # no edge lies on the border, so that every neighbour is there
        near = {(dy, dx): mask[y + dy, x + dx].astype(np.float64) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx}
        gx, gy = (sum(t * (near[(k, 1)[:: 1 - 2 * turn]] - near[(k, -1)[:: 1 - 2 * turn]]) for k, t in ((-1, 1), (0, 2), (1, 1))) for turn in (0, 1))
        kept = gy * gy > limit * (gx * gx + gy * gy + 1e-6)
        if np.count_nonzero(kept) >= least:
            return x[kept], y[kept]
    return x, y


def scan_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ground row of each column that has both classes: columns, rows."""
    ground = mask <= 0
    x = np.flatnonzero(ground.any(axis=0) & ~ground.all(axis=0))
    return x, ground[:, x].argmax(axis=0)


def _points(found: list, kind: pa.DataType | None = None) -> pa.Array:
    """A list of points for each (x, y) or None."""
    ends = np.cumsum([0, *(0 if p is None else len(p[0]) for p in found)])
    both = [np.concatenate([np.empty(0), *(p[k] for p in found if p is not None)]) for k in (0, 1)]
    flat = pa.StructArray.from_arrays([pa.array(v, pa.float64(), from_pandas=False) for v in both], fields=list(_POINT))
    starts = [None if k < len(found) and found[k] is None else int(e) for k, e in enumerate(ends)]
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), flat)


def masks(img: Column, height: int, width: int, window: int, opened: bool = True) -> Column:
    """Blur, Otsu's threshold, close and, by choice, open: 255 for the bright class."""
    of = lambda a: None if a is None else mask_of(a.reshape(height, width), window, opened).ravel()
    return clocked("array<int>", pa.list_(pa.int32()), of, img)["value"]


def boundaries(mask: Column, height: int, width: int, oriented: bool = False) -> Column:
    """The places of a mask's edge inside the frame, row by row, as array of struct(x, y)."""
    of = lambda a: None if a is None else edge_places(a.reshape(height, width), oriented)
    return clocked(fits.POINTS, pa.list_(_POINT), of, mask, build=_points)["value"]


def _edges(found: list, kind: pa.DataType) -> pa.Array:
    points = _points([None if f is None else f[:2] for f in found])
    return pa.StructArray.from_arrays([points, pa.array([None if f is None else f[2] for f in found], pa.float64())], ["points", "balance"])


def edges(img: Column | Planes, height: int, width: int, window: int, how: str) -> Column:
    """struct(value: struct(points, balance), ms): the points of a frame's mask, which stays in the task, and the larger
    class's share. how: scan (first ground rows of the closed mask), all, or oriented (boundary places)."""

    def of(a: np.ndarray | None) -> tuple | None:
        if a is None:
            return None
        mask = mask_of(a.reshape(height, width), window, how != "scan")
        share = np.count_nonzero(mask) / mask.size
        x, y = scan_of(mask) if how == "scan" else edge_places(mask, how == "oriented")
        return x, y, max(share, 1 - share)

    return clocked(f"struct<points:{fits.POINTS},balance:double>", pa.null(), of, img, build=_edges)


def row_energy_peak(img: Column | Planes, height: int, width: int, taps: int = 15) -> Column:
    """struct(value, ms) of raster.row_energy_peak."""

    def of(a: np.ndarray | None) -> int | None:
        if a is None:
            return None
        m = a.reshape(height, width).astype(np.float64)
        energy = np.abs(_reflected(_reflected(m, (1, 2, 1), 1), (-1, 0, 1), 0)).sum(axis=1) / width
        sums = np.concatenate(([0], np.cumsum(energy)))
        at, r = np.arange(height), taps // 2
        return int(np.round(sums[np.minimum(at + r + 1, height)] - sums[np.maximum(at - r, 0)], 6).argmax())

    return clocked("int", pa.int32(), of, img)


def search(points: Column, near: float, k: int, least: int = 2, ratio: float | None = None, iterations: int | None = None, seed: int = 0) -> Column:
    """struct(value, ms) of fits.searched."""
    of = lambda x, y: [] if x is None else fits.best_pairs(x, y, near, k, least, ratio, iterations, seed)
    return clocked(fits.FOUND, fits.FOUND_ARROW, of, F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"]))


CLUSTERS = f"array<struct<cluster:int,line:{LINE},confidence:double,n:int>>"
_CLUSTERS = pa.list_(pa.struct([("cluster", pa.int32()), ("line", _LINE), ("confidence", pa.float64()), ("n", pa.int32())]))


def clusters(points: Column, near: float, k: int, most: int | None = None, iterations: int | None = None, seed: int = 0) -> Column:
    """struct(value, ms) of fits.merged of fits.searched, the first most clusters."""
    of = lambda x, y: [] if x is None else fits.best_clusters(x, y, near, k, iterations, seed, most)
    return clocked(CLUSTERS, _CLUSTERS, of, F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"]))


def huber(points: Column) -> Column:
    """struct(value, ms) of fits.huber."""
    of = lambda x, y: fits.huber_of(x, y) if x is not None and len(x) >= 2 else None
    return clocked(LINE, _LINE, of, F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"]))


EDGE = "struct<x:array<double>,y:array<double>,balance:double>"
VIEWS = f"struct<edges:array<{EDGE}>,degenerate:boolean,path:{CANDIDATE},sky:{CANDIDATE},planes:binary,thumb:array<double>>"
_EDGE = pa.struct([("x", pa.list_(pa.float64())), ("y", pa.list_(pa.float64())), ("balance", pa.float64())])
_VIEWS = pa.struct([("edges", pa.list_(_EDGE)), ("degenerate", pa.bool_()), ("path", _CANDIDATE), ("sky", _CANDIDATE), ("planes", pa.binary()), ("thumb", pa.list_(pa.float64()))])


def views_of(planes: list[Column | Planes], height: int, width: int, window: int, edged: tuple[int, ...], compared: int, sizes: dict[str, tuple[int, int]] | None, path: bool, sky: bool, degenerate: float = scoring.DEGENERATE) -> Column:
    """struct(value, ms): all that later steps need of a frame's planes, which cross to the task once.

    edges: the oriented boundary places of the planes edged, with the larger class's share; degenerate: none has two
    classes of weight, and there are no candidates; path, sky: the line of the likeliest boundary path and that under
    the top-connected sky, in the frame's own places, each struct(line, count, score) or null; planes: the first
    compared ones as the bytes of doubles, for judged(); thumb: the first, for scenes. sizes: to what candidates, planes and thumb are reduced
    by area, with whole values as an image library keeps bytes; None keeps the frame's size. Null if a plane is.
    """

    def of(*given: np.ndarray | None) -> dict | None:
        if any(p is None for p in given):
            return None
        whole = [_bytes(p.reshape(height, width)) for p in given]
        found = []
        for k in edged:
            mask = mask_of(whole[k], window, True)
            share = np.count_nonzero(mask) / mask.size
            x, y = edge_places(mask, True)
            found.append({"x": x.astype(np.float64), "y": y.astype(np.float64), "balance": max(share, 1 - share)})
        flat = all(e["balance"] >= degenerate for e in found)
        small = lambda n, what: np.stack([p.astype(np.float64) if sizes is None else np.rint(reduced_by_area(p if p.dtype == np.uint8 else p.astype(np.float32), *sizes[what])) for p in whole[:n]]).astype(np.float64)
        seen = small(len(whole), "candidates") if (path or sky) and not flat else None
        return {
            "edges": found, "degenerate": flat, "path": regions.path_candidate(seen, (height, width)) if path and not flat else None,
            "sky": regions.sky_candidate(seen, (height, width)) if sky and not flat else None, "planes": small(compared, "planes").tobytes(), "thumb": small(1, "thumb").ravel(),
        }

    return clocked(VIEWS, _VIEWS, of, *planes)


def line_iou(line: Column, mask: Column, height: int, width: int) -> Column:
    """Intersection over union of what lies above a line and a mask, 1 for two empty ones; null where either is."""
    x, y = np.arange(width), np.arange(height)[:, None]

    def of(ln: dict | None, given: np.ndarray | None) -> float | None:
        if ln is None or given is None:
            return None
        at = ln["y0"] + ln["vy"] / ln["vx"] * (x - ln["x0"]) if abs(ln["vx"]) > VERTICAL else np.full(width, ln["y0"])
        above, lit = y < at, given.reshape(height, width) > 0
        union = np.count_nonzero(above | lit)
        return np.count_nonzero(above & lit) / union if union else 1.0

    return clocked("double", pa.float64(), of, line, mask)["value"]


def _shares(n: int, m: int) -> np.ndarray:
    """m x n: which share of each of n cells lies in each of m equal parts."""
    edge = np.arange(m + 1) * (n / m)
    lo, hi = np.maximum(edge[:-1, None], np.arange(n)), np.minimum(edge[1:, None], np.arange(1, n + 1))
    return np.maximum(hi - lo, 0) * (m / n)


_kept_shares: dict[tuple, np.ndarray] = {}


def reduced_by_area(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean of what each new place covers, for any ratio; that of bytes in single precision."""
    (h, w), kind = plane.shape, np.dtype(np.float32) if plane.dtype == np.uint8 else plane.dtype if plane.dtype.kind == "f" else np.dtype(np.float64)
    size = (h // height) * (w // width)
    if plane.dtype == np.uint8 and h % height == w % width == 0 and size & (size - 1) == 0 and size <= 256:
        # blocks of a power of two: their sums, which fit 16 bits, have exact means
        rows = plane.reshape(height, -1, w).sum(axis=1, dtype=np.uint16)
        return (rows.reshape(height, width, -1).sum(axis=2, dtype=np.uint16) / size).astype(kind)
    plane = plane.astype(kind)
    down, across = (plane.shape[0], height, kind), (plane.shape[1], width, kind)
    for key in (down, across):
        if key not in _kept_shares:
            _kept_shares[key] = _shares(*key[:2]).astype(kind)
    return _kept_shares[down] @ plane @ _kept_shares[across].T


JUDGED = f"array<struct<source:string,rank:int,line:{LINE},refit:{LINE},count:int,raw:double>>"
_JUDGED = pa.list_(pa.struct([("source", pa.string()), ("rank", pa.int32()), ("line", _LINE), ("refit", _LINE), ("count", pa.int32()), ("raw", pa.float64())]))


def judged(planes: Column, edges: dict[str, Column], found: dict[str, Column], size: tuple[int, int], full: tuple[int, int], near: float, k: int, least: int, iterations: int | None, seed: int) -> Column:
    """struct(value, ms): a frame's candidates with their coherence: of each source of edges (arrays of points) the k
    best lines through two points with their refits, and those found before, whose struct(line, count, ..) may be null.

    planes: those of views_of(); size, full: (height, width) of a plane and of the frame that the lines lie in.
    """

    drawn, others = tuple(edges), tuple(found)

    def of(stack: np.ndarray | None, *given) -> list[dict]:
        if stack is None:
            return []
        out = []
        for name, x, y in zip(drawn, given[::2], given[1::2], strict=False):
            if x is not None:
                best = fits.best_lines(x, y, near, k, iterations, seed)
                out += [{"source": name, "rank": rank, "line": line, "refit": refit, "count": n} for rank, (line, refit, n) in enumerate(best, start=1)]
        for name, c in zip(others, given[2 * len(drawn) :], strict=True):
            if c is not None:
                out.append({"source": name, "rank": 1, "line": c["line"], "refit": c["line"], "count": c["count"]})
        raws = regions.coherences(stack.view(np.float64).reshape(-1, *size), [c["line"] for c in out], full, least)
        return [c | {"raw": raw} for c, raw in zip(out, raws, strict=True)]

    points = [c for p in edges.values() for c in (F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"]))]
    return clocked(JUDGED, _JUDGED, of, planes, *points, *found.values())


def coherences(planes: Column, found: Column, width: int, least: int = scoring.LEAST_SIDE, full: tuple[int, int] | None = None, clock: bool = False) -> Column:
    """scoring.coherence of each line of an array; empty for none. full: (height, width) of the frame that the lines lie
    in, where the planes are reduced ones."""

    def of(stack: list | None, lines: list | None) -> list:
        if stack is None or lines is None:
            return []
        a = np.stack([p.reshape(-1, width) for p in stack])
        return regions.coherences(a, lines, full or a.shape[1:], least)

    out = clocked("array<double>", pa.list_(pa.float64()), of, planes, found)
    return out if clock else out["value"]
