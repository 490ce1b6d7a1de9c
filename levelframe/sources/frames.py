"""Images as frames: decoded pixels to planes and thumbnails, and a folder of labelled images as one table.

Spark's image source decodes files in the tasks; what follows works on Arrow batches of frames with numpy, a frame at
a time, as expressions over arrays of a full-size frame would box every value.

Nulls and edge cases: unreadable files are dropped by the source; a grayscale image has three equal channels; an
image without a label is a frame without one, a label without an image gives no frame; a missing mask is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelframe.operators.batches import reduced_by_area as area_resized
from levelframe.sources import tables

PLANES = ("gray", "light", "a", "b", "saturation", "blue_excess")
#: The matrix from linear sRGB to XYZ and the white point D65 of the Lab planes.
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)


#: Linear light of each byte.
LINEAR = np.where(np.arange(256) <= 0.04045 * 255, np.arange(256) / 255 / 12.92, ((np.arange(256) / 255 + 0.055) / 1.055) ** 2.4)


def planes_of(bgr: np.ndarray, kept: tuple[str, ...] = PLANES) -> dict[str, np.ndarray]:
    """The planes kept of a height x width x 3 frame of bytes."""
    blue, green, red = (np.ascontiguousarray(bgr[:, :, k]) for k in range(3))
    b, g, r = (p.astype(np.float64) for p in (blue, green, red))
    byte = lambda v: np.clip(np.rint(v), 0, 255)
    out = {}
    if "gray" in kept:
        out["gray"] = np.floor(0.114 * b + 0.587 * g + 0.299 * r + 0.5)
    if {"light", "a", "b"} & set(kept):
        linear = LINEAR[red], LINEAR[green], LINEAR[blue]
        part = lambda k: sum(p * (c / WHITE[k]) for p, c in zip(linear, XYZ[k], strict=True))
        root = lambda t: np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
        y = part(1)
        fy = root(y)
        if "light" in kept:
            out["light"] = byte(np.where(y > 0.008856, 116 * fy - 16, 903.3 * y) * 255 / 100)
        if "a" in kept:
            out["a"] = byte(500 * (root(part(0)) - fy) + 128)
        if "b" in kept:
            out["b"] = byte(200 * (fy - root(part(2))) + 128)
    if "saturation" in kept:
        high, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
        out["saturation"] = np.where(high == 0, 0, np.floor((high - low) * 255 / np.maximum(high, 1) + 0.5))
    if "blue_excess" in kept:
        out["blue_excess"] = np.clip(np.rint(128 + 128 * (b - r) / (b + r + 1)), 0, 255)
    return out


def decoded(images: DataFrame, planes: tuple[str, ...] = PLANES, size: tuple[int, int] | None = None) -> DataFrame:
    """images (filename, height, width, nChannels, data) as filename, height, width and an array of ints for each
    plane, row by row; size: (height, width) to resize to by area."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a frame at a time bounds the memory
                name, h, w, n, data = (batch.column(k)[i] for k in ("filename", "height", "width", "nChannels", "data"))
                h, w, n = h.as_py(), w.as_py(), n.as_py()
                raw = np.frombuffer(data.as_buffer(), np.uint8).reshape(h, w, n)
                found = planes_of(np.repeat(raw, 3, axis=2) if n == 1 else raw[:, :, :3], planes)
                if size is not None:
                    h, w = size
                    found = {k: np.floor(area_resized(p, h, w) + 0.5) for k, p in found.items()}
                out = [pa.array([found[k].astype(np.int32).ravel()], pa.list_(pa.int32())) for k in planes]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([h], pa.int32()), pa.array([w], pa.int32()), *out], ["filename", "height", "width", *planes])

    schema = "filename string, height int, width int, " + ", ".join(f"`{k}` array<int>" for k in planes)
    return images.select("filename", "height", "width", "nChannels", "data").mapInArrow(of, schema)


def mask_planes(masks: DataFrame, size: tuple[int, int] | None = None) -> DataFrame:
    """filename's stem and mask, an array with 255 for sky (over 127) and 0 else, of single-channel or colour masks."""
    rows = decoded(masks, ("gray",), size).withColumn("stem", F.regexp_replace("filename", r"\.[^.]*$", ""))
    return rows.select("stem", F.transform("gray", lambda v: F.when(v > 127, 255).otherwise(0)).alias("gt_mask"))


def labelled_frames(spark: SparkSession, folder: str, planes: tuple[str, ...] = ("light", "b"), size: tuple[int, int] | None = None, limit: int | None = None) -> DataFrame:
    """The labelled images of a dataset folder (label.csv, images/, masks/sky/) with their planes, label and mask.

    Columns: filename, height, width, the planes, has_horizon, slope, offset, gt_mask (null without a mask file).
    limit: the first labels by filename; only their files are read, as their names, at most limit, choose the files.
    """
    root = folder.rstrip("/")
    labels = tables.labels(spark, f"{root}/label.csv")
    names = None
    if limit is not None:
        labels = labels.orderBy("filename").limit(limit)
        names = [r.filename for r in labels.select("filename").collect()]  # limit names
    pictures = tables.images(spark, f"{root}/images", names)
    rows = decoded(pictures.join(labels.select("filename"), "filename", "left_semi"), planes, size)
    rows = rows.join(labels, "filename")
    try:
        sky = mask_planes(tables.images(spark, f"{root}/masks/sky", None if names is None else [f"{n.rpartition('.')[0] or n}." for n in names]), size)
    except Exception as e:  # a dataset without masks
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return rows.withColumn("gt_mask", F.lit(None).cast("array<int>"))
    return rows.withColumn("stem", F.regexp_replace("filename", r"\.[^.]*$", "")).join(sky, "stem", "left").drop("stem")


@lru_cache(maxsize=4)
def _mixed(height: int, width: int) -> np.ndarray:
    """The pair of places of an 8 x 8 vector that each place of a made frame mixes: coarse and fine, as one number."""
    y, x = np.arange(height)[:, None], np.arange(width)
    return (y // -(-height // 8) * 8 + x // -(-width // 8)) * 64 + y % 8 * 8 + x % 8


def made_line(k: int) -> tuple[float, float]:
    """slope and offset of the line of a made frame."""
    return (k * 37 % 101 - 50) / 100, 0.3 + k * 17 % 41 / 100


def made_planes(height: int, width: int, names: tuple[str, ...]) -> Callable:
    """A function of an id and a vector of 64 values that makes the named planes of a frame, bytes row by row: blue above
    a line that follows from the id and green below it, the vector as its noise, coarse in the sky and strong on the
    ground. img is light, raw is b. None for null.

    A place's colour follows from its side of the line and two values of the vector: each of these 2 x 64 x 64 colours
    is taken apart once, and places only look theirs up.
    """
    kept = tuple({"img": "light", "raw": "b"}.get(c, c) for c in names)

    def of(k: int | None, vector: np.ndarray | None) -> list[np.ndarray | None]:
        if k is None or vector is None:
            return [None] * len(kept)
        slope, offset = made_line(k)
        values = np.nan_to_num(vector.astype(np.float64))
        mixed = lambda share: (40 * values[:, None] + share * values)[:, :, None]
        sky, ground = np.array([225.0, 180.0, 140.0]), np.array([50.0, 95.0, 80.0])
        colours = planes_of(np.clip(np.concatenate((ground + mixed(260), sky + mixed(60))), 0, 255).astype(np.uint8), kept)
        y, x = np.arange(height)[:, None], np.arange(width)
        place = (_mixed(height, width) + 4096 * (y < slope * x + offset * height)).ravel()
        return [colours[c].astype(np.uint8).ravel()[place] for c in kept]

    return of


def made_vectors(embeddings: DataFrame) -> DataFrame:
    """frame_id and embedding of what a frame can be made of."""
    return embeddings.filter("vec_id IS NOT NULL AND size(embedding) = 64").select(F.col("vec_id").alias("frame_id"), "embedding")


def made_frames(embeddings: DataFrame, height: int = 480, width: int = 480) -> DataFrame:
    """frame_id, slope, offset, the planes of the likelihood stack as arrays, img and raw: a frame of made_planes() for
    each vector. Pipelines that need no rows of planes make them in their kernels (detectors.Shape.source)."""
    kept = PLANES[1:]
    make = made_planes(height, width, kept)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, vector in zip(batch.column("frame_id").to_pylist(), batch.column("embedding"), strict=True):
                arrays = [pa.array([p.astype(np.int32)], pa.list_(pa.int32())) for p in make(k, vector.values.to_numpy(zero_copy_only=False))]
                yield pa.RecordBatch.from_arrays([*(pa.array([v]) for v in (k, *made_line(k))), *arrays], ["frame_id", "slope", "offset", *kept])

    made = made_vectors(embeddings).mapInArrow(of, "frame_id long, slope double, offset double, " + ", ".join(f"{c} array<int>" for c in kept))
    return made.withColumns({"img": F.col("light"), "raw": F.col("b")})


def missing_images(labels: DataFrame, names: DataFrame) -> DataFrame:
    """Labels whose image file is not there."""
    return labels.join(names.select("filename"), "filename", "left_anti")
