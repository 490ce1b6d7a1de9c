"""A detector run over a folder of labelled images: detections joined to labels and masks, scored, and one document.

A detector is the name of a registered pipeline or a Python function of one frame, which add() registers too.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelframe.functions import lines
from levelframe.operators import batches, evaluation
from levelframe.plans import detectors
from levelframe.sources import frames as sources

FOUND = f"frame_id string, status string, line {detectors.LINE}, confidence double, inliers int, latency_ms double"
#: name -> (pipeline over (frames, shape), whether it uses a seed)
_ADDED: dict[str, tuple[Callable, bool]] = {}


def add(name: str, detector: Callable, seeded: bool = False) -> None:
    """Registers a pipeline of (frames, shape) under a name of the user's own."""
    if name in detectors.REGISTRY:
        raise ValueError(f"{name} is taken")
    _ADDED[name] = (detector, seeded)


def known() -> dict[str, tuple[Callable, bool]]:
    return detectors.REGISTRY | _ADDED


def per_frame(detect: Callable) -> Callable:
    """A pipeline from a function of (img, raw) arrays, run on Arrow batches and timed a frame at a time.

    detect returns None (failed), "no_horizon", or (vx, vy, x0, y0[, confidence[, inliers]]).
    """

    def pipeline(rows: DataFrame, s: detectors.Shape) -> DataFrame:
        def of(batches):
            for batch in batches:
                out = []
                for i in range(batch.num_rows):
                    img, raw = (batch.column(k)[i].values.to_numpy().reshape(s.height, s.width) for k in ("img", "raw"))
                    began = time.perf_counter()
                    r = detect(img, raw)
                    took = (time.perf_counter() - began) * 1000
                    line = None if r is None or isinstance(r, str) else dict(zip(("vx", "vy", "x0", "y0"), map(float, r), strict=False))
                    status = "failed" if r is None else "no_horizon" if line is None else "line"
                    more = [None, None] if line is None else [*r[4:6], 1.0, 0][: len(r[4:6])] + [1.0, 0][len(r[4:6]) :]
                    out.append({"frame_id": batch.column("frame_id")[i].as_py(), "status": status, "line": line, "confidence": more[0], "inliers": more[1], "latency_ms": took})
                if out:
                    kind = pa.struct([(k, pa.float64()) for k in ("vx", "vy", "x0", "y0")])
                    yield pa.RecordBatch.from_pylist(out, pa.schema([("frame_id", pa.string()), ("status", pa.string()), ("line", kind), ("confidence", pa.float64()), ("inliers", pa.int32()), ("latency_ms", pa.float64())]))

        return rows.select(F.col("frame_id").cast("string").alias("frame_id"), "img", "raw").mapInArrow(of, FOUND)

    return pipeline


def evaluated(rows: DataFrame, detector: str | Callable, s: detectors.Shape) -> DataFrame:
    """labelled frames (filename, img, raw, has_horizon, slope, offset, gt_mask, and the likelihood stack's planes by
    choice) with the detection and its scores.

    Every labelled frame gets a row; one that the detector returns nothing for has failed.
    """
    pipeline = known()[detector][0] if isinstance(detector, str) else per_frame(detector)
    stack = [c for c in detectors.STACK if c in rows.columns]
    found = pipeline(rows.select(F.col("filename").alias("frame_id"), "img", "raw", *stack), s)
    if "latency_ms" not in found.columns:
        found = found.withColumn("latency_ms", F.lit(None).cast("double"))
    found = found.withColumnRenamed("frame_id", "filename")
    height = F.lit(float(s.height))
    both = rows.drop("img", "raw", *stack).join(found, "filename", "left").withColumn("status", F.coalesce("status", F.lit("failed")))
    both = both.withColumns({
        "failed": F.col("status") == "failed", "gt_horizon": F.col("has_horizon"), "pred_horizon": F.col("status") == "line", "pred": F.col("line"), "height": height,
        "gt": F.when(F.col("has_horizon"), lines.label_line(F.col("slope"), F.col("offset"), height)),
    })
    return evaluation.scored(both.withColumn("iou", batches.line_iou(F.col("pred"), F.col("gt_mask"), s.height, s.width)).drop("gt_mask"))


def document(rows: DataFrame, attempt: str, dataset: str, limit: int | None = None, seed: int | None = None) -> DataFrame:
    """One row: what was run, when, the summary, and the five worst frames by angle."""
    summary = evaluation.summary(rows)
    masks = rows.agg(*(c.alias(k) for c, k in zip(evaluation.stats("iou", high_is_worst=False), ("iou_mean", "iou_median", "iou_p90", "iou_worst"), strict=True)))
    worst = evaluation.worst(rows, "angle", ties=["filename"]).agg(F.sort_array(F.collect_list(F.struct(F.col("angle").alias("delta_theta_deg"), "filename", F.col("rho_norm").alias("delta_rho_norm"), "iou")), asc=False).alias("worst_frames_by_angle"))
    one = F.lit(1).alias("__one")
    out = summary.select(one, "*").join(masks.select(one, "*"), "__one").join(worst.select(one, "*"), "__one").drop("__one")  # a row each
    return out.select(
        F.lit(attempt).alias("attempt"), F.lit(dataset).alias("dataset_dir"), F.lit(limit).cast("int").alias("limit"), F.lit(seed).cast("long").alias("seed"),
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at_utc"), F.struct("*").alias("summary"),
    )


def evaluate(spark: SparkSession, folder: str, detector: str | Callable, shape: detectors.Shape, limit: int | None = None, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(a row for each labelled image, the result document) of a detector on a dataset folder.

    Images are resized by area to the shape; img is the light plane, raw the b plane of Lab, and all planes of the
    likelihood stack are there. seed takes the place of the shape's; without clips the files are one order by name.
    """
    shape = shape if seed is None else replace(shape, seed=seed)
    rows = sources.labelled_frames(spark, folder, detectors.STACK, (shape.height, shape.width), limit)
    scores = evaluated(rows.withColumns({"img": F.col("light"), "raw": F.col("b")}), detector, shape)
    name = detector if isinstance(detector, str) else detector.__name__
    return scores, document(scores, name, folder, limit, seed)


def sky_by_rows(img: np.ndarray, raw: np.ndarray):
    """A plain detector for comparison: least squares through each column's strongest fall of light."""
    fall = img[:-1].astype(float) - img[1:]
    if fall.max() <= 0:
        return "no_horizon"
    y, x = fall.argmax(axis=0) + 0.5, np.arange(img.shape[1])
    slope, at = np.polyfit(x, y, 1)
    n = float(np.hypot(1, slope))
    return 1 / n, slope / n, 0.0, at
