"""The ten detection pipelines over frames with a known horizon, and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from levelframe.functions import lines
from levelframe.operators import evaluation, regions
from levelframe.plans.detectors import REGISTRY, Shape
from levelframe.plans.registry import query
from levelframe.session import table
from levelframe.sources.frames import made_planes, made_vectors
from levelframe.sources.tables import with_horizon

#: Frames of eight rows: a small morphology window; clips of 50 frames.
SMALL = Shape(8, 8, window=3, near=0.75, clip=("clip",))


def frames(spark, sf_dir):
    """Frames cost far more than their bytes: a table of fewer files than there are cores is dealt to all of them."""
    vectors, cores = table(spark, sf_dir, "embeddings"), spark.sparkContext.defaultParallelism
    if len(vectors.inputFiles()) < cores:
        vectors = vectors.repartition(cores)
    return with_horizon(vectors).withColumn("clip", F.floor(F.col("frame_id") / 50))


def _register(name: str):
    @query(f"detect_{name}")
    def run(spark, sf_dir):
        found = REGISTRY[name][0](frames(spark, sf_dir), SMALL)
        return found.select("frame_id", "status", F.round(lines.folded_angle(F.col("line")), 3).alias("deg"), F.round(lines.y_at(F.col("line"), F.lit(3.5)), 3).alias("y_mid"), F.round("confidence", 4).alias("confidence"), "inliers")

    return run


for _name in REGISTRY:
    _register(_name)


def _summary(spark, sf_dir, df, name, shape):
    """One run of a pipeline, scored against the known lines and summarised. The lines follow from the ids alone, so that
    no frame is made twice."""
    height = F.lit(float(shape.height))
    known = with_horizon(table(spark, sf_dir, "embeddings")).select("frame_id", lines.label_line(F.col("slope"), F.col("offset"), height).alias("gt"))
    found = REGISTRY[name][0](df, shape).join(known, "frame_id")
    rows = found.select("frame_id", (F.col("status") == "failed").alias("failed"), F.lit(True).alias("gt_horizon"), (F.col("status") != "no_horizon").alias("pred_horizon"), height.alias("height"), "latency_ms", "gt", F.col("line").alias("pred"))
    return evaluation.summary(evaluation.scored(rows))


@query("evaluate_a5")
def evaluate_a5(spark, sf_dir):
    out = _summary(spark, sf_dir, frames(spark, sf_dir), "a5", SMALL)
    return out.select("total", "failed_count", "passed_count", F.round("pass_rate", 4).alias("pass_rate"), F.round("angle_mean", 3).alias("angle_mean"), "accuracy_verdict")


#: Frames of real size; clips of 50.
FULL = Shape(480, 480, clip=("clip",), thumb=regions.CANDIDATE_SIZE, source=(("frame_id", "embedding"), made_planes))


#: Tasks for each core: frames cost unlike, so that few large ones would leave cores idle at the end.
DEALT = 8


def full_frames(spark, sf_dir):
    """What frames of real size are made of; the kernels make the planes that they read."""
    vectors = made_vectors(table(spark, sf_dir, "embeddings")).repartition(DEALT * spark.sparkContext.defaultParallelism)
    return vectors.withColumn("clip", F.floor(F.col("frame_id") / 50))


def _register_full(name: str):
    @query(f"evaluate_full_{name}")
    def run(spark, sf_dir):
        """A run over frames of 480 x 480."""
        out = _summary(spark, sf_dir, full_frames(spark, sf_dir), name, FULL)
        return out.select("total", "failed_count", "passed_count", F.round("pass_rate", 4).alias("pass_rate"), F.round("angle_mean", 2).alias("angle_mean"), F.round("rho_norm_mean", 3).alias("rho_norm_mean"), "accuracy_verdict")

    return run


for _name in ("a1", "a2", "a4", "a7", "a10"):
    _register_full(_name)
