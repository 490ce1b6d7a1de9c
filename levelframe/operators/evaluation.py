"""Scoring of detections against labels, and the summaries of a run."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from levelframe.functions import grading, lines
from levelframe.operators import ordering

#: Test rows that are broadcast: a few MB.
BROADCAST_ROWS = 100_000


def scored(frames: DataFrame) -> DataFrame:
    """frames (failed, gt_horizon, pred_horizon, gt, pred as lines, height, ..) with angle, rho_px, rho_norm and passed;
    the errors are null where one of the two has no line."""
    both = F.col("gt_horizon") & F.col("pred_horizon") & ~F.col("failed") & F.col("gt").isNotNull() & F.col("pred").isNotNull()
    out = frames.withColumn("angle", F.when(both, lines.angular_distance(F.col("pred"), F.col("gt"))))
    out = out.withColumn("rho_px", F.when(both, lines.positional_distance(F.col("pred"), F.col("gt")))).withColumn("rho_norm", F.col("rho_px") / F.col("height"))
    return out.withColumn("passed", grading.passes(F.col("gt_horizon"), F.col("pred_horizon"), F.col("failed"), F.col("angle"), F.col("rho_norm")))


def stats(column: str, high_is_worst: bool = True, accuracy: int | None = None) -> list[Column]:
    """mean, median, p90 and worst of a column without its nulls; null for none.

    Exact quantiles hold every distinct value of a key in one task. With an accuracy they are values of the column from
    mergeable sketches, whose rank is off by a share of 1 / accuracy at most, in memory that follows the accuracy.
    A sketch may be off by half a row more than it is asked for, so it is asked for twice the accuracy.
    """
    c = F.col(column)
    at = lambda p: F.percentile(c, p) if accuracy is None else F.percentile_approx(c, p, 2 * accuracy)
    return [F.avg(c).alias(f"{column}_mean"), at(0.5).alias(f"{column}_median"), at(0.9).alias(f"{column}_p90"), (F.max(c) if high_is_worst else F.min(c)).alias(f"{column}_worst")]


def confusion() -> list[Column]:
    ok, gt, pred = ~F.col("failed"), F.col("gt_horizon"), F.col("pred_horizon")
    n = lambda c: F.count_if(c).alias
    return [n(ok & gt & pred)("tp"), n(ok & gt & ~pred)("fn"), n(ok & ~gt & pred)("fp"), n(ok & ~gt & ~pred)("tn"), n(~ok & gt)("failed_gt_horizon"), n(~ok & ~gt)("failed_gt_no_horizon")]


def summary(frames: DataFrame, keys: list[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """One row for each key: counts, confusion, accuracy, errors, speed; frames as from scored(), with latency_ms.

    All frames are in the pass rate, failed ones not in the confusion nor the latencies; the confusion is null without
    frames that have no horizon. accuracy: quantiles from sketches, as stats() has them.
    """
    rows = frames.withColumn("latency_ok", F.when(~F.col("failed"), F.col("latency_ms")))
    parts = confusion()
    out = rows.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("failed").alias("failed_count"), F.count("angle").alias("line_scored"), F.count_if("passed").alias("passed_count"), F.bool_or(~F.col("gt_horizon")).alias("has_no_horizon"),
        *parts, *(c for m in ("angle", "rho_norm", "rho_px", "latency_ok") for c in stats(m, accuracy=accuracy)), F.avg(F.when(F.col("latency_ok").isNotNull(), F.when(F.col("latency_ok") > grading.BUDGET_MS, 100.0).otherwise(0.0))).alias("pct_over_budget"),
    )
    names = ["tp", "fn", "fp", "tn", "failed_gt_horizon", "failed_gt_no_horizon"]
    out = out.withColumns({c: F.when(F.col("has_no_horizon"), F.col(c)) for c in names})
    out = out.withColumn("pass_rate", F.col("passed_count") / F.nullif(F.col("total"), F.lit(0)))
    out = out.withColumn("accuracy_verdict", grading.accuracy_verdict(F.coalesce("pass_rate", F.lit(0.0)))).withColumn("speed_verdict", grading.speed_verdict(F.col("latency_ok_mean"), F.col("latency_ok_p90")))
    return out.withColumns({f"fps_{s}": 1000.0 / F.col(f"latency_ok_{s}") for s in ("mean", "median", "p90", "worst")})


def side_by_side(frames: DataFrame, split: str, first: str, second: str, metrics: list[str]) -> DataFrame:
    """metric, and mean, median, p90 and worst of two splits beside each other, named by the split."""
    wide = frames.groupBy(split).agg(*(c for m in metrics for c in stats(m)))
    kinds = ("mean", "median", "p90", "worst")
    rows = wide.select(split, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), *(F.col(f"{m}_{k}").cast("double").alias(k) for k in kinds)) for m in metrics))))
    of = lambda name: rows.filter(F.col(split) == name).select("metric", *(F.col(k).alias(f"{name}_{k}") for k in kinds))
    return of(first).join(of(second), "metric", "full")


def worst(frames: DataFrame, metric: str, n: int = 5, ties: list[str] | None = None) -> DataFrame:
    """The n rows with the greatest metric, fewer where fewer have one.

    Nulls are left out after the limit: before it, the filter would compute the metric twice a row.
    """
    return frames.orderBy(F.desc_nulls_last(metric), *(ties or [])).limit(n).filter(F.col(metric).isNotNull())


def precision_sweep(frames: DataFrame, keys: list[str]) -> DataFrame:
    """keys, threshold pair, precision: the share of scored frames within both limits, inclusive.

    One average for each of the eight pairs in one aggregate; only its rows are spread over the pairs. Averages skip
    what has no errors, so that keys without any are left out afterwards.
    """
    hit = lambda a, r: ((F.col("angle") <= a) & (F.col("rho_norm") <= r)).cast("double")
    wide = frames.groupBy(*keys).agg(F.count("angle").alias("__scored"), *(F.avg(hit(a, r)).alias(f"__p{k}") for k, (a, r) in enumerate(grading.SWEEP)))
    pairs = F.array(*(F.struct(F.lit(a).alias("deg"), F.lit(r).alias("norm"), F.col(f"__p{k}").alias("precision")) for k, (a, r) in enumerate(grading.SWEEP)))
    return wide.filter("__scored > 0").select(*keys, F.explode(pairs).alias("t")).select(*keys, "t.*")


def mean_precision(frames: DataFrame, keys: list[str]) -> DataFrame:
    return precision_sweep(frames, keys).groupBy(*keys).agg(F.avg("precision").alias("mean_precision"))


def after_warm_up(frames: DataFrame, keys: list[str], order: list, skip: int = 10) -> DataFrame:
    return frames.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") > skip).drop("__n")


def throughput(frames: DataFrame, keys: list[str]) -> DataFrame:
    return frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("mean_ms"), (F.count(F.lit(1)) * 1000 / F.sum("latency_ms")).alias("fps"))


def stratified_split(frames: DataFrame, stratum: Column, key: Column, share: float = 0.2) -> DataFrame:
    """frames with stratum and split: of each stratum with two rows or more, ceil(share) of the rows, one at least, the
    first by key, are test. A stratum of any size is placed in ranges, not in one task."""
    rows = ordering.placed(frames.withColumn("stratum", stratum).withColumn("__k", key), ["stratum"], ["__k"], "__place")
    tests = F.when(F.col("__n") >= 2, F.greatest(F.lit(1), F.ceil(share * F.col("__n") - 1e-9))).otherwise(0)
    return rows.withColumn("split", F.when(F.col("__place") <= tests, "test").otherwise("train")).drop("__k", "__place", "__n")


def permutation_split(labels: DataFrame, seed: int, share: float = 0.2) -> DataFrame:
    """The split by one seeded generator over the strata in name order, for label tables: the generator's state runs
    through all strata, so the permutation is drawn on the driver from the strata's sizes alone. Rows are in the order
    of filename."""
    import numpy as np

    sizes = labels.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).orderBy("stratum").collect()  # a row a stratum
    rng, rows = np.random.default_rng(seed), []
    for r in sizes:
        tests = max(1, math.ceil(share * r["n"])) if r["n"] >= 2 else 0
        rows += [(r["stratum"], int(k)) for k in rng.permutation(r["n"])[:tests]]
    tests = labels.sparkSession.createDataFrame(rows, "stratum string, __place long").withColumn("__test", F.lit(True))
    tests = F.broadcast(tests) if len(rows) <= BROADCAST_ROWS else tests
    rows = ordering.placed(labels, ["stratum"], ["filename"], "__place").withColumn("__place", F.col("__place") - 1)
    return rows.join(tests, ["stratum", "__place"], "left").withColumn("split", F.when(F.col("__test"), "test").otherwise("train")).select(*labels.columns, "split")


def divergence(a: DataFrame, b: DataFrame, key: str, gt: DataFrame | None = None, least_deg: float = 2.0) -> DataFrame:
    """Frames on which two runs' lines differ by least_deg or more, with each one's error and which is nearer."""
    rows = a.select(key, F.col("line").alias("line_a")).join(b.select(key, F.col("line").alias("line_b")), key).filter("line_a IS NOT NULL AND line_b IS NOT NULL")
    rows = rows.withColumn("d_angle", lines.angular_distance(F.col("line_a"), F.col("line_b"))).filter(F.col("d_angle") >= least_deg)
    if gt is None:
        return rows
    rows = rows.join(gt.select(key, F.col("line").alias("line_gt")), key, "left")
    error = lambda c: F.when(F.col("line_gt").isNotNull(), lines.angular_distance(F.col(c), F.col("line_gt")))
    return rows.withColumn("error_a", error("line_a")).withColumn("error_b", error("line_b")).withColumn("b_closer", F.col("error_b") < F.col("error_a"))


def bucketed(rows: DataFrame, top: int, order: list) -> DataFrame:
    """A: within the top of all by divergence; B: the second run is nearer but not in A; C: the rest. The top of each.

    order ends a tie. The top of all and the top two times that many of each side are found by ordered limits, which
    gather no more than they return; the places are given to these few rows alone.
    """
    by = [F.desc("d_angle"), *order]
    nearer = F.coalesce("b_closer", F.lit(False))
    # A takes at most top rows from each side, so that the next top ones are among these
    few = rows.filter(nearer).orderBy(*by).limit(2 * top).unionByName(rows.filter(~nearer).orderBy(*by).limit(2 * top))
    ranked = few.withColumn("__r", F.row_number().over(W.orderBy(*by)))
    named = ranked.withColumn("bucket", F.when(F.col("__r") <= top, "A").when(nearer, "B").otherwise("C"))
    return named.withColumn("place", F.row_number().over(W.partitionBy("bucket").orderBy("__r"))).filter(F.col("place") <= top).drop("__r")
