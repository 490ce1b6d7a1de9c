"""Properties of the line functions."""

import math

import pytest
from pyspark.sql import functions as F

from levelframe.functions import grading, lines

CASES = [(1.0, 0.3, 0.0, 5.0), (-1.0, -0.3, 2.0, 5.6), (0.0, 1.0, 4.0, 0.0), (1.0, 0.0, 3.0, -2.0), (-0.2, 0.9, 1.0, 1.0)]


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(*a, *b) for a in CASES for b in CASES]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in ("avx", "avy", "ax", "ay", "bvx", "bvy", "bx", "by")))
    return df.withColumn("a", lines.line(F.col("avx"), F.col("avy"), F.col("ax"), F.col("ay"))).withColumn("b", lines.line(F.col("bvx"), F.col("bvy"), F.col("bx"), F.col("by")))


def test_angle_is_symmetric_and_bounded(pairs):
    for r in pairs.select(lines.angular_distance(F.col("a"), F.col("b")).alias("p"), lines.angular_distance(F.col("b"), F.col("a")).alias("q")).collect():
        assert math.isclose(r.p, r.q, abs_tol=1e-9) and 0 <= r.p <= 90


def test_hesse_ignores_direction_and_anchor(pairs):
    a = F.col("a")
    flipped = lines.line(-a["vx"], -a["vy"], a["x0"] + 3 * a["vx"], a["y0"] + 3 * a["vy"])
    for r in pairs.select(lines.hesse(a).alias("p"), lines.hesse(flipped).alias("q")).collect():
        assert all(math.isclose(r.p[k], r.q[k], abs_tol=1e-9) for k in ("nx", "ny", "rho"))


def test_folded_angle_range(pairs):
    assert all(-90 < r.d <= 90 for r in pairs.select(lines.folded_angle(F.col("a")).alias("d")).collect())


def test_vertical_line_has_nan_intercept(pairs):
    r = pairs.filter("avx = 0").select(lines.intercept(F.col("a")).alias("i"), lines.y_at(F.col("a"), F.lit(9.0)).alias("y")).first()
    assert math.isnan(r.i) and r.y == 0.0


def test_limits_are_strict_for_passing(spark):
    df = spark.createDataFrame([(5.0, 0.01), (4.99, 0.05), (4.99, 0.049)], "angle double, rho double")
    t, f = F.lit(True), F.lit(False)
    assert [r.p for r in df.select(grading.passes(t, t, f, F.col("angle"), F.col("rho")).alias("p")).collect()] == [False, False, True]


def test_speed_verdict_without_frames(spark):
    assert spark.range(1).select(grading.speed_verdict(F.lit(None).cast("double"), F.lit(None).cast("double")).alias("v")).first().v == "WARN"


def test_unknown_result_is_an_error(spark):
    with pytest.raises(Exception, match="unknown kind"):
        spark.range(1).select(grading.normalised_status(F.lit("other"))).collect()


def test_natural_order(spark):
    df = spark.createDataFrame([("f10.jpg",), ("f2.jpg",), ("F1.jpg",)], "n string")
    assert [r.n for r in df.orderBy(grading.natural_key(F.col("n"))).collect()] == ["F1.jpg", "f2.jpg", "f10.jpg"]
