"""Lines in the image plane as column expressions.

A line is struct(vx, vy, x0, y0). Labels give slope (dy/dx) and offset (intercept over image height). NaN stands for
the intercept of a vertical line, null for a missing value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERTICAL = 1e-6


def line(vx, vy, x0, y0) -> Column:
    as_double = lambda c: (c if isinstance(c, Column) else F.lit(float(c))).cast("double")
    return F.struct(as_double(vx).alias("vx"), as_double(vy).alias("vy"), as_double(x0).alias("x0"), as_double(y0).alias("y0"))


def label_line(slope: Column, offset: Column, height: Column) -> Column:
    return F.when(slope.isNotNull() & offset.isNotNull(), line(1.0, slope, 0.0, offset * height))


def angle_intercept_line(angle_deg: Column, intercept: Column) -> Column:
    return line(F.cos(F.radians(angle_deg)), F.sin(F.radians(angle_deg)), 0.0, intercept)


def points_label(x1: Column, y1: Column, x2: Column, y2: Column, height: Column) -> Column:
    """struct(slope, offset) through two points; null for a vertical line."""
    slope = (y2 - y1) / F.nullif(x2 - x1, F.lit(0.0))
    return F.when(x1 != x2, F.struct(slope.alias("slope"), ((y1 - slope * x1) / height).alias("offset")))


def hesse(ln: Column) -> Column:
    """struct(nx, ny, rho) with ny >= 0, and nx >= 0 where ny is 0."""
    size = F.hypot(ln["vx"], ln["vy"])
    nx, ny = -ln["vy"] / size, ln["vx"] / size
    sign = F.when((ny < 0) | ((ny == 0) & (nx < 0)), -1.0).otherwise(1.0)
    return F.struct((sign * nx).alias("nx"), (sign * ny).alias("ny"), (sign * (nx * ln["x0"] + ny * ln["y0"])).alias("rho"))


def hesse_outward(ln: Column) -> Column:
    """struct(theta, rho) with rho >= 0: another convention, for ranking how far two lines are apart."""
    size = F.hypot(ln["vx"], ln["vy"])
    nx, ny = -ln["vy"] / size, ln["vx"] / size
    rho = nx * ln["x0"] + ny * ln["y0"]
    sign = F.when(rho < 0, -1.0).otherwise(1.0)
    return F.struct(F.atan2(sign * ny, sign * nx).alias("theta"), (sign * rho).alias("rho"))


def direction_deg(ln: Column) -> Column:
    return F.degrees(F.atan2(ln["vy"], ln["vx"]))


def angular_distance(a: Column, b: Column) -> Column:
    """Degrees between two undirected lines, 0 to 90."""
    d = F.pmod(F.abs(direction_deg(a) - direction_deg(b)), F.lit(180.0))
    return F.least(d, 180.0 - d)


def wrapped_angle(a_deg: Column, b_deg: Column) -> Column:
    return F.abs(F.pmod(a_deg - b_deg + 90.0, F.lit(180.0)) - 90.0)


def positional_distance(a: Column, b: Column) -> Column:
    return F.abs(hesse(a)["rho"] - hesse(b)["rho"])


def folded_angle(ln: Column) -> Column:
    """The direction in (-90, 90]."""
    d = direction_deg(ln)
    return F.when(d > 90, d - 180).when(d <= -90, d + 180).otherwise(d)


def intercept(ln: Column) -> Column:
    return F.when(F.abs(ln["vx"]) > VERTICAL, ln["y0"] - ln["vy"] / F.nullif(ln["vx"], F.lit(0.0)) * ln["x0"]).otherwise(F.lit(float("nan")))


def roll(ln: Column) -> Column:
    d = F.abs(direction_deg(ln))
    return F.when(d > 90, 180 - d).otherwise(d)


def y_at(ln: Column, x: Column) -> Column:
    return F.when(F.abs(ln["vx"]) > VERTICAL, ln["y0"] + ln["vy"] / F.nullif(ln["vx"], F.lit(0.0)) * (x - ln["x0"])).otherwise(ln["y0"])


def endpoints(ln: Column, width: Column, height: Column) -> Column:
    """struct(x1, y1, x2, y2) far beyond the image, rounded half to even."""
    far = 2 * F.greatest(width, height)
    at = lambda c, v, s: F.bround(ln[c] + s * far * ln[v]).cast("int")
    return F.struct(at("x0", "vx", -1).alias("x1"), at("y0", "vy", -1).alias("y1"), at("x0", "vx", 1).alias("x2"), at("y0", "vy", 1).alias("y2"))


def clipped(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """struct(ax, ay, bx, by): where the line through two points meets the image's borders; null for one point."""
    dx, dy = x2 - x1, y2 - y1
    point = lambda ax, ay, bx, by: F.struct(*(c.cast("double").alias(n) for c, n in zip((ax, ay, bx, by), ("ax", "ay", "bx", "by"), strict=True)))
    m, k = dy / F.nullif(dx, F.lit(0.0)), dx / F.nullif(dy, F.lit(0.0))
    flat = point(F.lit(0.0), y1 - m * x1, width - 1, y1 + m * (width - 1 - x1))
    steep = point(x1 - k * y1, F.lit(0.0), x1 + k * (height - 1 - y1), height - 1)
    return F.when((dx == 0) & (dy == 0), None).when(F.abs(dx) >= F.abs(dy), flat).otherwise(steep)


def dashes(ax: Column, ay: Column, bx: Column, by: Column, dash: float, gap: float) -> Column:
    """The drawn parts of a dashed segment as array of struct(x1, y1, x2, y2)."""
    size = F.hypot(bx - ax, by - ay)
    n = F.ceil(size / (dash + gap)).cast("int")
    at = lambda t, a, b: a + (b - a) * F.least(t, size) / size
    part = lambda k: F.struct(at(k * (dash + gap), ax, bx).alias("x1"), at(k * (dash + gap), ay, by).alias("y1"), at(k * (dash + gap) + dash, ax, bx).alias("x2"), at(k * (dash + gap) + dash, ay, by).alias("y2"))
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), n - 1), part)).otherwise(F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))


def angle_prior(roll_deg: Column) -> Column:
    """1 up to 60 degrees of roll, falling to 0.05 at 85 and beyond."""
    return F.when(roll_deg <= 60, 1.0).when(roll_deg >= 85, 0.05).otherwise(1.0 - (roll_deg - 60.0) / 25.0 * 0.95)


def temporal_prior(angle_deg: Column, rho_norm: Column) -> Column:
    """How near a line is to the one before; 0 without one."""
    return F.coalesce(F.exp(-(F.pow(angle_deg / 8.0, F.lit(2.0)) + F.pow(rho_norm / 0.14, F.lit(2.0)))), F.lit(0.0))


def rescaled(ln: Column, across: float, down: float) -> Column:
    """The line in an image so many times as wide and high, with a direction of length 1."""
    vx, vy = ln["vx"] * across, ln["vy"] * down
    return F.when(ln.isNotNull(), line(vx / F.hypot(vx, vy), vy / F.hypot(vx, vy), ln["x0"] * across, ln["y0"] * down))


def fit_scale(width: Column, height: Column) -> Column:
    """The factor that fits an image into a window of 1600 by 900."""
    return F.least(1600.0 / width, 900.0 / height)
