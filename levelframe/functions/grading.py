"""Pass rules, bins, verdicts and file names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ANGLE, MAX_RHO = 5.0, 0.05
BUDGET_MS = 1000.0 / 15
#: The threshold pairs (degrees, share of the height) of the precision sweep.
SWEEP = ((1.0, 0.01), (2.0, 0.02), (3.0, 0.03), (5.0, 0.05), (7.0, 0.07), (10.0, 0.10), (15.0, 0.15), (20.0, 0.20))


def passes(gt_horizon: Column, pred_horizon: Column, failed: Column, angle: Column, rho_norm: Column) -> Column:
    """The classes agree, and a horizon is nearer than both limits; a failed frame does not pass."""
    near = F.coalesce((angle < MAX_ANGLE) & (rho_norm < MAX_RHO), F.lit(False))
    return ~failed & (gt_horizon == pred_horizon) & (~gt_horizon | near)


def angle_verdict(angle: Column) -> Column:
    """PASS or FAIL by the angle alone, NONE without a line or a label."""
    return F.when(angle.isNull(), "NONE").when(angle < MAX_ANGLE, "PASS").otherwise("FAIL")


def angle_bin(slope: Column) -> Column:
    d = F.abs(F.degrees(F.atan(slope)))
    return F.when(d < 15, "flat").when(d < 45, "moderate").otherwise("steep")


def offset_bin(offset: Column) -> Column:
    return F.when(offset < 0.33, "low").when(offset <= 0.67, "mid").otherwise("high")


def accuracy_verdict(rate: Column) -> Column:
    return F.when(rate >= 0.95, "PASS").when(rate >= 0.80, "WARN").otherwise("FAIL")


def speed_verdict(mean_ms: Column, p90_ms: Column) -> Column:
    """WARN without any measured frame."""
    return F.when(mean_ms.isNull(), "WARN").when((mean_ms <= BUDGET_MS) & (p90_ms <= BUDGET_MS), "PASS").when(mean_ms <= BUDGET_MS, "WARN").otherwise("FAIL")


def normalised_status(kind: Column) -> Column:
    """failed, no_horizon or line for what a detector returned; other kinds are errors."""
    return (
        F.when(kind.isNull() | (kind == "none") | (kind == "empty_list"), "failed")
        .when(kind.isin("no_horizon", "no_horizon_flag"), "no_horizon")
        .when(kind.isin("line", "angle_intercept", "line_list"), "line")
        .otherwise(F.raise_error(F.concat(F.lit("unknown kind of result: "), kind)).cast("string"))
    )


def safe_name(name: Column) -> Column:
    out = F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_")
    return F.when(F.length(out) > 0, out).otherwise("dataset")


def source_name(path: Column) -> Column:
    """The last folder of a path, or the one above if that is images or frames."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    last = F.element_at(parts, -1)
    return F.when(last.isin("images", "frames") & (F.size(parts) > 1), F.get(parts, F.size(parts) - 2)).otherwise(last)


def natural_key(name: Column) -> Column:
    """Orders digit runs by value, of any length, and all else as lower-case text."""
    by_value = lambda digits: F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)
    return F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1), lambda p: F.when(p.rlike(r"^\d"), by_value(F.regexp_replace(p, "^0+(?=.)", ""))).otherwise(p))
