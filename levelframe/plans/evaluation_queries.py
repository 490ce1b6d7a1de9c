"""Queries of the evaluation layer: line items stand for frames with a labelled and a predicted line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from levelframe.functions import grading, lines
from levelframe.operators import evaluation, ordering, temporal
from levelframe.plans.registry import query
from levelframe.session import table

HEIGHT = 480.0
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def frames(spark, sf_dir: str) -> DataFrame:
    """Line items as frames: a labelled line from quantity and discount, a predicted one that deviates by tax."""
    li = table(spark, sf_dir, "lineitem")
    slope, offset = (F.col("l_quantity") - 25.0) / 20.0, 0.2 + F.col("l_discount") * 4.0
    out = li.select(
        *KEYS, "l_quantity", "l_shipdate", slope.alias("slope"), offset.alias("offset"), (slope + (F.col("l_tax") - 0.04) * 3.0).alias("p_slope"), (offset + (F.col("l_tax") - 0.03)).alias("p_offset"),
        (F.col("l_returnflag") != "R").alias("gt_horizon"), (F.col("l_linenumber") == 7).alias("failed"), ((F.col("l_linenumber") == 7) | (F.col("l_linestatus") == "O") | (F.col("l_returnflag") != "R")).alias("pred_horizon"),
        F.lit(HEIGHT).alias("height"), (F.col("l_extendedprice") / 1000.0).alias("latency_ms"), "l_returnflag", "l_linestatus",
    )
    return out.withColumn("gt", F.when(F.col("gt_horizon"), lines.label_line(F.col("slope"), F.col("offset"), F.col("height")))).withColumn("pred", F.when(F.col("pred_horizon") & ~F.col("failed"), lines.label_line(F.col("p_slope"), F.col("p_offset"), F.col("height"))))


FRAMES_SQL = """
f AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate, l_returnflag, l_linestatus,
    (l_quantity - 25.0::DOUBLE) / 20.0::DOUBLE AS slope, 0.2::DOUBLE + l_discount * 4.0::DOUBLE AS off,
    (l_quantity - 25.0::DOUBLE) / 20.0::DOUBLE + (l_tax - 0.04::DOUBLE) * 3.0::DOUBLE AS p_slope, 0.2::DOUBLE + l_discount * 4.0::DOUBLE + (l_tax - 0.03::DOUBLE) AS p_off,
    l_returnflag <> 'R' AS gt_horizon, l_linenumber = 7 AS failed, (l_linenumber = 7 OR l_linestatus = 'O' OR l_returnflag <> 'R') AS pred_horizon,
    480.0::DOUBLE AS height, l_extendedprice / 1000.0::DOUBLE AS latency_ms
  FROM lineitem
),
h AS (
  SELECT *, 1 / sqrt(1 + slope * slope) AS ny, -slope / sqrt(1 + slope * slope) AS nx, off * height / sqrt(1 + slope * slope) AS rho,
    p_off * height / sqrt(1 + p_slope * p_slope) AS p_rho, degrees(atan2(slope, 1.0::DOUBLE)) AS deg, degrees(atan2(p_slope, 1.0::DOUBLE)) AS p_deg FROM f
),
e AS (
  SELECT *, CASE WHEN gt_horizon AND pred_horizon AND NOT failed THEN least(abs(p_deg - deg), 180 - abs(p_deg - deg)) END AS angle,
    CASE WHEN gt_horizon AND pred_horizon AND NOT failed THEN abs(p_rho - rho) END AS rho_px FROM h
),
s AS (
  SELECT *, rho_px / height AS rho_norm,
    NOT failed AND gt_horizon = pred_horizon AND (NOT gt_horizon OR coalesce(angle < 5 AND rho_px / height < 0.05, false)) AS passed FROM e
)
"""


def scored(spark, sf_dir: str) -> DataFrame:
    return evaluation.scored(frames(spark, sf_dir))


def r(c, n: int = 6):
    return F.round(c, n)


@query("label_to_hesse", f"""WITH {FRAMES_SQL}
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(nx, 6) AS nx, round(ny, 6) AS ny, round(rho, 4) AS rho, round(deg, 6) AS folded, round(off * height, 4) AS intercept,
  round(abs(deg), 6) AS roll, round(off * height + slope * 320, 4) AS y_mid FROM h""")
def label_to_hesse(spark, sf_dir):
    ln = lines.label_line(F.col("slope"), F.col("offset"), F.col("height"))
    rows = frames(spark, sf_dir).withColumn("ln", ln).withColumn("h", lines.hesse(F.col("ln")))
    return rows.select(*KEYS, r("h.nx").alias("nx"), r("h.ny").alias("ny"), r("h.rho", 4).alias("rho"), r(lines.folded_angle(F.col("ln"))).alias("folded"), r(lines.intercept(F.col("ln")), 4).alias("intercept"), r(lines.roll(F.col("ln"))).alias("roll"), r(lines.y_at(F.col("ln"), F.lit(320.0)), 4).alias("y_mid"))


@query("hesse_outward", f"""WITH {FRAMES_SQL}
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(atan2(CASE WHEN p_rho < 0 THEN -1 ELSE 1 END * 1.0::DOUBLE, CASE WHEN p_rho < 0 THEN 1 ELSE -1 END * p_slope), 6) AS theta, round(abs(p_rho), 4) AS rho FROM h""")
def hesse_outward(spark, sf_dir):
    h = lines.hesse_outward(lines.label_line(F.col("p_slope"), F.col("p_offset"), F.col("height")))
    return frames(spark, sf_dir).withColumn("h", h).select(*KEYS, r("h.theta").alias("theta"), r("h.rho", 4).alias("rho"))


@query("angular_error", f"""WITH {FRAMES_SQL}
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(angle, 6) AS angle, round(abs((p_deg - deg + 90) - 180 * floor((p_deg - deg + 90) / 180) - 90), 6) AS wrapped FROM s""")
def angular_error(spark, sf_dir):
    deg = lambda c: F.degrees(F.atan2(F.col(c), F.lit(1.0)))
    return scored(spark, sf_dir).select(*KEYS, r("angle").alias("angle"), r(lines.wrapped_angle(deg("p_slope"), deg("slope"))).alias("wrapped"))


@query("positional_error", f"WITH {FRAMES_SQL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(rho_px, 4) AS rho_px, round(rho_norm, 7) AS rho_norm FROM s")
def positional_error(spark, sf_dir):
    return scored(spark, sf_dir).select(*KEYS, r("rho_px", 4).alias("rho_px"), r("rho_norm", 7).alias("rho_norm"))


@query("pass_predicate", f"WITH {FRAMES_SQL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, passed FROM s")
def pass_predicate(spark, sf_dir):
    return scored(spark, sf_dir).select(*KEYS, "passed")


@query("line_geometry", f"""WITH {FRAMES_SQL},
p AS (SELECT *, l_quantity AS x1, 10 + l_quantity * slope AS y1, l_quantity + 7 * l_linenumber AS x2, 20 + l_quantity * p_slope AS y2 FROM f),
q AS (SELECT *, (y2 - y1) / (x2 - x1) AS m, (x2 - x1) / nullif(y2 - y1, 0) AS k, abs(x2 - x1) >= abs(y2 - y1) AS flat, 1600 / (50.0::DOUBLE * l_quantity) AS fw, 900 / (40.0::DOUBLE * l_quantity) AS fh FROM p)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(m, 6) AS slope, round((y1 - m * x1) / height, 6) AS off,
  round(CASE WHEN flat THEN 0.0::DOUBLE ELSE x1 - k * y1 END, 3) AS ax, round(CASE WHEN flat THEN y1 - m * x1 ELSE 0 END, 3) AS ay,
  round(CASE WHEN flat THEN 639.0::DOUBLE ELSE x1 + k * (479 - y1) END, 3) AS bx, round(CASE WHEN flat THEN y1 + m * (639 - x1) ELSE 479 END, 3) AS by, round(least(fw, fh), 6) AS scale FROM q""")
def line_geometry(spark, sf_dir):
    c = F.col
    rows = frames(spark, sf_dir).withColumns({"x1": c("l_quantity").cast("double"), "y1": 10 + c("l_quantity") * c("slope"), "x2": c("l_quantity") + 7 * c("l_linenumber"), "y2": 20 + c("l_quantity") * c("p_slope")})
    rows = rows.withColumn("p", lines.points_label(c("x1"), c("y1"), c("x2"), c("y2"), c("height"))).withColumn("c", lines.clipped(c("x1"), c("y1"), c("x2"), c("y2"), F.lit(640.0), c("height")))
    return rows.select(*KEYS, r("p.slope").alias("slope"), r("p.offset").alias("off"), r("c.ax", 3).alias("ax"), r("c.ay", 3).alias("ay"), r("c.bx", 3).alias("bx"), r("c.by", 3).alias("by"), r(lines.fit_scale(50.0 * c("l_quantity"), 40.0 * c("l_quantity"))).alias("scale"))


@query("line_endpoints", f"""WITH {FRAMES_SQL}, d AS (SELECT *, cos(atan2(slope, 1.0::DOUBLE)) AS vx, sin(atan2(slope, 1.0::DOUBLE)) AS vy FROM f)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round_even(-1280 * vx, 0) AS INTEGER) AS x1, CAST(round_even(off * height - 1280 * vy, 0) AS INTEGER) AS y1, CAST(round_even(1280 * vx, 0) AS INTEGER) AS x2, CAST(round_even(off * height + 1280 * vy, 0) AS INTEGER) AS y2 FROM d""")
def line_endpoints(spark, sf_dir):
    ln = lines.angle_intercept_line(F.degrees(F.atan2(F.col("slope"), F.lit(1.0))), F.col("offset") * F.col("height"))
    rows = frames(spark, sf_dir).withColumn("e", lines.endpoints(ln, F.lit(640.0), F.col("height")))
    return rows.select(*KEYS, "e.*")


@query("normalise_result", """WITH k AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, CASE l_linenumber WHEN 1 THEN 'line' WHEN 2 THEN 'angle_intercept' WHEN 3 THEN 'line_list' WHEN 4 THEN 'no_horizon' WHEN 5 THEN 'no_horizon_flag' WHEN 6 THEN 'empty_list' ELSE 'none' END AS kind FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN kind IN ('none', 'empty_list') THEN 'failed' WHEN kind IN ('no_horizon', 'no_horizon_flag') THEN 'no_horizon' ELSE 'line' END AS status,
  CASE WHEN kind = 'angle_intercept' THEN round(cos(radians(l_quantity)), 6) WHEN kind IN ('line', 'line_list') THEN 1.0 END AS vx FROM k""")
def normalise_result(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    kinds = ["line", "angle_intercept", "line_list", "no_horizon", "no_horizon_flag", "empty_list"]
    kind = F.coalesce(F.get(F.array(*(F.lit(k) for k in kinds)), F.col("l_linenumber") - 1), F.lit("none"))
    # what a detector may return, in one tagged struct: a line, an angle with an intercept, a list of lines
    rows = li.withColumn("kind", kind).withColumn("one", lines.line(1.0, 0.0, 0.0, F.col("l_quantity"))).withColumn("many", F.array("one"))
    ln = F.when(F.col("kind") == "line", F.col("one")).when(F.col("kind") == "angle_intercept", lines.angle_intercept_line(F.col("l_quantity").cast("double"), F.lit(0.0))).when(F.col("kind") == "line_list", F.element_at("many", 1))
    return rows.select(*KEYS, grading.normalised_status(F.col("kind")).alias("status"), r(ln["vx"]).alias("vx"))


@query("stratum_counts", f"""WITH {FRAMES_SQL}
SELECT CASE WHEN abs(degrees(atan(slope))) < 15 THEN 'flat' WHEN abs(degrees(atan(slope))) < 45 THEN 'moderate' ELSE 'steep' END AS angle_bin,
  CASE WHEN off < 0.33 THEN 'low' WHEN off <= 0.67 THEN 'mid' ELSE 'high' END AS offset_bin, count(*) AS n, count(*) FILTER (passed) AS n_passed FROM s GROUP BY ALL""")
def stratum_counts(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(grading.angle_bin(F.col("slope")).alias("angle_bin"), grading.offset_bin(F.col("offset")).alias("offset_bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"))


def _stat_sql(c: str, name: str, n: int = 6) -> str:
    return f"round(avg({c}), {n}) AS {name}_mean, round(quantile_cont({c}, 0.5), {n}) AS {name}_median, round(quantile_cont({c}, 0.9), {n}) AS {name}_p90, round(max({c}), {n}) AS {name}_worst"


SUMMARY_COUNTS = ["total", "failed_count", "line_scored", "passed_count", "tp", "fn", "fp", "tn", "failed_gt_horizon", "failed_gt_no_horizon"]


@query("evaluation_summary", f"""WITH {FRAMES_SQL}, a AS (
SELECT l_linestatus AS run, count(*) AS total, count(*) FILTER (failed) AS failed_count, count(angle) AS line_scored, count(*) FILTER (passed) AS passed_count,
  count(*) FILTER (NOT failed AND gt_horizon AND pred_horizon) AS tp, count(*) FILTER (NOT failed AND gt_horizon AND NOT pred_horizon) AS fn, count(*) FILTER (NOT failed AND NOT gt_horizon AND pred_horizon) AS fp,
  count(*) FILTER (NOT failed AND NOT gt_horizon AND NOT pred_horizon) AS tn, count(*) FILTER (failed AND gt_horizon) AS failed_gt_horizon, count(*) FILTER (failed AND NOT gt_horizon) AS failed_gt_no_horizon,
  round(count(*) FILTER (passed) / count(*)::DOUBLE, 6) AS pass_rate, {_stat_sql("angle", "angle")}, {_stat_sql("rho_norm", "rho_norm")},
  avg(latency_ms) FILTER (NOT failed) AS lm, quantile_cont(latency_ms, 0.9) FILTER (NOT failed) AS lp, avg(CASE WHEN latency_ms > 1000.0::DOUBLE / 15 THEN 100.0::DOUBLE ELSE 0 END) FILTER (NOT failed) AS over
FROM s GROUP BY l_linestatus)
SELECT * EXCLUDE (lm, lp, over, tp, fn, fp, tn, failed_gt_horizon, failed_gt_no_horizon),
  CASE WHEN fp + tn + failed_gt_no_horizon > 0 THEN tp END AS tp, CASE WHEN fp + tn + failed_gt_no_horizon > 0 THEN fn END AS fn, CASE WHEN fp + tn + failed_gt_no_horizon > 0 THEN fp END AS fp, CASE WHEN fp + tn + failed_gt_no_horizon > 0 THEN tn END AS tn,
  CASE WHEN fp + tn + failed_gt_no_horizon > 0 THEN failed_gt_horizon END AS failed_gt_horizon, CASE WHEN fp + tn + failed_gt_no_horizon > 0 THEN failed_gt_no_horizon END AS failed_gt_no_horizon,
  round(lm, 6) AS latency_mean, round(1000 / lp, 6) AS fps_p90, round(over, 6) AS pct_over_budget,
  CASE WHEN pass_rate >= 0.95 THEN 'PASS' WHEN pass_rate >= 0.8 THEN 'WARN' ELSE 'FAIL' END AS accuracy_verdict,
  CASE WHEN lm IS NULL THEN 'WARN' WHEN lm <= 1000.0::DOUBLE / 15 AND lp <= 1000.0::DOUBLE / 15 THEN 'PASS' WHEN lm <= 1000.0::DOUBLE / 15 THEN 'WARN' ELSE 'FAIL' END AS speed_verdict FROM a""")
def evaluation_summary(spark, sf_dir):
    out = evaluation.summary(scored(spark, sf_dir), ["l_linestatus"])
    stats = [r(f"{c}_{s}").alias(f"{c}_{s}") for c in ("angle", "rho_norm") for s in ("mean", "median", "p90", "worst")]
    return out.select(F.col("l_linestatus").alias("run"), *SUMMARY_COUNTS, r("pass_rate").alias("pass_rate"), *stats, r("latency_ok_mean").alias("latency_mean"), r("fps_p90").alias("fps_p90"), r("pct_over_budget").alias("pct_over_budget"), "accuracy_verdict", "speed_verdict")


@query("worst_frames", f"WITH {FRAMES_SQL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(angle, 6) AS angle FROM s WHERE angle IS NOT NULL ORDER BY round(angle, 6) DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 5")
def worst_frames(spark, sf_dir):
    return evaluation.worst(scored(spark, sf_dir).withColumn("angle", r("angle")), "angle", 5, KEYS).select(*KEYS, "angle")


SWEEP_SQL = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in grading.SWEEP)


@query("precision_sweep", f"""WITH {FRAMES_SQL}, t(deg, norm) AS (VALUES {SWEEP_SQL})
SELECT l_returnflag, t.deg, t.norm, round(avg(CASE WHEN angle <= t.deg AND rho_norm <= t.norm THEN 1.0::DOUBLE ELSE 0 END), 6) AS precision FROM s, t WHERE angle IS NOT NULL GROUP BY ALL""")
def precision_sweep(spark, sf_dir):
    return evaluation.precision_sweep(scored(spark, sf_dir), ["l_returnflag"]).withColumn("precision", r("precision"))


@query("mean_precision", f"""WITH {FRAMES_SQL}, t(deg, norm) AS (VALUES {SWEEP_SQL}), p AS (
SELECT l_linestatus, t.deg, avg(CASE WHEN angle <= t.deg AND rho_norm <= t.norm THEN 1.0::DOUBLE ELSE 0 END) AS p FROM s, t WHERE angle IS NOT NULL GROUP BY ALL)
SELECT l_linestatus, round(avg(p), 6) AS mean_precision FROM p GROUP BY l_linestatus""")
def mean_precision(spark, sf_dir):
    return evaluation.mean_precision(scored(spark, sf_dir), ["l_linestatus"]).withColumn("mean_precision", r("mean_precision"))


@query("split_aggregate", f"""WITH {FRAMES_SQL}
SELECT CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, {_stat_sql("angle", "angle")}, {_stat_sql("rho_norm", "rho_norm")},
  round(count(*) FILTER (passed) / count(*) FILTER (NOT failed)::DOUBLE, 6) AS pass_of_scored FROM s GROUP BY ALL""")
def split_aggregate(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("split", F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train"))
    out = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *evaluation.stats("angle"), *evaluation.stats("rho_norm"), (F.count_if("passed") / F.count_if(~F.col("failed"))).alias("pass_of_scored"))
    return out.select("split", "n", *(r(c).alias(c) for c in out.columns[2:]))


@query("split_side_by_side", f"""WITH {FRAMES_SQL}, w AS (SELECT CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, angle, rho_norm FROM s),
m AS (SELECT split, 'angle' AS metric, avg(angle) AS mean, max(angle) AS worst FROM w GROUP BY split UNION ALL SELECT split, 'rho_norm', avg(rho_norm), max(rho_norm) FROM w GROUP BY split)
SELECT a.metric, round(a.mean, 6) AS train_mean, round(b.mean, 6) AS test_mean, round(a.worst, 6) AS train_worst, round(b.worst, 6) AS test_worst, round(b.mean - a.mean, 6) AS mean_gap
FROM m a JOIN m b ON a.metric = b.metric AND a.split = 'train' AND b.split = 'test'""")
def split_side_by_side(spark, sf_dir):
    """Each metric of the train rows beside that of the test rows."""
    rows = scored(spark, sf_dir).withColumn("split", F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train"))
    out = evaluation.side_by_side(rows, "split", "train", "test", ["angle", "rho_norm"])
    return out.select("metric", *(r(c).alias(c) for c in ("train_mean", "test_mean", "train_worst", "test_worst")), r(F.col("test_mean") - F.col("train_mean")).alias("mean_gap"))


@query("warm_up_throughput", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean_ms, round(count(*) * 1000 / sum(value), 6) AS fps FROM n WHERE k > 10 GROUP BY user_id""")
def warm_up_throughput(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumnRenamed("value", "latency_ms")
    out = evaluation.throughput(evaluation.after_warm_up(ev, ["user_id"], ["ts", "event_id"]), ["user_id"])
    return out.select("user_id", "n", r("mean_ms").alias("mean_ms"), r("fps").alias("fps"))


@query("metric_stats", f"""SELECT event_type, count(*) AS n, {_stat_sql("value", "value")}, round(1000 / avg(value), 6) AS fps_mean, round(1000 / quantile_cont(value, 0.9), 6) AS fps_p90, round(avg(CASE WHEN value > 1000.0::DOUBLE / 15 THEN 100.0::DOUBLE ELSE 0 END), 6) AS pct_over FROM events GROUP BY event_type""")
def metric_stats(spark, sf_dir):
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), *evaluation.stats("value"), F.avg(F.when(F.col("value") > grading.BUDGET_MS, 100.0).otherwise(0.0)).alias("pct_over"))
    return out.select("event_type", "n", *(r(f"value_{s}").alias(f"value_{s}") for s in ("mean", "median", "p90", "worst")), r(1000 / F.col("value_mean")).alias("fps_mean"), r(1000 / F.col("value_p90")).alias("fps_p90"), r("pct_over").alias("pct_over"))


@query("sketched_stats", """SELECT event_type, count(*) AS n, true AS median_in_rank, true AS p90_in_rank, round(avg(value), 6) AS value_mean, round(max(value), 6) AS value_worst FROM events GROUP BY event_type""")
def sketched_stats(spark, sf_dir):
    """Quantiles of a run from mergeable sketches, with whether their exact ranks among the values that are there lie
    within the stated error; without values no rank is off."""
    ev, accuracy = table(spark, sf_dir, "events"), 1000
    found = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("values"), *evaluation.stats("value", accuracy=accuracy))
    at = lambda q, p: (F.count_if(F.col("value") < F.col(q)) <= (p + 1 / accuracy) * F.first("values")) & (F.count_if(F.col("value") <= F.col(q)) >= (p - 1 / accuracy) * F.first("values"))
    found = F.broadcast(found.withColumnRenamed("event_type", "__type"))  # a row an event type
    checked = ev.select("event_type", "value").join(found, F.col("event_type").eqNullSafe(F.col("__type")))
    out = checked.groupBy("event_type").agg(F.first("n").alias("n"), at("value_median", 0.5).alias("median_in_rank"), at("value_p90", 0.9).alias("p90_in_rank"), F.first("value_mean").alias("value_mean"), F.first("value_worst").alias("value_worst"))
    return out.select("event_type", "n", "median_in_rank", "p90_in_rank", r("value_mean").alias("value_mean"), r("value_worst").alias("value_worst"))


@query("stratified_split", """WITH s AS (SELECT o_orderkey, o_orderpriority AS stratum, o_orderkey * 7919 % 104729 AS k FROM orders),
n AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY k, o_orderkey) AS place FROM s)
SELECT o_orderkey, stratum, CASE WHEN n >= 2 AND place <= greatest(1, ceil(0.2::DOUBLE * n - 1e-9::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM n""")
def stratified_split(spark, sf_dir):
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    key = F.struct((F.col("o_orderkey") * 7919 % 104729).alias("k"), "o_orderkey")
    return evaluation.stratified_split(od, F.col("o_orderpriority"), key).select("o_orderkey", "stratum", "split")


@query("confusion_matrix", """SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic = 0) AS tn, 0::BIGINT AS failed_gt_horizon, 0::BIGINT AS failed_gt_no_horizon FROM labels""")
def confusion_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("gt_horizon"), (F.col("toxic") == 1).alias("pred_horizon"), F.lit(False).alias("failed"))
    return rows.agg(*evaluation.confusion())


@query("unlabelled_queue", """WITH u AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)),
n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM u) SELECT doc_id, place FROM n WHERE place >= 5""")
def unlabelled_queue(spark, sf_dir):
    rest = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    # a queue is one order; it is numbered by ranges, each on its own, from the ranges' sizes
    ranged = rest.withColumn("__b", F.floor(F.col("doc_id") / 10_000))
    before = ranged.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = ranged.withColumn("__k", F.row_number().over(W.partitionBy("__b").orderBy("doc_id")) - 1).join(before, "__b")
    return placed.select("doc_id", (F.col("__before") + F.col("__k")).alias("place")).filter("place >= 5")


@query("label_join", """SELECT d.doc_id, d.lang, l.quality, l.toxic, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)""")
def label_join(spark, sf_dir):
    lb = table(spark, sf_dir, "labels").withColumn("labelled", F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(lb, "doc_id", "left").withColumn("labelled", F.coalesce("labelled", F.lit(False)))


@query("self_divergence", f"""WITH {FRAMES_SQL},
a AS (SELECT l_orderkey AS k, avg(slope) AS sl FROM f GROUP BY 1), b AS (SELECT l_orderkey AS k, avg(p_slope) AS sl FROM f WHERE l_linenumber <> 3 GROUP BY 1), g AS (SELECT l_orderkey AS k, max(slope) AS sl FROM f WHERE l_returnflag <> 'R' GROUP BY 1),
d AS (SELECT k, degrees(atan(a.sl)) AS da, degrees(atan(b.sl)) AS db, degrees(atan(g.sl)) AS dg FROM a JOIN b USING (k) LEFT JOIN g USING (k)),
dv AS (SELECT k, least(abs(da - db), 180 - abs(da - db)) AS d_angle, least(abs(da - dg), 180 - abs(da - dg)) AS error_a, least(abs(db - dg), 180 - abs(db - dg)) AS error_b FROM d)
SELECT k, round(round(d_angle, 9), 6) AS d_angle, round(error_a, 6) AS error_a, round(error_b, 6) AS error_b, round(error_b, 9) < round(error_a, 9) AS b_closer FROM dv WHERE round(d_angle, 9) >= 2""")
def self_divergence(spark, sf_dir):
    out = _divergence(spark, sf_dir)
    return out.select("k", r("d_angle").alias("d_angle"), r("error_a").alias("error_a"), r("error_b").alias("error_b"), "b_closer")


def _divergence(spark, sf_dir):
    f = frames(spark, sf_dir)
    run = lambda df, c, agg: df.groupBy(F.col("l_orderkey").alias("k")).agg(agg(c).alias("m")).select("k", lines.line(1.0, F.col("m"), 0.0, 0.0).alias("line"))
    out = evaluation.divergence(run(f, "slope", F.avg), run(f.filter("l_linenumber <> 3"), "p_slope", F.avg), "k", run(f.filter("l_returnflag <> 'R'"), "slope", F.max), least_deg=2.0 - 5e-10)
    return out.withColumn("b_closer", F.round("error_b", 9) < F.round("error_a", 9)).withColumn("d_angle", F.round("d_angle", 9))


@query("divergence_buckets", f"""WITH {FRAMES_SQL},
a AS (SELECT l_orderkey AS k, avg(slope) AS sl FROM f GROUP BY 1), b AS (SELECT l_orderkey AS k, avg(p_slope) AS sl FROM f WHERE l_linenumber <> 3 GROUP BY 1), g AS (SELECT l_orderkey AS k, max(slope) AS sl FROM f WHERE l_returnflag <> 'R' GROUP BY 1),
d AS (SELECT k, degrees(atan(a.sl)) AS da, degrees(atan(b.sl)) AS db, degrees(atan(g.sl)) AS dg FROM a JOIN b USING (k) LEFT JOIN g USING (k)),
dv AS (SELECT k, round(least(abs(da - db), 180 - abs(da - db)), 9) AS d_angle, round(least(abs(da - dg), 180 - abs(da - dg)), 9) AS error_a, round(least(abs(db - dg), 180 - abs(db - dg)), 9) AS error_b FROM d),
n AS (SELECT *, row_number() OVER (ORDER BY d_angle DESC, k) AS r FROM dv WHERE d_angle >= 2),
m AS (SELECT k, d_angle, r, CASE WHEN r <= 15 THEN 'A' WHEN coalesce(error_b < error_a, false) THEN 'B' ELSE 'C' END AS bucket FROM n),
p AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY r) AS place FROM m)
SELECT bucket, place, k, round(d_angle, 6) AS d_angle FROM p WHERE place <= 15""")
def divergence_buckets(spark, sf_dir):
    return evaluation.bucketed(_divergence(spark, sf_dir), 15, ["k"]).select("bucket", F.col("place").cast("long").alias("place"), "k", r("d_angle").alias("d_angle"))


@query("natural_sort", r"""WITH p AS (SELECT page_id, url, regexp_extract_all(lower(url), '(\d+|\D+)', 1) AS parts FROM pages),
k AS (SELECT page_id, url, list_transform(parts, lambda x: CASE WHEN regexp_matches(x, '^\d') THEN lpad(regexp_replace(x, '^0+(.)', '\1'), 20, '0') ELSE x END) AS key FROM p)
SELECT page_id, CAST(row_number() OVER (ORDER BY key, page_id) AS BIGINT) AS place FROM k""")
def natural_sort(spark, sf_dir):
    """Every name's place in natural order; ranges of the order are placed on their own."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.lit(0).alias("all"), grading.natural_key(F.col("url")).alias("key"))
    return ordering.placed(rows, ["all"], ["key", "page_id"]).select("page_id", "place")


@query("safe_names", r"""SELECT page_id, CASE WHEN length(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g')) > 0 THEN regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') ELSE 'dataset' END AS safe,
  list_extract(string_split(regexp_replace(url, '/+$', ''), '/'), -1) AS source FROM pages""")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", grading.safe_name(F.col("url")).alias("safe"), grading.source_name(F.col("url")).alias("source"))


@query("result_json", """WITH v AS (SELECT user_id, event_type, event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') AS missing FROM events)
SELECT user_id, event_type, max(event_id) AS newest, arg_max(k, event_id) AS k, coalesce(arg_max(missing, event_id), 'none') AS missing FROM v GROUP BY ALL""")
def result_json(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))
    newest = ev.groupBy("user_id", "event_type").agg(F.max("event_id").alias("newest"), F.max_by(F.struct("k", "missing"), "event_id").alias("r"))
    return newest.select("user_id", "event_type", "newest", "r.k", F.coalesce("r.missing", F.lit("none")).alias("missing"))


@query("attempt_pivot", """SELECT user_id, round(max(value) FILTER (event_type = 'click'), 6) AS click, round(max(value) FILTER (event_type = 'view'), 6) AS view FROM events GROUP BY user_id""")
def attempt_pivot(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.round(F.max("value"), 6))


@query("label_event_log", """WITH e AS (SELECT user_id, event_id, ts, event_type, value, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events),
k AS (SELECT * FROM e WHERE event_type = 'click' AND coalesce(next_type <> 'error', true))
SELECT user_id, count(*) AS saves, arg_max(event_id, ts) AS last_event, round(arg_max(value, ts), 6) AS slope FROM k GROUP BY user_id""")
def label_event_log(spark, sf_dir):
    """A log of key presses as label state: a click saves unless the next key undoes it; the last save stays."""
    ev = table(spark, sf_dir, "events")
    after = F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    saves = ev.withColumn("next_type", after).filter((F.col("event_type") == "click") & F.coalesce(F.col("next_type") != "error", F.lit(True)))
    return saves.groupBy("user_id").agg(F.count(F.lit(1)).alias("saves"), F.max_by("event_id", "ts").alias("last_event"), F.round(F.max_by("value", "ts"), 6).alias("slope"))


@query("scene_segments", """WITH d AS (SELECT user_id, event_id, ts, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 22, false) AS continuous FROM events)
SELECT event_id, continuous, CAST(sum(CASE WHEN continuous THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS INTEGER) AS scene FROM d""")
def scene_segments(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("thumb", F.array("value"))
    return temporal.scenes(ev, ["ts", "event_id"], clip=["user_id"]).select("event_id", "continuous", "scene")


@query("temporal_fold", """WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, k, value AS estimate, true AS reset FROM o WHERE k = 1
UNION ALL SELECT o.user_id, o.event_id, o.k, CASE WHEN abs(o.value - f.estimate) > 100 THEN o.value ELSE f.estimate + 0.3::DOUBLE * (o.value - f.estimate) END, abs(o.value - f.estimate) > 100 FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, event_id, round(estimate + 1e-9::DOUBLE, 6) AS estimate, reset FROM f""")
def temporal_fold(spark, sf_dir):
    out = temporal.smoothed(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 100.0, 0.3)
    return out.select("user_id", "event_id", r(F.col("estimate") + 1e-9).alias("estimate"), "reset")
