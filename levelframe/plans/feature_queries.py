"""Queries of features, gates, verdicts and stages that the detection pipelines are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from levelframe.functions import grading, lines
from levelframe.operators import fits, likelihood, raster, scoring, temporal
from levelframe.plans.detectors import once
from levelframe.plans.fit_queries import HYP, hyps, r, synthetic
from levelframe.plans.raster_queries import H, MASK, PX, SYNTH, W_, frames, near, raster_query, weighted
from levelframe.plans.registry import query
from levelframe.session import table


def _ellipse(src: str, agg: str) -> str:
    return f"SELECT a.frame_id, a.y, a.x, {agg}(b.v) AS v FROM {src} a JOIN {src} b ON a.frame_id = b.frame_id AND ((b.y = a.y AND abs(b.x - a.x) <= 2) OR (b.x = a.x AND abs(b.y - a.y) <= 1)) GROUP BY ALL"


raster_query("ellipse_smoothed", f"WITH {MASK}, e1 AS ({_ellipse('mask', 'max')}), e2 AS ({_ellipse('e1', 'min')}), e3 AS ({_ellipse('e2', 'min')}) {_ellipse('e3', 'max')}", lambda c: raster.smoothed_by_ellipse(c, H, W_), mask=True)

_SHARE = "greatest(0, least(({k} + 1) * 8, ({c} + 1) * {m}) - greatest({k} * 8, {c} * {m}))"
raster_query(
    "area_resize_any",
    f"""WITH {PX}, ky AS (SELECT unnest(range(0, 3)) AS ky), kx AS (SELECT unnest(range(0, 5)) AS kx)
SELECT frame_id, CAST(ky AS INTEGER) AS y, CAST(kx AS INTEGER) AS x, round(sum(v * {_SHARE.format(k="ky", c="y", m=3)} * {_SHARE.format(k="kx", c="x", m=5)}) / 64.0::DOUBLE, 6) AS v FROM px, ky, kx GROUP BY ALL""",
    lambda c: F.transform(raster.area_resized(c, H, W_, 3, 5), lambda v: F.round(v, 6)),
    width=5,
)

TEXTURE = f"""gx AS ({weighted("px", (-1, 0, 1), (1, 2, 1))}), gy AS ({weighted("px", (1, 2, 1), (-1, 0, 1))}),
gr AS (SELECT gx.frame_id, gx.y, gx.x, abs(gx.v) + abs(gy.v) AS v FROM gx JOIN gy USING (frame_id, y, x)),
top AS (SELECT frame_id, greatest(quantile_cont(v, 0.95), 1.0::DOUBLE) AS t FROM gr GROUP BY frame_id),
cl AS (SELECT frame_id, y, x, least(v / t, 1.0::DOUBLE) AS v FROM gr JOIN top USING (frame_id)),
tx AS ({weighted("cl", (1,) * 5, (1,) * 5)})"""
raster_query("texture_map", f"WITH {PX}, {TEXTURE} SELECT frame_id, y, x, round(v / 25, 5) AS v FROM tx", lambda c: F.transform(likelihood.texture_map(c, H, W_), lambda v: F.round(v, 5)))

STAGES = ("input", "blurred", "split", "closed", "opened", "edge", "inner_edge")
STAGE_SQL = f"""{PX}, g AS ({weighted("px", (1, 4, 6, 4, 1), (1, 4, 6, 4, 1))}), s1 AS (SELECT frame_id, y, x, CAST(floor(v / 256 + 0.5::DOUBLE) AS INTEGER) AS v FROM g), s2 AS (SELECT frame_id, y, x, CASE WHEN v > 127 THEN 255 ELSE 0 END AS v FROM s1),
c1 AS ({near("s2", "max")}), s3 AS ({near("c1", "min")}), o1 AS ({near("s3", "min")}), s4 AS ({near("o1", "max")}), d AS ({near("s4", "max")}), e AS ({near("s4", "min")}), s5 AS (SELECT d.frame_id, d.y, d.x, d.v - e.v AS v FROM d JOIN e USING (frame_id, y, x)),
s6 AS (SELECT frame_id, y, x, CASE WHEN y IN (0, 7) OR x IN (0, 7) THEN 0 ELSE v END AS v FROM s5)"""


@query("stage_rows", f"""WITH {STAGE_SQL}, st AS ({" UNION ALL ".join(f"SELECT frame_id, {k} AS pos, '{n}' AS stage, y, x, v FROM {'px' if k == 0 else f's{k}'}" for k, n in enumerate(STAGES))})
SELECT frame_id, pos, stage, string_agg(CAST(v AS VARCHAR), ',' ORDER BY y, x) AS img FROM st GROUP BY ALL""")
def stage_rows(spark, sf_dir):
    """What a pipeline holds after each step, a row a frame and stage."""
    df = frames(spark, sf_dir).withColumn("blurred", raster.gaussian(F.col("img"), H, W_)).withColumn("split", raster.above(F.col("blurred"), F.lit(127)))
    df = df.withColumn("closed", raster.close(F.col("split"), H, W_, 3)).withColumn("opened", raster.open_(F.col("closed"), H, W_, 3))
    df = df.withColumn("edge", raster.gradient(F.col("opened"), H, W_)).withColumn("inner_edge", raster.without_border(F.col("edge"), H, W_)).withColumnRenamed("img", "input")
    stages = F.array(*(F.struct(F.lit(k).alias("pos"), F.lit(n).alias("stage"), F.array_join(F.transform(n, lambda v: v.cast("string")), ",").alias("img")) for k, n in enumerate(STAGES)))
    return df.select("frame_id", F.inline(stages))


DEG = "(event_id * 7 % 360 - 179.5::DOUBLE)"


@query("line_readings", f"""WITH e AS (SELECT event_id, value, {DEG} AS d FROM events)
SELECT event_id, round(CASE WHEN d > 90 THEN d - 180 WHEN d <= -90 THEN d + 180 ELSE d END, 6) AS folded, round(value - tan(radians(d)) * 2, 4) AS intercept, round(value + tan(radians(d)) * (3 - 2), 4) AS y_at_3 FROM e""")
def line_readings(spark, sf_dir):
    """A line's folded angle, intercept and height at a column."""
    turn = F.radians(F.pmod(F.col("event_id") * 7, F.lit(360)) - 179.5)
    ln = lines.line(F.cos(turn), F.sin(turn), 2.0, F.col("value"))
    rows = table(spark, sf_dir, "events").withColumn("ln", ln)
    ln = F.col("ln")
    return rows.select("event_id", r(lines.folded_angle(ln)).alias("folded"), r(lines.intercept(ln), 4).alias("intercept"), r(lines.y_at(ln, F.lit(3.0)), 4).alias("y_at_3"))


@query("dash_segments", """WITH e AS (SELECT event_id, value, sqrt(100 + value * value) AS s FROM events), k AS (SELECT *, unnest(range(0, CAST(ceil(s / 17) AS BIGINT))) AS k FROM e)
SELECT event_id, CAST(k AS INTEGER) AS k, round(10 * k * 17 / s, 4) AS x1, round(value * k * 17 / s, 4) AS y1, round(10 * least(k * 17 + 10, s) / s, 4) AS x2, round(value * least(k * 17 + 10, s) / s, 4) AS y2 FROM k""")
def dash_segments(spark, sf_dir):
    """The drawn parts of a dashed line from the corner to (10, value)."""
    zero = F.lit(0.0)
    rows = table(spark, sf_dir, "events").select("event_id", F.posexplode(lines.dashes(zero, zero, F.lit(10.0), F.col("value"), 10.0, 7.0)).alias("k", "d"))
    return rows.select("event_id", "k", *(r(f"d.{c}", 4).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query("top_n_results", f"""WITH {HYP} SELECT frame_id, CAST(least(max(rank), 3) AS INTEGER) AS found, CAST(max(n) FILTER (rank = 1) AS INTEGER) AS best, CAST(sum(n) FILTER (rank <= 3) AS INTEGER) AS inliers FROM rk GROUP BY frame_id""")
def top_n_results(spark, sf_dir):
    """The n best results of a frame as one array, shorter where fewer are found."""
    top = fits.top_k(hyps(spark, sf_dir), ["frame_id"], 5).select("frame_id", F.col("rank").alias("cluster"), "line", F.col("n").alias("confidence"))
    rows = fits.ranked_results(top, ["frame_id"], 3)
    return rows.select("frame_id", F.size("results").alias("found"), F.get("results", F.lit(0))["confidence"].alias("best"), F.aggregate("results", F.lit(0), lambda s, q: s + q["confidence"]).alias("inliers"))


@query("searched_pairs", f"""WITH {HYP} SELECT frame_id, CAST(rank AS INTEGER) AS rank, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(n AS INTEGER) AS n FROM rk WHERE rank <= 8""")
def searched_pairs(spark, sf_dir):
    """The best point pairs of each frame by the search inside the row."""
    # bound to a row first: a filter that Spark infers from an exploded function's size can't hold the function
    rows = once(once(synthetic(spark, sf_dir), "scan", F.col("scan")), "found", fits.searched(F.col("scan"), 0.75))
    return rows.select("frame_id", F.posexplode("found").alias("k", "h")).select("frame_id", (F.col("k") + 1).alias("rank"), "h.i", "h.j", "h.n")


@query("degenerate_frames", f"""WITH {SYNTH}, n AS (SELECT frame_id, count(*) FILTER (v > 225) / 64.0::DOUBLE AS a, count(*) FILTER (v > 30) / 64.0::DOUBLE AS b FROM px GROUP BY frame_id)
SELECT frame_id, greatest(a, 1 - a) >= 0.92::DOUBLE AND greatest(b, 1 - b) >= 0.92::DOUBLE AS degenerate FROM n""")
def degenerate_frames(spark, sf_dir):
    """Frames whose two masks both lie nearly all in one class."""
    img = F.col("img")
    return synthetic(spark, sf_dir).select("frame_id", scoring.degenerate(raster.above(img, F.lit(225)), raster.above(img, F.lit(30))).alias("degenerate"))


_SOURCE = "CASE event_id % 4 WHEN 0 THEN 'L' WHEN 1 THEN 'b' WHEN 2 THEN 'path' ELSE 'sky' END"


@query("candidate_gates", f"""WITH c AS (SELECT event_id, {_SOURCE} AS source, value / 10 AS raw, abs(event_id * 13 % 180 - 89.5::DOUBLE) AS roll FROM events)
SELECT event_id, source FROM c WHERE CASE source WHEN 'path' THEN raw >= 5 AND roll <= 25 WHEN 'sky' THEN raw >= 1 AND roll <= 65 ELSE true END""")
def candidate_gates(spark, sf_dir):
    """Candidates that may enter the pool."""
    deg = F.pmod(F.col("event_id") * 13, F.lit(180)) - 89.5
    source = F.element_at(F.array(*(F.lit(s) for s in scoring.SOURCES)), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", source.alias("source"), (F.col("value") / 10).alias("raw"), lines.angle_intercept_line(deg, F.lit(0.0)).alias("line"))
    return scoring.admitted(rows).select("event_id", "source")


@query("boosted_winner", """WITH e AS (SELECT event_id, value / 10 AS a, value / 13 AS s, (event_id % 11) * 2.0::DOUBLE AS ya, (event_id % 7) * 3.0::DOUBLE AS ys, CASE WHEN event_id % 3 > 0 THEN (event_id % 13) * 1.5::DOUBLE END AS before FROM events),
p AS (SELECT *, round(a * (1 + 2 * coalesce(exp(-pow(abs(ya - before) / 24 / 0.14::DOUBLE, 2)), 0)), 9) AS sa, round(s * 1.2::DOUBLE * (1 + 2 * coalesce(exp(-pow(abs(ys - before) / 24 / 0.14::DOUBLE, 2)), 0)), 9) AS ss FROM e),
w AS (SELECT *, CASE WHEN ss > sa THEN 'sky' WHEN s >= 1 AND s >= 0.72::DOUBLE * a AND ya - ys >= 0.08::DOUBLE * 24 THEN 'sky' ELSE 'L' END AS won FROM p)
SELECT event_id, CASE WHEN CASE WHEN won = 'sky' THEN s ELSE a END >= 0.22::DOUBLE THEN won END AS won FROM w""")
def boosted_winner(spark, sf_dir):
    """A frame's winner: sky and temporal boost, the sky override, and the floor on the plain score."""
    e, v = F.col("event_id"), F.col("value")
    flat = lambda y: lines.line(1.0, 0.0, 0.0, y)
    one = lambda source, place, raw, y: F.struct(F.lit(source).alias("source"), F.lit(place).alias("place"), raw.alias("raw"), flat(y).alias("line"), F.lit(5).alias("count"))
    found = F.array(one("L", 1001, v / 10, F.pmod(e, F.lit(11)) * 2.0), one("sky", 4001, v / 13, F.pmod(e, F.lit(7)) * 3.0))
    before = F.when(F.pmod(e, F.lit(3)) > 0, flat(F.pmod(e, F.lit(13)) * 1.5))
    rows = table(spark, sf_dir, "events").select("event_id", found.alias("c"), before.alias("before"))
    return rows.select("event_id", temporal.chosen(F.col("c"), F.col("before"), 24, 24, scoring.FLOORS[10])["source"].alias("won"))


@query("angle_verdicts", """WITH e AS (SELECT event_id, event_id * 7 % 180 - 89.5::DOUBLE AS gt, CASE WHEN event_id % 9 > 0 THEN (event_id * 7 + event_id % 12) % 180 - 89.5::DOUBLE END AS a, (event_id * 7 + event_id % 5) % 180 - 89.5::DOUBLE AS b FROM events),
d AS (SELECT event_id, least(abs(a - gt), 180 - abs(a - gt)) AS da, least(abs(b - gt), 180 - abs(b - gt)) AS db FROM e)
SELECT event_id, round(da, 6) AS angle_a, round(db, 6) AS angle_b, CASE WHEN da IS NULL THEN 'NONE' WHEN round(da, 6) < 5 THEN 'PASS' ELSE 'FAIL' END AS verdict_a, CASE WHEN round(db, 6) < 5 THEN 'PASS' ELSE 'FAIL' END AS verdict_b FROM d""")
def angle_verdicts(spark, sf_dir):
    """Two detections side by side, judged by angle alone."""
    e = F.col("event_id")
    at = lambda k: lines.angle_intercept_line(F.pmod(e * 7 + k, F.lit(180)) - 89.5, F.lit(0.0))
    gt = at(F.lit(0))
    rows = table(spark, sf_dir, "events").select("event_id", gt.alias("gt"), F.when(F.pmod(e, F.lit(9)) > 0, at(F.pmod(e, F.lit(12)))).alias("a"), at(F.pmod(e, F.lit(5))).alias("b"))
    for k in "ab":
        rows = rows.withColumn(f"angle_{k}", r(lines.wrapped_angle(lines.direction_deg(F.col(k)), lines.direction_deg(F.col("gt")))))
    return rows.select("event_id", "angle_a", "angle_b", *(grading.angle_verdict(F.col(f"angle_{k}")).alias(f"verdict_{k}") for k in "ab"))
