"""Queries of the raster layer: vectors of 64 values stand for 8 x 8 frames of bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from levelframe.operators import raster
from levelframe.plans.registry import query
from levelframe.session import table
from levelframe.sources.tables import grids, pixels, with_horizon

H = W_ = 8

PX = """
px AS (
  SELECT vec_id AS frame_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x,
    CAST(floor(least(greatest((CAST(embedding[i] AS DOUBLE) + 0.6::DOUBLE) / 1.2::DOUBLE, 0.0::DOUBLE), 0.999999::DOUBLE) * 256) AS INTEGER) AS v
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i)
)
"""
#: With the grid mirrored: each place's neighbour at (dy, dx).
MIRROR = "CASE WHEN abs({p}) > 7 THEN 14 - abs({p}) ELSE abs({p}) END"
OTSU = """
hist AS (SELECT frame_id, v, count(*) AS n, sum(v) AS s FROM {src} GROUP BY ALL),
run AS (SELECT frame_id, v, sum(n) OVER w AS n0, sum(s) OVER w AS s0, sum(n) OVER (PARTITION BY frame_id) AS n1, sum(s) OVER (PARTITION BY frame_id) AS s1 FROM hist WINDOW w AS (PARTITION BY frame_id ORDER BY v)),
var AS (SELECT frame_id, v, CASE WHEN n0 < n1 THEN (CAST(s1 * n0 - n1 * s0 AS DOUBLE) * CAST(s1 * n0 - n1 * s0 AS DOUBLE)) / CAST(n0 * (n1 - n0) AS DOUBLE) ELSE -1 END AS var FROM run),
otsu AS (SELECT frame_id, CASE WHEN var > 0 THEN v ELSE 0 END AS t FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY var DESC, v) AS r FROM var) WHERE r = 1)
"""
MASK = f"{PX}, {OTSU.format(src='px')}, mask AS (SELECT px.frame_id, y, x, CASE WHEN v > t THEN 255 ELSE 0 END AS v FROM px JOIN otsu USING (frame_id))"


def near(src: str, agg: str, radius: int = 1) -> str:
    """An aggregate of the window around each place, without what lies outside."""
    return f"SELECT a.frame_id, a.y, a.x, {agg}(b.v) AS v FROM {src} a JOIN {src} b ON a.frame_id = b.frame_id AND b.y BETWEEN a.y - {radius} AND a.y + {radius} AND b.x BETWEEN a.x - {radius} AND a.x + {radius} GROUP BY ALL"


def weighted(src: str, across: tuple, down: tuple) -> str:
    r = len(across) // 2
    taps = ", ".join(f"({j - r}, {i - r}, {a * d})" for j, d in enumerate(down) for i, a in enumerate(across) if a * d)
    y, x = MIRROR.format(p="(a.y + t.dy)"), MIRROR.format(p="(a.x + t.dx)")
    return f"SELECT a.frame_id, a.y, a.x, CAST(sum(b.v * t.w) AS DOUBLE) AS v FROM {src} a, (VALUES {taps}) t(dy, dx, w), {src} b WHERE b.frame_id = a.frame_id AND b.y = {y} AND b.x = {x} GROUP BY ALL"


def frames(spark, sf_dir):
    return grids(table(spark, sf_dir, "embeddings"))


def masked(spark, sf_dir):
    return frames(spark, sf_dir).withColumn("mask", raster.above(F.col("img"), raster.otsu_threshold(F.col("img"))))


def raster_query(name: str, sql: str, of, mask: bool = False, width: int = W_):
    """Register a query that returns the places of an expression over the frames."""

    @query(name, sql)
    def run(spark, sf_dir):
        rows = (masked if mask else frames)(spark, sf_dir)
        return pixels(rows.select("frame_id", of(F.col("mask" if mask else "img")).alias("img")), width)

    return run


raster_query("pixel_grid", f"WITH {PX} SELECT * FROM px", lambda c: c)
raster_query("gaussian_blur", f"WITH {PX}, g AS ({weighted('px', (1, 4, 6, 4, 1), (1, 4, 6, 4, 1))}) SELECT frame_id, y, x, CAST(floor(v / 256 + 0.5::DOUBLE) AS INTEGER) AS v FROM g", lambda c: raster.gaussian(c, H, W_))
raster_query("morph_dilate", f"WITH {PX} {near('px', 'max')}", lambda c: raster.dilate(c, H, W_, 3))
raster_query("morph_close", f"WITH {MASK}, d AS ({near('mask', 'max')}) {near('d', 'min')}", lambda c: raster.close(c, H, W_, 3), mask=True)
raster_query("morph_open", f"WITH {MASK}, d AS ({near('mask', 'min')}) {near('d', 'max')}", lambda c: raster.open_(c, H, W_, 3), mask=True)
raster_query("morph_close_9", f"WITH {PX}, d AS ({near('px', 'max', 4)}) {near('d', 'min', 4)}", lambda c: raster.close(c, H, W_, 9))
raster_query("morph_gradient", f"WITH {MASK}, d AS ({near('mask', 'max')}), e AS ({near('mask', 'min')}) SELECT d.frame_id, d.y, d.x, d.v - e.v AS v FROM d JOIN e USING (frame_id, y, x)", lambda c: raster.gradient(c, H, W_), mask=True)
raster_query("sobel_x", f"WITH {PX} {weighted('px', (-1, 0, 1), (1, 2, 1))}", lambda c: raster.sobel_x(c, H, W_))
raster_query("sobel_y", f"WITH {PX} {weighted('px', (1, 2, 1), (-1, 0, 1))}", lambda c: raster.sobel_y(c, H, W_))
raster_query("box_mean", f"WITH {PX}, g AS ({weighted('px', (1,) * 5, (1,) * 5)}) SELECT frame_id, y, x, round(v / 25, 6) AS v FROM g", lambda c: F.transform(raster.box_mean(c, H, W_), lambda v: F.round(v, 6)))
raster_query("area_resize", f"WITH {PX} SELECT frame_id, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM px GROUP BY ALL", lambda c: raster.area_resize(c, H, W_, 2), width=4)
raster_query("nearest_resize", f"WITH {PX}, t AS (SELECT unnest(range(0, 144)) AS i) SELECT frame_id, i // 12 AS y, i % 12 AS x, v FROM t JOIN px ON px.y = CAST(floor((i // 12) * 8 / 12) AS INTEGER) AND px.x = CAST(floor((i % 12) * 8 / 12) AS INTEGER)", lambda c: raster.nearest_resize(c, H, W_, 12, 12), width=12)
raster_query("border_zeroed", f"WITH {PX} SELECT frame_id, y, x, CASE WHEN y IN (0, 7) OR x IN (0, 7) THEN 0 ELSE v END AS v FROM px", lambda c: raster.without_border(c, H, W_))
raster_query("linear_stretch", f"WITH {PX}, m AS (SELECT frame_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY ALL) SELECT frame_id, y, x, CAST(floor((v - lo)::DOUBLE / greatest((hi - lo)::DOUBLE, 1e-6::DOUBLE) * 255) AS INTEGER) AS v FROM px JOIN m USING (frame_id)", raster.stretched)
raster_query("top_connected_sky", f"""WITH RECURSIVE {MASK}, lit AS (SELECT frame_id, y, x FROM mask WHERE v > 0),
reach(frame_id, y, x) AS (SELECT * FROM lit WHERE y < 2 UNION SELECT lit.frame_id, lit.y, lit.x FROM reach r JOIN lit ON lit.frame_id = r.frame_id AND abs(lit.y - r.y) <= 1 AND abs(lit.x - r.x) <= 1)
SELECT mask.frame_id, mask.y, mask.x, CASE WHEN r.y IS NULL THEN 0 ELSE 255 END AS v FROM mask LEFT JOIN reach r USING (frame_id, y, x)""", lambda c: raster.top_connected(c, H, W_), mask=True)
raster_query("connected_components", f"""WITH RECURSIVE {MASK}, lit AS (SELECT frame_id, y, x, y * 8 + x AS i FROM mask WHERE v > 0),
reach(frame_id, i, j) AS (SELECT frame_id, i, i FROM lit UNION SELECT r.frame_id, r.i, b.i FROM reach r JOIN lit a ON a.frame_id = r.frame_id AND a.i = r.j JOIN lit b ON b.frame_id = a.frame_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
l AS (SELECT frame_id, i, min(j) AS label FROM reach GROUP BY ALL)
SELECT m.frame_id, m.y, m.x, coalesce(l.label, -1) AS v FROM mask m LEFT JOIN l ON l.frame_id = m.frame_id AND l.i = m.y * 8 + m.x""", lambda c: raster.components(c, H, W_), mask=True)


@query("otsu_threshold", f"WITH {PX}, {OTSU.format(src='px')} SELECT frame_id, CAST(t AS INTEGER) AS t FROM otsu")
def otsu(spark, sf_dir):
    return frames(spark, sf_dir).select("frame_id", raster.otsu_threshold(F.col("img")).alias("t"))


@query("mask_balance", f"WITH {MASK} SELECT frame_id, round(greatest(avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END), 1 - avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END)), 6) AS balance FROM mask GROUP BY frame_id")
def mask_balance(spark, sf_dir):
    return masked(spark, sf_dir).select("frame_id", F.round(raster.balance(F.col("mask")), 6).alias("balance"))


@query("mask_iou", f"""WITH {MASK}, c AS (SELECT a.frame_id, a.v > 0 AS p, b.v > 0 AS q FROM mask a JOIN (SELECT frame_id, y, x, CASE WHEN v > 127 THEN 255 ELSE 0 END AS v FROM px) b USING (frame_id, y, x))
SELECT frame_id, CASE WHEN count(*) FILTER (p OR q) = 0 THEN 1.0::DOUBLE ELSE round(count(*) FILTER (p AND q) / (count(*) FILTER (p OR q))::DOUBLE, 6) END AS iou FROM c GROUP BY frame_id""")
def mask_iou(spark, sf_dir):
    rows = masked(spark, sf_dir)
    return rows.select("frame_id", F.round(raster.iou(F.col("mask"), raster.above(F.col("img"), F.lit(127))), 6).alias("iou"))


def _points(rows, of: Column):
    return rows.select("frame_id", F.explode(of).alias("p")).select("frame_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


@query("column_scan", f"WITH {MASK} SELECT frame_id, x::DOUBLE AS x, min(CASE WHEN v = 0 THEN y END)::DOUBLE AS y FROM mask GROUP BY frame_id, x HAVING bool_or(v > 0) AND bool_or(v = 0)")
def column_scan(spark, sf_dir):
    return _points(masked(spark, sf_dir), raster.column_scan(F.col("mask"), H, W_))


@query("lower_envelope", f"WITH {MASK} SELECT frame_id, x::DOUBLE AS x, max(y)::DOUBLE AS y FROM mask WHERE v > 0 GROUP BY frame_id, x")
def lower_envelope(spark, sf_dir):
    return _points(masked(spark, sf_dir), raster.lower_envelope(F.col("mask"), H, W_))


@query("row_energy_peak", f"""WITH {PX}, g AS ({weighted('px', (1, 2, 1), (-1, 0, 1))}), e AS (SELECT frame_id, y, sum(abs(v)) / 8 AS e FROM g GROUP BY ALL),
s AS (SELECT a.frame_id, a.y, round(sum(b.e), 6) AS s FROM e a JOIN e b ON a.frame_id = b.frame_id AND abs(a.y - b.y) <= 1 GROUP BY ALL)
SELECT frame_id, CAST(y AS INTEGER) AS y FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY s DESC, y) AS r FROM s) WHERE r = 1""")
def row_energy_peak(spark, sf_dir):
    return frames(spark, sf_dir).select("frame_id", raster.row_energy_peak(F.col("img"), H, W_, 3).alias("y"))


@query("oriented_boundary", f"""WITH {MASK}, d AS ({near('mask', 'max')}), e AS ({near('mask', 'min')}),
b AS (SELECT d.frame_id, d.y, d.x, d.v - e.v AS v FROM d JOIN e USING (frame_id, y, x)), gx AS ({weighted('mask', (-1, 0, 1), (1, 2, 1))}), gy AS ({weighted('mask', (1, 2, 1), (-1, 0, 1))}),
k AS (SELECT b.*, gy.v * gy.v > sin(radians(15.0::DOUBLE)) * sin(radians(15.0::DOUBLE)) * (gx.v * gx.v + gy.v * gy.v + 1e-6::DOUBLE) AS keep FROM b JOIN gx USING (frame_id, y, x) JOIN gy USING (frame_id, y, x)),
c AS (SELECT frame_id, count(*) FILTER (v <> 0) AS n, count(*) FILTER (v <> 0 AND keep) AS m FROM k GROUP BY frame_id)
SELECT frame_id, y, x, CASE WHEN n > 8 AND m >= 8 AND NOT keep THEN 0 ELSE v END AS v FROM k JOIN c USING (frame_id)""")
def oriented_boundary(spark, sf_dir):
    rows = masked(spark, sf_dir).withColumn("edge", raster.gradient(F.col("mask"), H, W_))
    return pixels(rows.select("frame_id", raster.oriented(F.col("edge"), F.col("mask"), H, W_).alias("img")), W_)




def byte_of(value: str) -> str:
    """A vector's value as a byte of the grid."""
    return f"CAST(floor(least(greatest((CAST({value} AS DOUBLE) + 0.6::DOUBLE) / 1.2::DOUBLE, 0.0::DOUBLE), 0.999999::DOUBLE) * 256) AS INTEGER)"


#: Three channels from one frame: blue as it is, green in reverse order, red dimmed.
COLOUR = f"""b AS (SELECT vec_id AS frame_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, {byte_of("embedding[i]")} AS b, {byte_of("embedding[65 - i]")} AS g FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
c AS (SELECT *, b // 2 AS r FROM b)"""


def colours(spark, sf_dir):
    rows = frames(spark, sf_dir)
    three = F.zip_with("img", F.reverse("img"), lambda b, g: F.struct(b.alias("b"), g.alias("g"), F.floor(b / 2).cast("int").alias("r")))
    return rows.select("frame_id", F.posexplode(three).alias("i", "c")).select("frame_id", F.floor(F.col("i") / W_).cast("int").alias("y"), (F.col("i") % W_).alias("x"), "c.*")


@query("colour_planes", f"""WITH {COLOUR} SELECT frame_id, y, x, CAST(floor(0.114::DOUBLE * b + 0.587::DOUBLE * g + 0.299::DOUBLE * r + 0.5::DOUBLE) AS INTEGER) AS gray,
  CASE WHEN greatest(b, g, r) = 0 THEN 0 ELSE CAST(floor((greatest(b, g, r) - least(b, g, r)) * 255.0::DOUBLE / greatest(b, g, r) + 0.5::DOUBLE) AS INTEGER) END AS s, round(128 + 128.0::DOUBLE * (b - r) / (b + r + 1.0::DOUBLE), 6) AS blue FROM c""")
def colour_planes(spark, sf_dir):
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    return colours(spark, sf_dir).select("frame_id", "y", "x", raster.bgr_gray(b, g, r).alias("gray"), raster.saturation(b, g, r).alias("s"), F.round(raster.blue_excess(b, r), 6).alias("blue"))


@query("lab_planes", f"""WITH {COLOUR}, l AS (SELECT *, {", ".join(f"CASE WHEN {k} / 255.0::DOUBLE <= 0.04045::DOUBLE THEN {k} / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow(({k} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END AS l{k}" for k in "bgr")} FROM c),
v AS (SELECT *, (0.412453::DOUBLE * lr + 0.357580::DOUBLE * lg + 0.180423::DOUBLE * lb) / 0.950456::DOUBLE AS xx, 0.212671::DOUBLE * lr + 0.715160::DOUBLE * lg + 0.072169::DOUBLE * lb AS yy, (0.019334::DOUBLE * lr + 0.119193::DOUBLE * lg + 0.950227::DOUBLE * lb) / 1.088754::DOUBLE AS zz FROM l),
f AS (SELECT *, {", ".join(f"CASE WHEN {k} > 0.008856::DOUBLE THEN cbrt({k}) ELSE 7.787::DOUBLE * {k} + 16.0::DOUBLE / 116 END AS f{k}" for k in ("xx", "yy", "zz"))}, CASE WHEN yy > 0.008856::DOUBLE THEN 116 * cbrt(yy) - 16 ELSE 903.3::DOUBLE * yy END AS light FROM v)
SELECT frame_id, y, x, CAST(least(greatest(round_even(light * 255 / 100, 0), 0), 255) AS INTEGER) AS l, CAST(least(greatest(round_even(500 * (fxx - fyy) + 128, 0), 0), 255) AS INTEGER) AS a, CAST(least(greatest(round_even(200 * (fyy - fzz) + 128, 0), 0), 255) AS INTEGER) AS b FROM f""")
def lab_planes(spark, sf_dir):
    return colours(spark, sf_dir).select("frame_id", "y", "x", raster.lab(F.col("b"), F.col("g"), F.col("r")).alias("c")).select("frame_id", "y", "x", "c.*")


SYNTH = """
sl AS (SELECT vec_id AS frame_id, embedding, (vec_id * 37 % 101 - 50) / 100.0::DOUBLE AS slope, 0.3::DOUBLE + (vec_id * 17 % 41) / 100.0::DOUBLE AS off FROM embeddings),
px AS (SELECT frame_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(floor(least(greatest(128 + 60 * CASE WHEN (i - 1) // 8 < slope * ((i - 1) % 8) + off * 8 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END + 100 * CAST(embedding[i] AS DOUBLE), 0.0::DOUBLE), 255.0::DOUBLE)) AS INTEGER) AS v
  FROM sl, (SELECT unnest(range(1, 65)) AS i))
"""


@query("horizon_frames", f"WITH {SYNTH} SELECT frame_id, y, x, v FROM px")
def horizon_frames(spark, sf_dir):
    return pixels(with_horizon(table(spark, sf_dir, "embeddings")), W_)
