"""Queries of the fitting, likelihood and scoring layers over 8 x 8 frames."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from levelframe.functions import lines
from levelframe.operators import fits, likelihood, raster, scoring
from levelframe.plans import detectors
from levelframe.plans.raster_queries import H, MASK, OTSU, PX, SYNTH, W_, masked
from levelframe.plans.registry import query
from levelframe.session import table
from levelframe.sources.tables import grids, pixels, with_horizon

#: Inlier distance on frames of eight rows.
NEAR = 0.75


def r(c, n: int = 6):
    return F.round(c, n)


def synthetic(spark, sf_dir):
    """Frames with a known horizon, with mask, boundary points and planes."""
    rows = with_horizon(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("mask", raster.above(F.col("img"), raster.otsu_threshold(F.col("img"))))
    return rows.withColumn("scan", raster.column_scan(F.col("mask"), H, W_)).withColumn("planes", F.array("img", "raw"))


S_MASK = f"{SYNTH}, {OTSU.format(src='px')}, mask AS (SELECT px.frame_id, y, x, CASE WHEN v > t THEN 255 ELSE 0 END AS v FROM px JOIN otsu USING (frame_id))"
SCAN = f"{S_MASK}, pt AS (SELECT frame_id, x::DOUBLE AS x, min(CASE WHEN v = 0 THEN y END)::DOUBLE AS y, row_number() OVER (PARTITION BY frame_id ORDER BY x) - 1 AS k FROM mask GROUP BY frame_id, mask.x HAVING bool_or(v > 0) AND bool_or(v = 0))"


@query("ols_fit", f"WITH {SCAN} SELECT frame_id, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM pt GROUP BY frame_id HAVING count(*) >= 2")
def ols_fit(spark, sf_dir):
    rows = synthetic(spark, sf_dir).withColumn("f", fits.ols(F.col("scan"))).filter("f IS NOT NULL")
    return rows.select("frame_id", F.size("scan").cast("long").alias("n"), r("f.slope").alias("slope"), r("f.intercept").alias("intercept"))


TLS = "0.5::DOUBLE * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y))"


@query("tls_fit", f"WITH {SCAN} SELECT frame_id, round(degrees({TLS}), 4) AS deg, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM pt GROUP BY frame_id HAVING count(*) >= 2")
def tls_fit(spark, sf_dir):
    rows = synthetic(spark, sf_dir).withColumn("f", fits.tls(F.col("scan"))).filter("f IS NOT NULL")
    return rows.select("frame_id", r(lines.direction_deg(F.col("f")), 4).alias("deg"), r("f.x0").alias("cx"), r("f.y0").alias("cy"))


HYP = f"""{SCAN}, hyp AS (SELECT p.frame_id, p.k AS i, q.k AS j, p.x AS x0, p.y AS y0, (q.x - p.x) / sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) AS vx, (q.y - p.y) / sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) AS vy
  FROM pt p JOIN pt q ON p.frame_id = q.frame_id AND p.k < q.k),
inl AS (SELECT h.*, s.k, s.x, s.y FROM hyp h JOIN pt s ON s.frame_id = h.frame_id AND round(abs((s.x - h.x0) * h.vy - (s.y - h.y0) * h.vx), 9) < {NEAR}::DOUBLE),
cnt AS (SELECT frame_id, i, j, any_value(x0) AS x0, any_value(y0) AS y0, any_value(vx) AS vx, any_value(vy) AS vy, count(*) AS n FROM inl GROUP BY frame_id, i, j HAVING count(*) >= 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, i, j) AS rank FROM cnt)"""


def hyps(spark, sf_dir):
    return fits.hypotheses(synthetic(spark, sf_dir).select("frame_id", F.col("scan").alias("points")), ["frame_id"], limit=NEAR)


@query("ransac_exhaustive", f"WITH {HYP} SELECT frame_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(n AS INTEGER) AS n FROM cnt")
def ransac_exhaustive(spark, sf_dir):
    return hyps(spark, sf_dir).select("frame_id", "i", "j", "n")


@query("ransac_top_k", f"WITH {HYP} SELECT frame_id, CAST(rank AS INTEGER) AS rank, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(n AS INTEGER) AS n FROM rk WHERE rank <= 8")
def ransac_top_k(spark, sf_dir):
    return fits.top_k(hyps(spark, sf_dir), ["frame_id"]).select("frame_id", "rank", "i", "j", "n")


@query("ransac_early_stop", f"""WITH {HYP}, tot AS (SELECT frame_id, count(*) AS m FROM pt GROUP BY frame_id),
b AS (SELECT *, (row_number() OVER (PARTITION BY frame_id ORDER BY i, j) - 1) // 10 AS batch FROM cnt),
s AS (SELECT *, max(n) OVER (PARTITION BY frame_id ORDER BY batch RANGE UNBOUNDED PRECEDING) AS best FROM b),
t AS (SELECT s.*, min(CASE WHEN best >= floor(0.75::DOUBLE * m) THEN batch END) OVER (PARTITION BY frame_id) AS stop FROM s JOIN tot USING (frame_id)),
u AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, i, j) AS r FROM t WHERE stop IS NULL OR batch <= stop)
SELECT frame_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(n AS INTEGER) AS n FROM u WHERE r = 1""")
def ransac_early_stop(spark, sf_dir):
    return fits.early_stop(hyps(spark, sf_dir), ["frame_id"], batch=10).select("frame_id", "i", "j", "n")


@query("best_refit", f"""WITH {HYP} SELECT inl.frame_id, count(*) AS n, round(degrees({TLS}), 4) AS deg FROM inl JOIN rk ON rk.frame_id = inl.frame_id AND rk.i = inl.i AND rk.j = inl.j WHERE rank = 1 GROUP BY inl.frame_id""")
def best_refit(spark, sf_dir):
    best = fits.top_k(hyps(spark, sf_dir), ["frame_id"], 1)
    ln = fits.tls(fits.inlier_points(F.col("points"), F.col("inliers")))
    return best.select("frame_id", F.col("n").cast("long").alias("n"), r(lines.direction_deg(ln), 4).alias("deg"))


@query("overlap_pairs", f"""WITH {HYP}, t AS (SELECT * FROM rk WHERE rank <= 8), m AS (SELECT t.frame_id, t.rank, t.n, inl.k FROM t JOIN inl ON inl.frame_id = t.frame_id AND inl.i = t.i AND inl.j = t.j)
SELECT a.frame_id, CAST(a.rank AS INTEGER) AS a, CAST(b.rank AS INTEGER) AS b FROM m a JOIN m b ON a.frame_id = b.frame_id AND a.rank < b.rank AND a.k = b.k GROUP BY a.frame_id, a.rank, b.rank HAVING count(*) / greatest(any_value(a.n), any_value(b.n))::DOUBLE > 0.7""")
def overlap_pairs(spark, sf_dir):
    top = fits.top_k(hyps(spark, sf_dir), ["frame_id"])
    a, b = top.alias("a"), top.alias("b")
    shared = F.size(F.array_intersect("a.inliers", "b.inliers")) / F.greatest("a.n", "b.n")
    return a.join(b, (F.col("a.frame_id") == F.col("b.frame_id")) & (F.col("a.rank") < F.col("b.rank"))).filter(shared > 0.7).select("a.frame_id", F.col("a.rank").alias("a"), F.col("b.rank").alias("b"))


@query("overlap_clusters")
def overlap_clusters(spark, sf_dir):
    found = fits.clusters(fits.top_k(hyps(spark, sf_dir), ["frame_id"]), ["frame_id"])
    return found.select("frame_id", "cluster", "n", r("confidence").alias("confidence"), r(lines.folded_angle(F.col("line")), 4).alias("deg"))


@query("huber_fit")
def huber_fit(spark, sf_dir):
    rows = synthetic(spark, sf_dir).withColumn("f", fits.huber(F.col("scan"))).filter("f IS NOT NULL")
    return rows.select("frame_id", r(lines.folded_angle(F.col("f")), 4).alias("deg"), r(lines.y_at(F.col("f"), F.lit(3.5)), 4).alias("y_mid"))


@query("subsampled_points", f"WITH {MASK} SELECT frame_id, least(count(*) FILTER (v > 0), 16) AS n, count(*) FILTER (v > 0) AS of FROM mask GROUP BY frame_id")
def subsampled_points(spark, sf_dir):
    rows = masked(spark, sf_dir).withColumn("p", raster.points(F.col("mask"), W_)).withColumn("s", fits.subsample(F.col("p"), F.col("frame_id"), 16))
    return rows.select("frame_id", F.size(F.array_intersect("s", "p")).cast("long").alias("n"), F.size("p").cast("long").alias("of"))


@query("channel_pick", f"""WITH {PX}, c AS (SELECT frame_id, count(*) FILTER (v > 140) / 64.0::DOUBLE AS a, count(*) FILTER (v < 90) / 64.0::DOUBLE AS b FROM px GROUP BY frame_id)
SELECT frame_id, CASE WHEN greatest(a, b) < 0.3::DOUBLE THEN 'rows' WHEN a >= b THEN 'gray' ELSE 'blue' END AS channel, round(CASE WHEN greatest(a, b) < 0.3::DOUBLE THEN 0 ELSE greatest(a, b) END, 6) AS confidence FROM c""")
def channel_pick(spark, sf_dir):
    """The channel with the greater confidence, the first of equals; below 0.3 the row scan with none."""
    rows = grids(table(spark, sf_dir, "embeddings"))
    share = lambda f, channel: F.struct((F.size(F.filter("img", f)) / 64.0).alias("confidence"), F.lit(channel).alias("channel"))
    best = rows.select("frame_id", detectors.surer(share(lambda v: v > 140, "gray"), share(lambda v: v < 90, "blue")).alias("b"))
    return best.select("frame_id", F.coalesce("b.channel", F.lit("rows")).alias("channel"), r(F.coalesce("b.confidence", F.lit(0.0))).alias("confidence"))


BANDS = f"""{SYNTH}, raw AS (SELECT vec_id AS frame_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(floor(least(greatest((CAST(embedding[i] AS DOUBLE) + 0.6::DOUBLE) / 1.2::DOUBLE, 0.0::DOUBLE), 0.999999::DOUBLE) * 256) AS INTEGER) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
pl AS (SELECT 0 AS p, * FROM px UNION ALL SELECT 1 AS p, * FROM raw),
sd AS (SELECT p, frame_id, CASE WHEN y < 4 THEN 'sky' ELSE 'ground' END AS side, v FROM pl),
mu AS (SELECT p, frame_id, side, median(v) AS mu FROM sd GROUP BY ALL),
sc AS (SELECT p, frame_id, side, mu, greatest(1.4826::DOUBLE * median(abs(v - mu)), 6.0::DOUBLE) AS scale FROM sd JOIN mu USING (p, frame_id, side) GROUP BY ALL),
m AS (SELECT s.p, s.frame_id, s.mu AS ms, s.scale AS ss, g.mu AS mg, g.scale AS sg FROM sc s JOIN sc g ON s.p = g.p AND s.frame_id = g.frame_id AND s.side = 'sky' AND g.side = 'ground'),
llr AS (SELECT frame_id, y, x, greatest(least(sum(-0.5::DOUBLE * (((v - ms) / ss) * ((v - ms) / ss) + 2 * ln(ss)) + 0.5::DOUBLE * (((v - mg) / sg) * ((v - mg) / sg) + 2 * ln(sg))), 8.0::DOUBLE), -8.0::DOUBLE) AS v FROM pl JOIN m USING (p, frame_id) GROUP BY ALL)"""


@query("seed_separation", f"WITH {BANDS} SELECT frame_id, round(sqrt(avg(((ms - mg) / (ss + sg)) * ((ms - mg) / (ss + sg)))), 6) AS separation FROM m GROUP BY frame_id")
def seed_separation(spark, sf_dir):
    rows = synthetic(spark, sf_dir)
    return rows.select("frame_id", r(likelihood.separation(likelihood.models(F.col("planes"), H, W_))).alias("separation"))


def _llr(spark, sf_dir):
    rows = synthetic(spark, sf_dir).withColumn("m", likelihood.models(F.col("planes"), H, W_))
    return rows.withColumn("llr", likelihood.ratio(F.col("planes"), F.col("m")))


@query("likelihood_ratio", f"WITH {BANDS} SELECT frame_id, y, x, round(v, 5) AS v FROM llr")
def likelihood_ratio(spark, sf_dir):
    return _llr(spark, sf_dir).select("frame_id", F.posexplode("llr").alias("i", "v")).select("frame_id", F.floor(F.col("i") / W_).cast("int").alias("y"), (F.col("i") % W_).alias("x"), r("v", 5).alias("v"))


SPLITS = f"""{BANDS}, st AS (SELECT unnest(range(0, 9)) AS s), tot AS (SELECT frame_id, x, sum(v) AS t FROM llr GROUP BY ALL),
sp AS (SELECT tot.frame_id, tot.x, st.s, 2 * coalesce((SELECT sum(v) FROM llr l WHERE l.frame_id = tot.frame_id AND l.x = tot.x AND l.y < st.s), 0) - t - CASE WHEN st.s < 3 OR st.s > 5 THEN 2.0::DOUBLE ELSE 0 END AS v FROM tot, st)"""


@query("split_scores", f"WITH {SPLITS} SELECT frame_id, CAST(x AS INTEGER) AS x, CAST(s AS INTEGER) AS split, round(v, 5) AS v FROM sp")
def split_scores(spark, sf_dir):
    rows = _llr(spark, sf_dir).select("frame_id", F.posexplode(likelihood.split_scores(F.col("llr"), H, W_)).alias("x", "c"))
    return rows.select("frame_id", "x", F.posexplode("c").alias("split", "v")).withColumn("v", r("v", 5))


@query("boundary_path", f"""WITH RECURSIVE {SPLITS}, col AS (SELECT frame_id, x, list(v ORDER BY s) AS c FROM sp GROUP BY ALL),
dp AS (SELECT frame_id, x, c AS best FROM col WHERE x = 0
UNION ALL SELECT col.frame_id, col.x, list_transform(range(0, 9), lambda y: col.c[y + 1] + list_max(list_transform(list_filter(range(0, 9), lambda q: abs(q - y) <= 3), lambda q: dp.best[q + 1] - 0.35::DOUBLE * abs(q - y)))) FROM dp JOIN col ON col.frame_id = dp.frame_id AND col.x = dp.x + 1)
SELECT frame_id, round(list_max(best), 4) AS score, true AS steps_fit FROM dp WHERE x = 7""")
def boundary_path(spark, sf_dir):
    rows = _llr(spark, sf_dir).withColumn("b", likelihood.best_path(likelihood.split_scores(F.col("llr"), H, W_)))
    path = F.col("b.path")
    fit = F.forall(F.zip_with(F.slice(path, 1, W_ - 1), F.slice(path, 2, W_ - 1), lambda p, q: F.abs(p - q)), lambda d: d <= likelihood.MAX_STEP)
    return rows.select("frame_id", r("b.score", 4).alias("score"), (fit & (F.size(path) == W_)).alias("steps_fit"))


COH = f"""{BANDS}, side AS (SELECT pl.p, pl.frame_id, pl.v::DOUBLE AS v, round((pl.x - 0.0::DOUBLE) * slope - (pl.y - off * 8) * 1.0::DOUBLE, 9) < 0 AS up, slope FROM pl JOIN sl USING (frame_id)),
n AS (SELECT frame_id, count(*) FILTER (p = 0 AND up) AS nu, count(*) FILTER (p = 0 AND NOT up) AS nd FROM side GROUP BY frame_id),
mo AS (SELECT p, frame_id, any_value(slope) AS slope, pow(avg(v) FILTER (up) - avg(v) FILTER (NOT up), 2) AS d, var_pop(v) FILTER (up) + var_pop(v) FILTER (NOT up) AS s FROM side GROUP BY p, frame_id),
pr AS (SELECT frame_id, any_value(degrees(atan(abs(slope)))) AS roll, sum(d) / (sum(s) + 1) AS c FROM mo GROUP BY frame_id)"""


@query("region_coherence", f"""WITH {COH} SELECT frame_id, round(CASE WHEN nu < 16 OR nd < 16 THEN -1.0::DOUBLE ELSE c * CASE WHEN roll <= 60 THEN 1.0::DOUBLE WHEN roll >= 85 THEN 0.05::DOUBLE ELSE 1 - (roll - 60) / 25 * 0.95::DOUBLE END END, 6) AS coherence FROM pr JOIN n USING (frame_id)""")
def region_coherence(spark, sf_dir):
    ln = lines.label_line(F.col("slope"), F.col("offset"), F.lit(float(H)))
    rows = synthetic(spark, sf_dir).withColumn("ln", ln)
    return rows.select("frame_id", r(scoring.coherence(F.col("planes"), F.col("ln"), W_)).alias("coherence"))


@query("priors", """SELECT event_id, round(CASE WHEN value <= 60 THEN 1.0::DOUBLE WHEN value >= 85 THEN 0.05::DOUBLE ELSE 1 - (value - 60) / 25 * 0.95::DOUBLE END, 6) AS angle_prior,
  round(exp(-(pow(value / 10 / 8.0::DOUBLE, 2) + pow(value / 2000 / 0.14::DOUBLE, 2))), 6) AS temporal_prior FROM events""")
def priors(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", r(lines.angle_prior(v)).alias("angle_prior"), r(lines.temporal_prior(v / 10, v / 2000)).alias("temporal_prior"))


@query("winning_candidate", f"""WITH {HYP}, c AS (SELECT frame_id, rank, n, round(n * (1 - abs(vy)), 9) AS score FROM rk WHERE rank <= 8),
w AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, rank) AS r FROM c) SELECT frame_id, CAST(rank AS INTEGER) AS rank, CAST(n AS INTEGER) AS n, round(score, 6) AS score FROM w WHERE r = 1""")
def winning_candidate(spark, sf_dir):
    pool = fits.top_k(hyps(spark, sf_dir), ["frame_id"]).withColumn("source", F.lit("L")).withColumn("score", F.round(F.col("n") * (1 - F.abs("line.vy")), 9))
    return scoring.winners(scoring.with_place(pool), ["frame_id"]).select("frame_id", "rank", "n", r("score").alias("score"))


@query("candidate_pool", f"""WITH {HYP}, a AS (SELECT frame_id, 'L' AS source, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 8), b AS (SELECT frame_id, 'b' AS source, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 2)
SELECT source, count(*) AS n, count(DISTINCT frame_id) AS frames FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY source""")
def candidate_pool(spark, sf_dir):
    top = fits.top_k(hyps(spark, sf_dir), ["frame_id"]).select("frame_id", "rank", F.lit("L").alias("source"))
    pool = top.unionByName(top.filter("rank <= 2").withColumn("source", F.lit("b")))
    return pool.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("frame_id").alias("frames"))


@query("best_so_far", f"WITH {HYP} SELECT frame_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(max(n) OVER (PARTITION BY frame_id ORDER BY i, j ROWS UNBOUNDED PRECEDING) AS INTEGER) AS best FROM cnt")
def best_so_far(spark, sf_dir):
    by = W.partitionBy("frame_id").orderBy("i", "j").rowsBetween(W.unboundedPreceding, 0)
    return hyps(spark, sf_dir).select("frame_id", "i", "j", F.max("n").over(by).alias("best"))


@query("path_mask", f"""WITH {S_MASK}, cut AS (SELECT frame_id, x, coalesce(min(CASE WHEN v = 0 THEN y END), 8) AS c FROM mask GROUP BY ALL) SELECT mask.frame_id, mask.y, mask.x, CASE WHEN mask.y < c THEN 255 ELSE 0 END AS v FROM mask JOIN cut USING (frame_id, x)""")
def path_mask(spark, sf_dir):
    """A mask from a boundary row for each column: sky is above it."""
    rows = synthetic(spark, sf_dir).select("frame_id", raster.path_mask(raster.first_ground(F.col("mask"), H, W_), H, W_).alias("img"))
    return pixels(rows, W_)
