"""Operators on made frames: known lines are found, degenerate frames abstain, the fold follows its definition."""

import numpy as np
from pyspark.sql import functions as F

from levelframe.functions import lines
from levelframe.operators import batches, evaluation, fits, raster, scoring, temporal
from levelframe.plans import detectors
from levelframe.sources import tables

N = 24
SHAPE = detectors.Shape(N, N, window=5, near=1.0, max_points=40)


def half_plane(slope: float, offset: float):
    y, x = np.mgrid[:N, :N]
    return np.where(y < slope * x + offset * N, 200, 50).ravel().astype(int).tolist()


def frames(spark, *planes):
    return spark.createDataFrame([(k, p, p) for k, p in enumerate(planes)], "frame_id long, img array<int>, raw array<int>")


def test_pipelines_find_a_known_line(spark):
    df = frames(spark, half_plane(0.3, 0.4), half_plane(-0.2, 0.6))
    for name in detectors.REGISTRY:
        got = {r.frame_id: r for r in detectors.REGISTRY[name][0](df, SHAPE).select("frame_id", "status", lines.folded_angle(F.col("line")).alias("deg"), lines.y_at(F.col("line"), F.lit(N / 2)).alias("y")).collect()}
        for k, (slope, offset) in enumerate(((0.3, 0.4), (-0.2, 0.6))):
            assert got[k].status == "line"
            assert abs(got[k].deg - np.degrees(np.arctan(slope))) < 2.5, name
            assert abs(got[k].y - (slope * N / 2 + offset * N)) < 1.5, name


def test_flat_frame_fails(spark):
    df = frames(spark, [90] * N * N)
    assert detectors.a1(df, SHAPE).first().status == "failed"
    assert detectors.a5(df, SHAPE).first().status == "failed"
    assert detectors.a6(df, SHAPE).first().status == "line"
    assert detectors.a3(df, SHAPE).first().status == "failed"
    assert {name: detectors.REGISTRY[name][0](df, SHAPE).first().status for name in ("a7", "a10")} == {"a7": "no_horizon", "a10": "no_horizon"}
    assert detectors.top_n(df, SHAPE, 3).first().results == []


def test_seeded_search_thumbnails_and_five_planes(spark):
    df = frames(spark, half_plane(0.3, 0.4)).withColumns({k: F.col("img") for k in detectors.STACK})
    s = detectors.Shape(N, N, window=5, near=1.0, max_points=40, iterations=60, seed=3, thumb=(9, 12))
    for f in (detectors.a5, detectors.a10):
        r = f(df, s).select("status", lines.folded_angle(F.col("line")).alias("deg")).first()
        assert r.status == "line" and abs(r.deg - np.degrees(np.arctan(0.3))) < 3
    sky = detectors.pool(df, s, True, True).select(F.filter("candidates", lambda c: c["source"].isin("path", "sky")).alias("c")).first().c
    assert sky and all(abs(np.degrees(np.arctan2(c.line.vy, c.line.vx)) - 16.7) < 6 for c in sky)
    assert len(detectors.top_n(df, s, 2).first().results) in (1, 2)


def test_otsu_and_components(spark):
    df = frames(spark, [10] * (N * N // 2) + [200] * (N * N // 2))
    assert df.select(raster.otsu_threshold(F.col("img")).alias("t")).first().t == 10
    mask = [255 if k in (0, 1, 9, 15) else 0 for k in range(16)]
    got = spark.createDataFrame([(mask,)], "m array<int>").select(raster.components(F.col("m"), 4, 4).alias("c"), raster.top_connected(F.col("m"), 4, 4).alias("t")).first()
    assert [got.c[k] for k in (0, 1, 9, 15)] == [0, 0, 9, 15] and [got.t[k] for k in (0, 9, 15)] == [255, 0, 0]


def test_iou_of_empty_and_equal_masks(spark):
    df = spark.createDataFrame([([0, 0], [0, 0]), ([1, 0], [1, 0]), ([1, 0], [0, 1])], "a array<int>, b array<int>")
    assert [r.i for r in df.select(raster.iou(F.col("a"), F.col("b")).alias("i")).collect()] == [1.0, 1.0, 0.0]


def test_huber_resists_an_outlier(spark):
    points = [(float(k), 0.5 * k + 1) for k in range(20)] + [(10.0, 25.0)]
    ln = spark.createDataFrame([(points,)], f"p {fits.POINTS}").select(lines.folded_angle(fits.huber(F.col("p"))).alias("d"), lines.folded_angle(fits.tls(F.col("p"))).alias("t")).first()
    assert abs(ln.d - np.degrees(np.arctan(0.5))) < 1 < abs(ln.t - np.degrees(np.arctan(0.5)))


def test_scene_limit_is_inclusive(spark):
    df = spark.createDataFrame([(k, [v]) for k, v in enumerate((0.0, 22.0, 44.1, 66.0))], "seq long, thumb array<double>")
    got = temporal.scenes(df, ["seq"]).orderBy("seq").collect()
    assert [r.continuous for r in got] == [False, True, False, True] and [r.scene for r in got] == [0, 0, 1, 1]


def test_fold_prefers_the_line_before_and_forgets_it_after_abstaining(spark):
    near, far = (1.0, 0.0, 0.0, 10.0), (1.0, 1.0, 0.0, 10.0)
    c = lambda *cs: [("L", k, raw, ln, 5) for k, (raw, ln) in enumerate(cs, start=1)]
    rows = [(0, 0, c((1.0, near))), (0, 1, c((1.0, far), (0.6, near))), (0, 2, c((0.1, near))), (0, 3, c((1.0, far), (0.6, near)))]
    df = spark.createDataFrame(rows, f"scene int, seq long, candidates array<{temporal.CANDIDATE}>")
    got = {r.seq: r.result for r in temporal.fold(df, ["scene"], "seq", 24, 24, 0.22).collect()}
    assert got[0].raw == 1.0 and got[1].raw == 0.6 and got[2] is None and got[3].raw == 1.0


def test_stream_agrees_with_the_fold(spark, tmp_path):
    from levelframe.streaming.temporal import carried

    rng = np.random.default_rng(3)
    rows = [(f"c{k % 2}", k, [float(rng.integers(0, 40))], [(source, float(3 * rng.random()), 1.0, float(rng.normal() / 4), 0.0, float(rng.integers(0, 24)), int(rng.integers(1, 9))) for source in ("L", "b", "sky")[: rng.integers(0, 4)]]) for k in range(80)]
    schema = "clip string, seq long, thumb array<double>, candidates array<struct<source:string,raw:double,vx:double,vy:double,x0:double,y0:double,count:int>>"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = carried(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 24.0, 24.0, 0.3).writeStream.format("memory").queryName("carried").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    stream = {r.seq: r.score for r in spark.table("carried").collect()}
    pool = F.transform("candidates", lambda c, k: F.struct(c["source"].alias("source"), (k + 1).cast("int").alias("place"), c["raw"].alias("raw"), F.struct(c["vx"].alias("vx"), c["vy"].alias("vy"), c["x0"].alias("x0"), c["y0"].alias("y0")).alias("line"), c["count"].alias("count")))
    scened = temporal.scenes(df.withColumn("candidates", pool), ["seq"], clip=["clip"])
    batch = {r.seq: r.result and r.result.raw for r in temporal.fold(scened, ["clip", "scene"], "seq", 24, 24, 0.3).collect()}
    assert batch == stream and None in batch.values()
    # late frames: one of each clip again, after later ones
    assert not any(r.late for r in spark.table("carried").collect())


def test_late_frames_of_the_stream():
    from levelframe.streaming.temporal import Carried

    c = [{"source": "L", "raw": 1.0, "vx": 1.0, "vy": 0.0, "x0": 0.0, "y0": 9.0, "count": 4}]
    at = Carried()
    assert at.next(3, [1.0], c, 24, 24, 0.3) == (3, False, 0, 1.0, 0.0, 0.0, 9.0, 1.0, False)
    assert at.next(2, [90.0], c, 24, 24, 0.3)[1:] == (False, 0, None, None, None, None, None, True) and at.thumb == [1.0]
    assert at.next(4, [2.0], None, 24, 24, 0.3)[1:3] == (True, 0) and at.line is None
    assert at.next(5, [60.0], c, 24, 24, 0.3)[1:3] == (False, 1)


def test_batch_kernels_give_the_values_of_the_expressions(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [int(v) for v in np.clip(np.array(half_plane(0.1 * k - 0.3, 0.5)) + rng.normal(0, 40, N * N), 0, 255)] if k else None) for k in range(6)]
    df = spark.createDataFrame(rows, "frame_id long, img array<int>")
    got = df.withColumn("m", batches.masks(F.col("img"), N, N, 5)).withColumn("p", batches.boundaries(F.col("m"), N, N, True)).collect()
    smooth = raster.gaussian(F.col("img"), N, N)
    want = detectors.once(df, "s", smooth).withColumn("m", raster.open_(raster.close(raster.above(F.col("s"), raster.otsu_threshold(F.col("s"))), N, N, 5), N, N, 5))
    want = detectors.once(want, "m", F.col("m")).withColumn("e", raster.without_border(raster.gradient(F.col("m"), N, N), N, N))
    want = detectors.once(want, "e", F.col("e")).withColumn("p", raster.points(raster.oriented(F.col("e"), F.col("m"), N, N), N)).filter("frame_id > 0").collect()
    by = {r.frame_id: r for r in got}
    assert by[0].m is None and by[0].p is None
    assert all(by[r.frame_id].m == r.m and by[r.frame_id].p == r.p for r in want) and len(want) == 5
    ln = "struct<vx:double,vy:double,x0:double,y0:double>"
    both = spark.createDataFrame([(1, [rows[1][1], rows[2][1]], [(1.0, 0.2, 0.0, 8.0), (0.2, 1.0, 9.0, 3.0), (1.0, 0.0, 0.0, -5.0)]), (2, None, None)], f"k int, planes array<array<int>>, ls array<{ln}>")
    plain = both.filter("k = 1").select(F.transform("ls", lambda q: scoring.coherence(F.col("planes"), q, N)).alias("c")).first().c
    ours = {r.k: r.c for r in both.select("k", batches.coherences(F.col("planes"), F.col("ls"), N).alias("c")).collect()}
    assert np.allclose(plain, ours[1]) and ours[1][2] == -1.0 and ours[2] == []


def test_search_in_the_row(spark):
    rng = np.random.default_rng(9)
    cases = [[(float(x), float(y)) for x, y in rng.integers(0, 12, (n, 2))] for n in (0, 1, 2, 9, 30)] + [[(2.0, 2.0)] * 4, None]
    df = spark.createDataFrame(list(enumerate(cases)), f"frame_id int, points {fits.POINTS}")
    found = {r.frame_id: r for r in df.select("frame_id", fits.searched(F.col("points"), 1.0, 5).alias("h"), fits.searched(F.col("points"), 1.0, 5, iterations=20, seed=7).alias("s"), fits.searched(F.col("points"), 1.0, 5, iterations=20, seed=7).alias("again")).collect()}
    want = {}
    for r in fits.top_k(fits.hypotheses(df, ["frame_id"], limit=1.0), ["frame_id"], 5).withColumn("refit", fits.huber(fits.inlier_points(F.col("points"), F.col("inliers")))).orderBy("frame_id", "rank").collect():
        want.setdefault(r.frame_id, []).append(r)
    for k, r in found.items():
        assert [(h.n, h.i, h.j, h.inliers) for h in r.h] == [(h.n, h.i, h.j, h.inliers) for h in want.get(k, [])]
        assert all(np.allclose(h.refit, w.refit, atol=1e-6) for h, w in zip(r.h, want.get(k, []), strict=True))
        assert r.s == r.again and len({(h.i, h.j) for h in r.s}) == len(r.s) and all(h.i < h.j for h in r.s)
    assert len(found[2].s) == 1 and found[5].h == []


def test_batched_huber_fit(spark):
    rng = np.random.default_rng(2)
    cases = [[(float(x), float(y)) for x, y in rng.normal(0, 9, (n, 2))] for n in (0, 1, 2, 40)] + [None]
    df = spark.createDataFrame(list(enumerate(cases)), f"k int, p {fits.POINTS}")
    got = {r.k: (r.a, r.b) for r in df.select("k", fits.huber(F.col("p")).alias("a"), fits.huber_batched(F.col("p")).alias("b")).collect()}
    assert all(got[k] == (None, None) for k in (0, 1, 4)) and all(np.allclose(*got[k], atol=1e-9) for k in (2, 3))


def test_early_stop_saves_the_later_batches():
    x, y = np.r_[np.arange(30.0), 5.0, 6.0], np.r_[np.zeros(30), 9.0, 3.0]
    assert fits.best_pairs(x, y, 0.5, 1, 2, 0.75, None, 0)[0]["n"] == 30
    assert fits.best_pairs(x[::-1], y[::-1], 0.5, 1, 2, 0.01, None, 0)[0]["n"] < 30


def test_early_stop_and_clusters(spark):
    points = [(float(k), 2.0) for k in range(10)] + [(3.0, 9.0)]
    df = spark.createDataFrame([(1, points)], f"frame_id long, points {fits.POINTS}")
    h = fits.hypotheses(df, ["frame_id"], limit=0.5)
    assert fits.early_stop(h, ["frame_id"], batch=5).first().n == 10
    best = fits.clusters(fits.top_k(h, ["frame_id"]), ["frame_id"]).filter("cluster = 1").first()
    assert best.n == 10 and abs(best.line.vy) < 1e-9


def test_summary_of_no_frames(spark):
    df = spark.createDataFrame([], "failed boolean, gt_horizon boolean, pred_horizon boolean, gt struct<vx:double,vy:double,x0:double,y0:double>, pred struct<vx:double,vy:double,x0:double,y0:double>, height double, latency_ms double")
    r = evaluation.summary(evaluation.scored(df)).first()
    assert r.total == 0 and r.speed_verdict == "WARN" and r.accuracy_verdict == "FAIL" and r.angle_mean is None


def test_permutation_split(spark):
    labels = spark.createDataFrame([(f"f{k:03d}", "a" if k < 9 else "b") for k in range(10)], "filename string, stratum string")
    got = evaluation.permutation_split(labels, 42).groupBy("stratum", "split").count().collect()
    assert {(r.stratum, r.split): r["count"] for r in got} == {("a", "test"): 2, ("a", "train"): 7, ("b", "train"): 1}


def test_label_readers(spark, tmp_path):
    p = tmp_path / "label.csv"
    p.write_text("filename,has_horizon,slope,offset\na.jpg, TRUE ,0.5,0.2\nb.jpg,false,,\nc.jpg,true,x,0.1\na.jpg,true,0.7,0.3\n")
    got = {r.filename: r for r in tables.tolerant_labels(spark, str(p)).collect()}
    assert got["c.jpg"].slope is None and got["b.jpg"].has_horizon is False
    assert tables.line_labels(spark, str(p)).count() == 2
    q = tmp_path / "three.csv"
    q.write_text("filename,slope,offset\na.jpg,0.5,0.2\na.jpg,0.7,0.3\n")
    assert [r.has_horizon for r in tables.labels(spark, str(q)).collect()] == [True, True]
    assert [r.slope for r in tables.keyed_labels(spark, str(q)).collect()] == [0.7]


def test_markdown_section_replaces_the_old_one():
    text = tables.markdown_section("# Run\n\n## Split\n\nold\n", "## Split", "new")
    assert text == "# Run\n\n## Split\n\nnew\n"


def test_stream_in_event_time(spark, tmp_path):
    from levelframe.streaming.temporal import carried_in_time

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = np.random.default_rng(8)
    rows = [(f"c{k % 2}", 1_700_000_000 + k, k, [float(rng.integers(0, 40))], [(source, float(3 * rng.random()), 1.0, float(rng.normal() / 4), 0.0, float(rng.integers(0, 24)), int(rng.integers(1, 9))) for source in ("L", "sky")[: rng.integers(0, 3)]]) for k in range(60)]
    kind = "clip string, t long, seq long, thumb array<double>, candidates array<struct<source:string,raw:double,vx:double,vy:double,x0:double,y0:double,count:int>>"
    shuffled = [rows[i] for i in sorted(range(60), key=lambda i: i + rng.uniform(0, 8))]  # up to eight seconds out of order
    batches_ = [shuffled[k : k + 15] for k in range(0, 60, 15)] + [[("c0", 1_700_000_005, 5, [1.0], [])], [("z", 1_700_001_000, 0, [1.0], [])], [("z", 1_700_002_000, 1, [1.0], [])]]
    folder = tmp_path / "in"
    folder.mkdir()
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(folder)).withColumn("time", F.timestamp_seconds("t"))
    q = carried_in_time(source, "time", "10 seconds", 24.0, 24.0, 0.3).writeStream.format("memory").queryName("in_time").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for k, b in enumerate(batches_):
            spark.createDataFrame(b, kind).coalesce(1).write.mode("append").parquet(str(folder))
            q.processAllAvailable()
    finally:
        q.stop()
    stream = {(r.clip, r.seq): (r.scene, r.score) for r in spark.table("in_time").collect() if r.clip != "z"}
    flat = spark.createDataFrame(rows, kind)
    pool = F.transform("candidates", lambda c, k: F.struct(c["source"].alias("source"), (k + 1).cast("int").alias("place"), c["raw"].alias("raw"), F.struct(c["vx"].alias("vx"), c["vy"].alias("vy"), c["x0"].alias("x0"), c["y0"].alias("y0")).alias("line"), c["count"].alias("count")))
    scened = temporal.scenes(flat.withColumn("candidates", pool), ["seq"], clip=["clip"])
    batch = {(r.clip, r.seq): (r.scene, r.result and r.result.raw) for r in temporal.fold(scened, ["clip", "scene"], "seq", 24, 24, 0.3).collect()}
    assert stream == batch and len(batch) == 60  # the repeated late row of seq 5 changed nothing
