"""Frames of real size whose planes are made in the kernels, and the kernels on bytes against plain forms."""

import time
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from levelframe.operators import batches, fits, regions
from levelframe.plans import detector_queries, detectors
from levelframe.sources import frames

STACK = detectors.STACK


def plain(k, vector, height, width):
    """The frame of a vector, place by place."""
    y, x = np.mgrid[:height, :width]
    tile = np.nan_to_num(np.asarray(vector, np.float32).astype(np.float64)).reshape(8, 8)
    coarse = np.kron(tile, np.ones((-(-height // 8), -(-width // 8))))[:height, :width]
    fine = np.tile(tile, (-(-height // 8), -(-width // 8)))[:height, :width]
    up = (y < (k * 37 % 101 - 50) / 100 * x + (0.3 + k * 17 % 41 / 100) * height)[:, :, None]
    colours = np.where(up, np.array([225.0, 180.0, 140.0]) + (40 * coarse + 60 * fine)[:, :, None], np.array([50.0, 95.0, 80.0]) + (40 * coarse + 260 * fine)[:, :, None])
    return frames.planes_of(np.clip(colours, 0, 255).astype(np.uint8))


def vector_of(seed):
    return np.random.default_rng(seed).normal(0, 0.12, 64).astype(np.float32)


# F1


@pytest.mark.parametrize("size", [(480, 480), (50, 37), (9, 8)])
def test_made_planes_equal_plain_ones(size):
    odd = vector_of(3)
    odd[[0, 9, 40]] = np.nan, np.inf, -np.inf
    make = frames.made_planes(*size, ("img", "raw", *STACK))
    for k, vector in ((0, vector_of(0)), (77, vector_of(1)), (-5, vector_of(2)), (12, odd)):
        want = plain(k, vector, *size)
        for name, plane in zip(("light", "b", *STACK), make(k, vector), strict=True):
            assert plane.dtype == np.uint8 and (plane.reshape(size) == want[name]).all()
    assert make(None, vector_of(0)) == make(3, None) == [None] * 7
    began = time.perf_counter()
    for k in range(10):
        make(k, vector_of(k))
    assert size[0] < 100 or (time.perf_counter() - began) / 10 < 0.02  # 4 ms on an idle core; place by place 40


@pytest.mark.parametrize("name", ["a1", "a2", "a4", "a6", "a7", "a10"])
def test_made_planes_give_what_rows_of_planes_give(spark, name):
    rows = [(k, vector_of(k).tolist()) for k in range(4)] + [(None, vector_of(9).tolist()), (5, None), (6, [0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    clip = F.floor(F.col("frame_id") / 50)
    s = detector_queries.FULL
    made = {r.frame_id: r for r in detectors.REGISTRY[name][0](frames.made_vectors(vectors).withColumn("clip", clip), s).collect()}
    given = {r.frame_id: r for r in detectors.REGISTRY[name][0](frames.made_frames(vectors).withColumn("clip", clip), replace(s, source=None)).collect()}
    assert set(made) == set(given) == {0, 1, 2, 3}
    for k, r in made.items():
        assert r[:2] + r[3:5] == given[k][:2] + given[k][3:5] and np.allclose(r.line, given[k].line, rtol=0, atol=1e-9) and r.latency_ms > 0


def test_full_queries_carry_no_planes(spark):
    df = detector_queries.full_frames(spark, "/root/testdata/sf0.001")
    assert set(df.columns) == {"frame_id", "embedding", "clip"}
    assert df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_results_leave_a_kernel_in_small_parts():
    """A batch of many rows that are made into large results does not gather them all."""
    from unittest import mock

    with mock.patch.object(batches.F, "arrow_udf", lambda kind: lambda f: lambda rows: f):
        source = batches.Planes((F.lit(1),), lambda k: [np.full(9, k)])
        of = batches.clocked("array<int>", pa.list_(pa.int64()), lambda a: a, source)
    rows = pa.StructArray.from_arrays([pa.array(range(100))], ["c0"])
    parts = list(of(iter([rows, rows[:0]])))
    assert max(map(len, parts)) <= batches.AT_ONCE
    assert [r["value"][0] for p in parts for r in p.to_pylist()] == list(range(100))


def test_refits_side_by_side():
    rng = np.random.default_rng(1)
    for n in (2, 3, 60, 400):
        x = rng.uniform(0, 480, n)
        y = 0.3 * x + rng.normal(0, 3, n)
        rows = [np.sort(rng.choice(n, max(2, int(n * q)), replace=False)) for q in (1, 0.5, 0.2, 0.9)]
        for at, got in zip(rows, fits.hubers_of(x, y, fits._lit(rows, n)), strict=True):
            assert np.allclose(list(got.values()), list(fits.huber_of(x[at], y[at]).values()), rtol=0, atol=1e-9)
    assert fits.hubers_of(x, y, fits._lit([], n)) == []


# F2


def test_clusters_in_one_kernel(spark):
    rng = np.random.default_rng(4)
    rows = [(0, [])]
    for k, n in enumerate((1, 2, 30, 120, 90), start=1):
        x, which = rng.uniform(0, 100, n), rng.integers(0, 3, n)
        rows.append((k, list(zip(x.tolist(), (20 + 30 * which + (0.1 * which - 0.1) * x + rng.normal(0, 0.6, n)).tolist(), strict=True))))
    df = spark.createDataFrame([*rows, (9, None)], "k int, p array<struct<x:double,y:double>>")
    search = {"near": 1.5, "k": 8, "iterations": 200, "seed": 3}
    both = df.select("k", batches.clusters(F.col("p"), **search)["value"].alias("got"), batches.clusters(F.col("p"), most=1, **search)["value"].alias("first"), fits.merged(batches.search(F.col("p"), **search)["value"], F.col("p")).alias("want"))
    several = 0
    for r in both.collect():
        want = r.want or []
        several += len(want) > 1
        assert [(c.cluster, c.n, c.confidence) for c in r.got] == [(c.cluster, c.n, c.confidence) for c in want]
        assert all(np.allclose(c.line, d.line, rtol=0, atol=1e-7) for c, d in zip(r.got, want, strict=True)) and r.first == r.got[:1]
    assert several


# F3


@pytest.mark.parametrize("name", ["a7", "a8"])
def test_pools_of_pairs_read_three_planes(spark, name):
    """Saturation and excess of blue are for path and sky candidates; without those they need not be there."""
    make = frames.made_planes(120, 120, STACK)
    rows = [(k, *(p.astype(int).tolist() for p in make(k, vector_of(k)))) for k in range(3)]
    df = spark.createDataFrame(rows, "frame_id long, " + ", ".join(f"{c} array<int>" for c in STACK)).withColumn("clip", F.lit(0))
    s = detectors.Shape(120, 120, clip=("clip",), thumb=regions.CANDIDATE_SIZE)
    whole, three = ({r.frame_id: r[:5] for r in detectors.REGISTRY[name][0](d, s).collect()} for d in (df, df.drop(*STACK[3:])))
    assert whole == three and all(r[1] == "line" for r in whole.values())


def test_pools_of_pairs_make_three_planes(spark):
    asked = []
    source = (("frame_id", "embedding"), lambda h, w, names: asked.append(names) or frames.made_planes(h, w, names))
    df = spark.createDataFrame([(1, vector_of(1).tolist(), 0)], "frame_id long, embedding array<float>, clip long")
    detectors.a7(df, replace(detector_queries.FULL, source=source))
    assert asked == [STACK[:3]]


# F4


def test_masks_of_bytes_equal_plain_ones():
    rng = np.random.default_rng(5)
    for h, w in ((30, 41), (41, 30), (12, 9), (480, 480)):
        wave = 110 + 60 * np.sin(np.arange(w) / 9) + 70 * (np.arange(h)[:, None] > h // 2)
        for img in (np.clip(wave + rng.normal(0, 40, (h, w)), 0, 255), np.full((h, w), 7.0), np.where(rng.random((h, w)) < 0.5, 0.0, 255.0)):
            img = img.astype(np.uint8)
            taps, r = (1, 4, 6, 4, 1), 2
            p = np.pad(img.astype(int), r, mode="reflect")
            p = sum(t * p[:, k : k + w] for k, t in enumerate(taps))
            smooth = (sum(t * p[k : k + h] for k, t in enumerate(taps)) + 128) >> 8
            mask = np.where(smooth > batches._otsu(smooth), 255, 0).astype(np.uint8)
            closed = regions.extreme(regions.extreme(mask, 9, np.maximum, 0), 9, np.minimum, 255)
            opened = regions.extreme(regions.extreme(closed, 9, np.minimum, 255), 9, np.maximum, 0)
            assert (batches.mask_of(img, 9, False) == closed).all() and (batches.mask_of(img, 9, True) == opened).all()
            assert (batches.mask_of(img.astype(np.int32), 9, True) == opened).all()
    more = np.where(np.arange(20)[:, None] < 8, 1000, 300) + np.zeros((20, 20), np.int32)  # than bytes
    assert (batches.mask_of(more, 3, True) == np.where(np.arange(20)[:, None] < 8, 255, 0)).all()
    began = time.perf_counter()
    for _ in range(10):
        batches.mask_of(img, 9, True)
    assert (time.perf_counter() - began) / 10 < 0.02  # 2 ms on an idle core


# F5


def test_only_the_planes_asked_for_are_made(spark):
    bgr = np.random.default_rng(6).integers(0, 256, (40, 50, 3)).astype(np.uint8)
    whole = frames.planes_of(bgr)
    assert set(whole) == set(frames.PLANES)
    for names in (("light",), ("a", "b"), ("gray", "saturation"), ("blue_excess",)):
        some = frames.planes_of(bgr, names)
        assert set(some) == set(names) and all((some[c] == whole[c]).all() for c in names)
    asked = []
    source = (("frame_id", "embedding"), lambda h, w, names: asked.append(names) or frames.made_planes(h, w, names))
    df = spark.createDataFrame([(1, vector_of(1).tolist(), 0)], "frame_id long, embedding array<float>, clip long")
    for pipeline in (detectors.a1, detectors.a2, detectors.a4):
        pipeline(df, replace(detector_queries.FULL, source=source))
    assert asked == [("img",)] * 3
