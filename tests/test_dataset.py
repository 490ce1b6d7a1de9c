"""Images to frames, and the evaluation of a detector over a folder of labelled images."""

import struct
import zlib

import numpy as np
import pytest

from levelframe.plans import dataset_evaluation as de
from levelframe.plans.detectors import Shape
from levelframe.sources import frames, tables


def png(pixels: np.ndarray) -> bytes:
    """A PNG of height x width x 3 (red, green, blue) or height x width bytes."""
    h, w = pixels.shape[:2]
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + pixels[k].tobytes() for k in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("dataset")
    (top / "images").mkdir()
    (top / "masks" / "sky").mkdir(parents=True)
    lines = ["filename,has_horizon,slope,offset"]
    for k, (slope, offset) in enumerate([(0.0, 0.5), (0.2, 0.3), (-0.3, 0.6)]):
        y, x = np.mgrid[:40, :60]
        sky = y < slope * x + offset * 40
        image = np.where(sky[:, :, None], np.array([150, 190, 240]), np.array([60, 80, 40])).astype(np.uint8)
        (top / "images" / f"f{k}.png").write_bytes(png(image))
        (top / "masks" / "sky" / f"f{k}.png").write_bytes(png(np.where(sky, 255, 0).astype(np.uint8)))
        lines.append(f"f{k}.png,true,{slope},{offset}")
    (top / "images" / "flat.png").write_bytes(png(np.full((40, 60, 3), 90, np.uint8)))
    (top / "images" / "unlabelled.png").write_bytes(png(np.full((40, 60, 3), 90, np.uint8)))
    (top / "label.csv").write_text("\n".join([*lines, "flat.png,false,,", "gone.png,true,0,0.5"]) + "\n")
    return str(top)


def test_planes_of_known_colours(spark, folder):
    row = {r.filename: r for r in frames.decoded(tables.images(spark, f"{folder}/images")).collect()}["flat.png"]
    assert (row.height, row.width, len(row.gray)) == (40, 60, 2400)
    assert {row.gray[0], row.saturation[7], row.a[3], row.b[3], row.blue_excess[5]} == {90, 0, 128} and row.light[0] == 98
    red = frames.planes_of(np.array([[[0, 0, 255]]], np.uint8))
    assert [int(red[k][0, 0]) for k in ("gray", "light", "a", "b", "saturation", "blue_excess")] == [76, 136, 208, 195, 255, 0]


def test_area_resize_by_any_ratio():
    plane = np.arange(48.0).reshape(6, 8)
    assert np.allclose(frames.area_resized(plane, 3, 4), plane.reshape(3, 2, 4, 2).mean(axis=(1, 3)))
    odd = frames.area_resized(np.array([[0.0, 3.0, 6.0]]), 1, 2)
    assert np.allclose(odd, [[1.0, 5.0]]) and np.isclose(frames.area_resized(plane, 4, 5).mean(), plane.mean())


@pytest.mark.parametrize("detector", ["a1", "a2", "a4", "a7", "a9", "a10", de.sky_by_rows])
def test_evaluation_of_a_folder(spark, folder, detector):
    rows, doc = de.evaluate(spark, folder, detector, Shape(40, 60))
    got = {r.filename: r for r in rows.collect()}
    assert set(got) == {"f0.png", "f1.png", "f2.png", "flat.png"}
    for k in range(3):
        r = got[f"f{k}.png"]
        assert r.status == "line" and r.angle < 2 and r.rho_norm < 0.05 and r.passed and r.iou > 0.9
    assert got["flat.png"].iou is None and not got["flat.png"].gt_horizon
    assert all(r.latency_ms > 0 for r in got.values())
    d = doc.first()
    assert d.summary.total == 4 and d.summary.line_scored == 3 and d.dataset_dir == folder and len(d.summary.worst_frames_by_angle) == 3
    assert d.summary.speed_verdict == "PASS"
    if callable(detector) or detector in ("a7", "a9", "a10"):
        assert d.summary.tn == 1 and d.summary.passed_count == 4


def test_limit_comes_before_the_images(spark, folder):
    rows, doc = de.evaluate(spark, folder, de.sky_by_rows, Shape(20, 30), limit=2, seed=7)
    assert {r.filename for r in rows.collect()} == {"f0.png", "f1.png"}
    assert (doc.first()["limit"], doc.first()["seed"]) == (2, 7)
    files = {f.rpartition("/")[2] for f in rows.inputFiles()}
    assert files == {"label.csv", "f0.png", "f1.png"}  # both images and their masks, nothing else


def test_names_choose_the_files(spark, tmp_path):
    picture = png(np.full((4, 5), 7, np.uint8))
    for name in ("a[1].png", "a1.png", "b,c.png", "b.png", "c{d}.png", "e.x.png", "e.png"):
        (tmp_path / name).write_bytes(picture)
    read = lambda names: {r.filename for r in tables.images(spark, str(tmp_path), names).collect()}
    assert read(["a[1].png", "b,c.png", "c{d}.png", "gone.png"]) == {"a[1].png", "b,c.png", "c{d}.png"}
    assert read(["a1."]) == {"a1.png"} and read(["e.x."]) == {"e.x.png"}


def test_seed_reaches_the_search(spark, folder):
    found = [{r.filename: r.line for r in de.evaluate(spark, folder, "a4", Shape(40, 60, max_points=60, iterations=3), seed=k)[0].collect()} for k in (1, 1, 2)]
    assert found[0] == found[1] != found[2]


def test_missing_images_and_added_detectors(spark, folder):
    gone = frames.missing_images(tables.labels(spark, f"{folder}/label.csv"), tables.image_names(spark, f"{folder}/images"))
    assert [r.filename for r in gone.collect()] == ["gone.png"]
    de.add("rows", de.per_frame(de.sky_by_rows), seeded=True)
    assert de.known()["rows"][1] and de.known()["a10"][1] and not de.known()["a1"][1]
    with pytest.raises(ValueError):
        de.add("a1", de.sky_by_rows)


def test_annotated_frames(spark, folder, tmp_path):
    from pyspark.sql import functions as F

    from levelframe.sources import annotations

    images = tables.images(spark, f"{folder}/images").withColumn("ln", F.when(F.col("filename") != "flat.png", F.expr("named_struct('vx', 1D, 'vy', 0.5D, 'x0', 10D, 'y0', 12D)")))
    level = F.expr("named_struct('vx', -2D, 'vy', 0D, 'x0', 4D, 'y0', 30D)")
    both = F.array(annotations.drawn(F.col("ln"), (255, 0, 9), 3.0), annotations.drawn(level, (1, 2, 3), 1.0, 6.0, 4.0))
    before = {r.filename: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) for r in images.collect()}
    for r in annotations.annotated(images, both).collect():
        (tmp_path / r.filename).write_bytes(r.png)
    after = {r.filename: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) for r in tables.images(spark, str(tmp_path)).collect()}
    assert set(after) == set(before)
    for name, old in before.items():
        want = old.copy()
        for y in range(40):
            for x in range(60):
                if name != "flat.png" and abs((x - 10) - 2 * (y - 12)) / 5**0.5 <= 1.5:
                    want[y, x] = 9, 0, 255
                if y == 30 and (4 - x) % 10 < 6:
                    want[y, x] = 3, 2, 1
        assert (after[name] == want).all() and (want != old).any()
