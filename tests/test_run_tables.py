"""Splits, ordered places, sketches, and the readers and writers of runs."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F


from levelframe.operators import evaluation, ordering
from levelframe.plans import registry
from levelframe.sources import tables
from tests.test_dataset import png


def test_published_split(spark):
    golden = spark.read.option("header", True).csv(str(Path(__file__).parent / "split_golden.csv"))
    got = evaluation.permutation_split(golden.drop("split"), 42)
    assert {(r.filename, r.split) for r in got.collect()} == {(r.filename, r.split) for r in golden.collect()}
    assert got.filter("split = 'test'").count() == 24 and got.count() == 110


def test_places_and_split_of_a_hot_stratum(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if k % 3 else f"s{k % 30}" if k % 2 else None, int(v)) for k, v in enumerate(rng.permutation(900))] + [("one", 0), ("two", 0), ("two", 1)]
    df = spark.createDataFrame(rows, "stratum string, k long").repartition(4)
    places = ordering.placed(df, ["stratum"], ["k"])
    want = {}
    for s in {s for s, _ in rows}:
        own = sorted(k for t, k in rows if t == s)
        want |= {(s, k): (i + 1, len(own)) for i, k in enumerate(own)}
    assert {(r.stratum, r.k): (r.place, r["__n"]) for r in places.collect()} == want
    split = {(r.stratum, r.k): r.split for r in evaluation.stratified_split(df, F.col("stratum"), F.col("k")).collect()}
    assert split == {sk: "test" if n > 1 and place <= max(1, math.ceil(0.2 * n)) else "train" for sk, (place, n) in want.items()}
    assert ordering.placed(df.filter("k < 0"), ["stratum"], ["k"]).collect() == []


def run_rows(spark):
    schema = "filename string, angle double, rho_norm double, iou double, run string"
    rows = [(f"f{k}", None if k % 4 == 0 else k * 1.5 % 13, None if k % 4 == 0 else k % 10 / 100, None if k % 3 else 0.5, "a" if k < 30 else "b" if k < 60 else "none") for k in range(60)]
    return spark.createDataFrame([*rows, ("x", None, None, None, "none")], schema)


def test_sweep_and_worst_without_errors(spark):
    df = run_rows(spark)
    got = {(r.run, r.deg, r.norm): r.precision for r in evaluation.precision_sweep(df, ["run"]).collect()}
    own = [r for r in df.collect() if r.angle is not None]
    assert len(got) == 16 and all(np.isclose(p, np.mean([r.angle <= a and r.rho_norm <= n for r in own if r.run == run])) for (run, a, n), p in got.items())
    assert evaluation.precision_sweep(df.filter("angle IS NULL"), []).collect() == []
    worst = evaluation.worst(df, "angle", 5, ["filename"]).collect()
    assert [r.filename for r in worst] == [r.filename for r in sorted(own, key=lambda r: (-r.angle, r.filename))[:5]]
    assert evaluation.worst(df.filter("run = 'none'"), "angle").collect() == []


def test_sketches_state_their_rank_error(spark):
    df = spark.range(20_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003))).cast("double").alias("v"))
    values = np.sort([r.v for r in df.collect()])
    r = df.agg(*evaluation.stats("v", accuracy=500)).first()
    for q, p in ((r.v_median, 0.5), (r.v_p90, 0.9)):
        assert abs(np.searchsorted(values, q, "right") / len(values) - p) <= 1 / 500 + 1e-9
    assert r.v_worst == values[-1] and np.isclose(r.v_mean, values.mean())
    none = df.filter("v < 0").agg(*evaluation.stats("v", accuracy=500)).first()
    assert none.v_median is None and none.v_worst is None


def test_sketched_ranks_of_many_sizes_and_nulls(spark, tmp_path):
    sizes = [1, 2, 9, 499, 500, 999, 1000, 1001, 1499, 1982, *range(1501, 3000, 83), 5003]
    rows = spark.createDataFrame([(f"t{n}", n) for n in sizes], "event_type string, n int").select("event_type", F.explode(F.sequence(F.lit(1), "n")).alias("k"))
    rows = rows.withColumn("value", (F.pmod(F.xxhash64("event_type", "k"), F.lit(100_003)) / 100).cast("double")).drop("k")
    part = rows.filter("event_type IN ('t1982', 't999')")
    nulls = part.select("event_type", F.lit(None).cast("double").alias("value")).unionByName(part.select(F.lit(None).cast("string").alias("event_type"), "value"))
    nulls = nulls.unionByName(part.select(F.lit("empty").alias("event_type"), F.lit(None).cast("double").alias("value")))
    for name, df in (("one", rows.coalesce(1)), ("three", rows.unionByName(nulls).repartition(3))):
        (tmp_path / name).mkdir()
        df.write.parquet(str(tmp_path / name / "events.parquet"))
        own = {tuple(r) for r in registry.queries()["sketched_stats"](spark, str(tmp_path / name)).collect()}
        sql = registry.oracle_sql()["sketched_stats"].replace("FROM events", f"FROM '{tmp_path / name}/events.parquet/*.parquet'")
        want = duckdb.sql(sql).fetchall()
        assert {(*t[:4], *(v if v is None else round(v, 4) for v in t[4:])) for t in own} == {(*t[:4], *(v if v is None else round(v, 4) for v in t[4:])) for t in want}
        assert len(own) == len(want) == len(sizes) + (2 if name == "three" else 0)


LABELS = "filename,has_horizon,slope,offset\nb.jpg,true,0.25,0.5\nc.jpg,false,,\n"
NEW = "filename string, has_horizon boolean, slope double, offset double"


def test_upsert_replaces_the_file_at_once(spark, tmp_path, monkeypatch):
    path = tmp_path / "label.csv"
    new = spark.createDataFrame([("c.jpg", True, -0.5, 0.125), ("a.jpg", False, 0.5, 0.5)], NEW)
    tables.upsert_label_file(spark, str(path), new.filter("has_horizon"))
    assert path.read_text() == "filename,has_horizon,slope,offset\nc.jpg,true,-0.5,0.125\n"
    path.write_text(LABELS)
    tables.upsert_label_file(spark, str(path), new)
    want = "filename,has_horizon,slope,offset\na.jpg,false,,\nb.jpg,true,0.25,0.5\nc.jpg,true,-0.5,0.125\n"
    assert path.read_text() == want
    assert {r.filename: r.slope for r in tables.labels(spark, str(path)).collect()} == {"a.jpg": None, "b.jpg": 0.25, "c.jpg": -0.5}
    # a write that fails half way leaves the old file and nothing beside it
    fails = F.udf(lambda v: 1 / 0, "double")
    with pytest.raises(Exception, match="ZeroDivision"):
        tables.upsert_label_file(spark, str(path), new.withColumn("slope", fails("slope")))
    assert path.read_text() == want and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["label.csv"]


def test_readers_of_labels_and_manifest(spark, tmp_path):
    (tmp_path / "l.csv").write_text("filename,has_horizon,slope,offset\na.jpg,true,0.5,0.25\nb.jpg,false,,\nc.jpg, true,1,1\n")
    assert [tuple(r) for r in tables.horizon_labels(spark, str(tmp_path / "l.csv")).collect()] == [("a.jpg", 0.5, 0.25)]
    (tmp_path / "m.csv").write_text("filename,source_clip,t_in_clip_s,t_in_source_s,source_video_url\na.jpg,one,0.5,92.5,http://x\n")
    assert tuple(tables.manifest(spark, str(tmp_path / "m.csv")).first()) == ("a.jpg", "one", 0.5, 92.5, "http://x")


def test_readers_of_folders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "note.txt").write_text("no image")
    for name in ("f10.png", "f9.png", "F1.png"):
        (tmp_path / "in" / name).write_bytes(png(np.full((2, 3), 9, np.uint8)))
    assert [r.filename for r in tables.image_names(spark, str(tmp_path / "in")).collect()] == ["F1.png", "f9.png", "f10.png"]
    assert [r.filename for r in tables.image_names(spark, str(tmp_path / "in"), natural=False).collect()] == ["F1.png", "f10.png", "f9.png"]
    got = {r.stem: bytes(r.mask) for r in tables.masks(spark, str(tmp_path / "in")).collect()}
    assert set(got) == {"f10", "f9", "F1"} and got["f9"] == bytes([9] * 6)


def test_results_newest_and_missing_attempts(spark, tmp_path):
    import os

    for k, (folder, rate) in enumerate([("attempt-1-a", 0.5), ("attempt-1-a", 0.75), ("attempt-12-b", 0.9)]):
        (tmp_path / folder).mkdir(exist_ok=True)
        f = tmp_path / folder / f"full-{k}.json"
        f.write_text('{\n"attempt": "x",\n"rate": %s\n}' % rate)
        os.utime(f, (1_700_000_000 + 60 * k,) * 2)
    found = tables.results(spark, f"{tmp_path}/*/full-*.json")
    assert {r.number: r.rate for r in found.collect()} == {1: 0.75, 12: 0.9}
    assert {r.number: r.rate for r in tables.attempts(found, [1, 2, 12]).collect()} == {1: 0.75, 2: None, 12: 0.9}


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("b.jpg", "test", "flat", "low", "flat_low", 1.23456, 2.0, 0.0123456, None, 3.14159, False), ("a.jpg", "train", "flat", "low", "flat_low", None, None, None, 0.5, None, True)], "filename string, split string, angle_bin string, offset_bin string, stratum string, delta_theta_deg double, delta_rho_px double, delta_rho_norm double, iou double, latency_ms double, failed boolean")
    tables.split_csv(rows, str(tmp_path / "split"))
    text = next((tmp_path / "split").glob("part-*")).read_text().splitlines()
    assert text[1].startswith("a.jpg,train,flat,low,flat_low,") and text[1].endswith(",0.5000,,1") and text[2] == 'b.jpg,test,flat,low,flat_low,1.2346,2.0000,0.012346,,3.142,0'
    lines = [r.report for r in tables.worst_text(run_rows(spark), 3).orderBy("place").collect()]
    assert len(lines) == 3 and lines[0].startswith("f17  12.50 deg  0.0700 H")
    one = spark.createDataFrame([("PASS", 0.975, "FAIL", 70.25)], "accuracy_verdict string, pass_rate double, speed_verdict string, latency_ok_mean double")
    assert tables.summary_text(one).first().report == "accuracy PASS  97.50%  speed FAIL  70.25 ms"
    tables.summary_json(one, str(tmp_path / "doc"))
    assert spark.read.json(str(tmp_path / "doc")).first().pass_rate == 0.975


def test_results_by_dataset_and_pass_rates(spark, tmp_path):
    for k, (n, data, rate) in enumerate([(1, "/d/uav/images", 0.5), (1, "/d/fpv", 0.25), (3, "/d/uav", 0.75)]):
        (tmp_path / f"attempt-{n}-x").mkdir(exist_ok=True)
        (tmp_path / f"attempt-{n}-x" / f"r{k}.json").write_text('{"dataset_dir": "%s", "summary": {"accuracy": {"pass_rate": %s}}}' % (data, rate))
    rates = tables.pass_rates(tables.results(spark, f"{tmp_path}/*/*.json", by_dataset=True), ["uav", "fpv"], [1, 2, 3])
    assert {(r.number, r.uav, r.fpv) for r in rates.collect()} == {(1, 0.5, 0.25), (2, None, None), (3, 0.75, None)}


def test_document_file_and_empty_folder(spark, tmp_path):
    doc = spark.createDataFrame([("a1", None, (3, 0.5))], "attempt string, seed long, summary struct<total:int,pass_rate:double>")
    path = tables.document_file(doc, str(tmp_path), "my set!")
    assert path.endswith("/full-eval-results-my_set_.json")
    import json

    text = Path(path).read_text()
    assert json.loads(text) == {"attempt": "a1", "seed": None, "summary": {"total": 3, "pass_rate": 0.5}} and '\n  "summary"' in text
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.txt").write_text("x")
    with pytest.raises(ValueError, match="no images"):
        tables.image_names(spark, str(tmp_path / "empty"))


def test_command_line(spark, tmp_path, capsys):
    from levelframe.__main__ import main

    (tmp_path / "images").mkdir()
    lines = ["filename,has_horizon,slope,offset"]
    for k in range(6):
        y = np.mgrid[:48, :64][0]
        (tmp_path / "images" / f"f{k}.png").write_bytes(png(np.where((y < 20 + k)[:, :, None], np.array([150, 190, 240]), np.array([60, 80, 40])).astype(np.uint8)))
        lines.append(f"f{k}.png,true,0,{(20 + k) / 48}")
    (tmp_path / "label.csv").write_text("\n".join(lines) + "\n")
    main(["evaluate", "a2", str(tmp_path), "--height", "48", "--width", "64", "--limit", "4"])
    out = capsys.readouterr().out.splitlines()
    assert out[0].startswith("accuracy PASS  100.00%  speed PASS") and len(out) == 6 and Path(out[-1]).exists()
    main(["split", str(tmp_path)])
    assert sum(int(line.split()[-1]) for line in capsys.readouterr().out.splitlines()) == 6


def test_natural_order_of_long_digits(spark):
    from levelframe.functions import grading

    names = ["f2", "f10", "f" + "9" * 30, "f1" + "0" * 30, "F3", "f010a", "g"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(grading.natural_key(F.col("n")), "n").collect()] == ["f2", "F3", "f10", "f010a", "f" + "9" * 30, "f1" + "0" * 30, "g"]


def test_row_energy_peak_of_fifteen_rows(spark):
    from levelframe.operators import batches, raster

    rng = np.random.default_rng(7)
    rows = [(k, np.clip(rng.normal(100, 20, (40, 6)) + 90 * (np.arange(40)[:, None] > 6 * k + 4), 0, 255).astype(int).ravel().tolist()) for k in range(5)]
    df = spark.createDataFrame(rows, "k int, img array<int>")
    for r in df.select("k", "img", raster.row_energy_peak(F.col("img"), 40, 6).alias("a"), batches.row_energy_peak(F.col("img"), 40, 6)["value"].alias("b")).collect():
        a = np.pad(np.array(r.img).reshape(40, 6), 1, mode="reflect")
        across = a[:, :-2] + 2 * a[:, 1:-1] + a[:, 2:]
        energy = np.abs(across[2:] - across[:-2]).mean(axis=1)
        want = np.round([energy[max(y - 7, 0) : y + 8].sum() for y in range(40)], 6).argmax()
        assert r.a == r.b == want
