"""Command line: python -m levelframe evaluate DETECTOR FOLDER, or split FOLDER."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from levelframe.functions import grading
from levelframe.operators import evaluation, regions
from levelframe.plans import dataset_evaluation
from levelframe.plans.detectors import Shape
from levelframe.sources import tables


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Runs a detector over a dataset folder, writes its document and prints the report."""
    shape = Shape(a.height, a.width, thumb=regions.CANDIDATE_SIZE)
    rows, doc = dataset_evaluation.evaluate(spark, a.folder, a.detector, shape, a.limit, a.seed)
    rows, doc = rows.cache(), doc.cache()
    for r in [*tables.summary_text(doc.select("summary.*")).collect(), *tables.worst_text(rows).orderBy("place").collect()]:
        print(r.report)
    print(tables.document_file(doc, a.out or a.folder, a.folder.rstrip("/").rpartition("/")[2]))


def split(spark: SparkSession, a: argparse.Namespace) -> None:
    """Splits a dataset's labels by strata with a seed, and prints how many of each are where."""
    rows = tables.horizon_labels(spark, f"{a.folder.rstrip('/')}/label.csv")
    angle, offset = grading.angle_bin(F.col("slope")), grading.offset_bin(F.col("offset"))
    out = evaluation.permutation_split(rows.withColumn("stratum", F.concat_ws("_", angle, offset)), a.seed)
    for r in out.groupBy("stratum", "split").count().orderBy("stratum", "split").collect():  # nine strata
        print(r.stratum, r.split, r["count"])


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="levelframe", description=__doc__)
    kinds = p.add_subparsers(required=True)
    e = kinds.add_parser("evaluate")
    e.add_argument("detector", choices=sorted(dataset_evaluation.known()))
    e.add_argument("folder")
    for name, default in (("height", 480), ("width", 480), ("limit", None), ("seed", None)):
        e.add_argument(f"--{name}", type=int, default=default)
    e.add_argument("--out")
    e.set_defaults(run=evaluate)
    s = kinds.add_parser("split")
    s.add_argument("folder")
    s.add_argument("--seed", type=int, default=42)
    s.set_defaults(run=split)
    a = p.parse_args(argv)
    a.run(SparkSession.builder.appName("levelframe").getOrCreate(), a)


if __name__ == "__main__":
    main()
