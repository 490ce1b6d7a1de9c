"""A corpus pipeline: language, near-duplicates, benchmark passages, source mix, shards.

Every stage is a function of (spark, docs, sf_dir) and returns a DataFrame. run() writes each stage's rows as Parquet
in the folder that all executors share and reads them back as the next stage's documents.

Nulls and edge cases: a null or empty text has no language and goes in the first stage, so that later ones hold texts
only, though each takes such rows by its own; a null source is a source of its own; texts of any length are read whole;
repeated rows and copies are near duplicates of each other, of which one stays, the smallest doc_id; ties between shards
go by hash; an empty table, or one of which a stage keeps nothing, gives an empty result; extra columns pass through all
stages, and those named as one that the last stage adds give way to it. Stage tables stay until the folder is cleared.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from levelframe.llm import decontaminate, language_id, mixing, near_dedup, sharding
from levelframe.session import table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows and is sure of."""
    return language_id.accepted(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.deduplicated(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_of(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its place there."""
    return sharding.assigned(docs, docs.columns)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Trained weights, hash order and label propagation are not SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def _shared_folder(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="levelframe-")
    return f"{where.rstrip('/')}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), _shared_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
