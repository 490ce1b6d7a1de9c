"""Readers of labels, manifests, images and results, adapters of plain tables, and writers of reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from levelframe.functions import grading
from levelframe.operators import evaluation

IMAGE_SUFFIX = r"(?i)\.(jpg|jpeg|png|bmp|tif|tiff)$"
LABEL_SUFFIX = r"(?i)\.(jpg|jpeg|png)$"
LABELS = "filename string, has_horizon string, slope string, offset string"


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def _flag(df: DataFrame, strip: bool = True) -> Column:
    """Three-column files have a horizon on every frame."""
    if "has_horizon" not in df.columns:
        return F.lit(True)
    text = F.trim("has_horizon") if strip else F.col("has_horizon")
    return F.coalesce(F.lower(text) == "true", F.lit(False))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """filename, has_horizon, slope, offset: numbers are null without a horizon or where blank; bad numbers fail."""
    df = _csv(spark, path)
    number = lambda c: F.when(F.col("has_horizon") & (F.trim(c) != ""), F.trim(c).cast("double")).alias(c)
    return df.withColumn("has_horizon", _flag(df)).select("filename", "has_horizon", number("slope"), number("offset"))


def horizon_labels(spark: SparkSession, path: str) -> DataFrame:
    """Only rows with a horizon; the flag is compared as it stands; blank numbers fail."""
    df = _csv(spark, path)
    return df.filter(_flag(df, strip=False)).select("filename", F.col("slope").cast("double").alias("slope"), F.col("offset").cast("double").alias("offset"))


def keyed_labels(spark: SparkSession, path: str) -> DataFrame:
    """One row a filename: the last of the file wins; numbers are null without a horizon."""
    df = _csv(spark, path)
    rows = df.withColumn("has_horizon", _flag(df)).withColumn("__at", F.monotonically_increasing_id())
    last = rows.groupBy("filename").agg(F.max_by(F.struct("has_horizon", "slope", "offset"), "__at").alias("r"))
    number = lambda c: F.when(F.col("r.has_horizon"), F.col(f"r.{c}").cast("double")).alias(c)
    return last.select("filename", "r.has_horizon", number("slope"), number("offset"))


def tolerant_labels(spark: SparkSession, path: str) -> DataFrame:
    """Bad numbers become null."""
    df = _csv(spark, path)
    return df.select("filename", F.col("slope").try_cast("double").alias("slope"), F.col("offset").try_cast("double").alias("offset"), _flag(df).alias("has_horizon"))


def line_labels(spark: SparkSession, path: str) -> DataFrame:
    """Only rows whose two numbers parse."""
    return tolerant_labels(spark, path).select("filename", "slope", "offset").dropna()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """filename, source_clip, t_in_clip_s, t_in_source_s, source_video_url: the clip key and the event time."""
    return _csv(spark, path).select("filename", "source_clip", F.col("t_in_clip_s").cast("double").alias("t_in_clip_s"), F.col("t_in_source_s").cast("double").alias("t_in_source_s"), "source_video_url")


def _glob(names: list[str]) -> str:
    """A pattern of exactly these file names; one that ends with a dot stands for any suffix."""
    plain = lambda n: "".join(f"\\{c}" if c in "*?[]{},\\" else c for c in n)
    return "{" + ",".join(plain(n) + "*" * n.endswith(".") for n in names) + "}"


def images(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """filename, height, width, data (rows of blue, green, red bytes) of the readable images of a folder.

    names: the only files to be listed and read; one that ends with a dot stands for any suffix.
    """
    source = spark.read.format("image").option("dropInvalid", True)
    if names is not None:
        source = source.option("pathGlobFilter", _glob(names))
    df = source.load(folder).select("image.*")
    name = F.url_decode(F.replace(F.element_at(F.split("origin", "/"), -1), F.lit("+"), F.lit("%2B")))  # origin is an address
    return df.filter("height > 0").select(name.alias("filename"), "height", "width", "nChannels", "data")


def masks(spark: SparkSession, folder: str) -> DataFrame:
    """stem and mask bytes of grayscale masks."""
    df = images(spark, folder)
    return df.select(F.regexp_replace("filename", r"\.[^.]*$", "").alias("stem"), F.col("data").alias("mask"))


def image_names(spark: SparkSession, folder: str, natural: bool = True) -> DataFrame:
    """The image files of a folder in natural or lexical order; only the listing is read. A folder without any is an
    error, as a missing one is."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(folder).select("path", "modificationTime", "length")
    df = df.withColumn("filename", F.element_at(F.split("path", "/"), -1)).filter(F.col("filename").rlike(IMAGE_SUFFIX if natural else LABEL_SUFFIX))
    if df.isEmpty():
        raise ValueError(f"no images in {folder}")
    return df.orderBy(grading.natural_key(F.col("filename")) if natural else F.col("filename"))


def results(spark: SparkSession, glob: str, by_dataset: bool = False) -> DataFrame:
    """The newest result document of each attempt number in a folder tree, with its file; by_dataset: of each number and
    dataset, the last folder of dataset_dir."""
    df = spark.read.option("multiLine", True).json(glob).withColumn("file", F.col("_metadata.file_path")).withColumn("at", F.col("_metadata.file_modification_time"))
    df = df.withColumn("number", F.regexp_extract("file", r"attempt-(\d+)", 1).try_cast("int"))
    keys = ["number", "dataset"] if by_dataset else ["number"]
    df = df.withColumn("dataset", grading.safe_name(grading.source_name(F.col("dataset_dir")))) if by_dataset else df
    names = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*names), "at").alias("r")).select(*keys, "r.*")


def pass_rates(found: DataFrame, datasets: list[str], numbers: list[int] | None = None) -> DataFrame:
    """number and a column of pass rates for each dataset, from results(by_dataset=True); null where one is missing,
    as are all of a number that has no result."""
    rate = found.select("number", "dataset", F.col("summary.accuracy.pass_rate").cast("double").alias("rate"))
    out = rate.groupBy("number").pivot("dataset", datasets).agg(F.first("rate"))
    return out if numbers is None else attempts(out, numbers)


def _byte(v: Column) -> Column:
    return F.floor(F.least(F.greatest((v.cast("double") + F.lit(0.6)) / F.lit(1.2), F.lit(0.0)), F.lit(0.999999)) * 256).cast("int")


def grids(embeddings: DataFrame) -> DataFrame:
    """frame_id, img: vectors of 64 values as 8 x 8 frames of bytes."""
    return embeddings.select(F.col("vec_id").alias("frame_id"), F.transform("embedding", _byte).alias("img"))


def pixels(frames: DataFrame, width: int, img: str = "img") -> DataFrame:
    """One row a place: frame_id, y, x, v."""
    return frames.select("frame_id", F.posexplode(img).alias("i", "v")).select("frame_id", F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).alias("x"), "v")


def with_horizon(embeddings: DataFrame, height: int = 8, width: int = 8) -> DataFrame:
    """frame_id, img, raw, slope, offset: the grid as noise around a known line that follows from the id."""
    k = F.col("vec_id")
    slope = (F.pmod(k * 37, F.lit(101)) - 50) / F.lit(100.0)
    offset = 0.3 + F.pmod(k * 17, F.lit(41)) / F.lit(100.0)
    side = lambda i: F.when((i / width).cast("int") < F.col("slope") * (i % width) + F.col("offset") * height, 1.0).otherwise(-1.0)
    value = lambda v, i: F.floor(F.least(F.greatest(128 + 60 * side(i) + 100 * v.cast("double"), F.lit(0.0)), F.lit(255.0))).cast("int")
    rows = embeddings.select(k.alias("frame_id"), "embedding", slope.alias("slope"), offset.alias("offset"))
    return rows.select("frame_id", F.transform("embedding", value).alias("img"), F.transform("embedding", _byte).alias("raw"), "slope", "offset")


def split_csv(rows: DataFrame, path: str) -> None:
    """The fixed columns of a split run: train rows before test rows, rounded, nulls blank, failed as 0 or 1."""
    fixed = lambda c, n: F.when(F.col(c).isNotNull(), F.format_string(f"%.{n}f", c)).otherwise("").alias(c)
    out = rows.withColumn("__o", F.when(F.col("split") == "train", 0).otherwise(1)).repartitionByRange(1, "__o", "filename").sortWithinPartitions("__o", "filename")
    out.select("filename", "split", "angle_bin", "offset_bin", "stratum", fixed("delta_theta_deg", 4), fixed("delta_rho_px", 4), fixed("delta_rho_norm", 6), fixed("iou", 4), fixed("latency_ms", 3), F.col("failed").cast("int").alias("failed")).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def upserted_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """The label table with new rows in place of old ones of the same filename, by filename."""
    return old.join(new.select("filename"), "filename", "left_anti").unionByName(new).orderBy("filename")


def _label_text(rows: DataFrame) -> DataFrame:
    """Labels as a file has them: true or false, and blanks for no number."""
    number = lambda c: F.coalesce(F.when(F.col("has_horizon"), F.col(c)).cast("string"), F.lit("")).alias(c)
    return rows.select("filename", F.col("has_horizon").cast("string").alias("has_horizon"), number("slope"), number("offset"))


def _in_place(rows: DataFrame, path: str, kind: str, **options) -> None:
    """rows, sorted as they shall stand and in one partition, as the one file path.

    They go to a file of another name beside it, which takes the old one's place by one renaming: a write that is cut
    off leaves the old file as it was.
    """
    spark = rows.sparkSession
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    target, beside = fs.Path(path), fs.Path(f"{path}.{uuid.uuid4().hex}")
    files = fs.FileContext.getFileContext(target.toUri(), conf) if target.toUri().getScheme() else fs.FileContext.getFileContext(conf)
    try:
        rows.write.format(kind).options(**options).save(str(beside.toString()))
        part = next(f for f in (s.getPath() for s in files.util().listStatus(beside)) if f.getName().startswith("part-"))
        overwrite = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        overwrite[0] = fs.Options.Rename.OVERWRITE
        files.rename(part, target, overwrite)
        # a local file system's checksum beside the file would not outlive another program's edit
        files.delete(fs.Path(target.getParent(), f".{target.getName()}.crc"), False)
    finally:
        files.delete(beside, True)


def upsert_label_file(spark: SparkSession, path: str, new: DataFrame) -> None:
    """The label file with new rows (filename, has_horizon, slope, offset) in place of old ones, by filename; a file
    that is not there is begun. Of new rows with one filename any counts."""
    new = new.select("filename", "has_horizon", "slope", "offset").dropDuplicates(["filename"])
    try:
        rows = upserted_labels(labels(spark, path), new)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = new
    _in_place(_label_text(rows).repartitionByRange(1, "filename").sortWithinPartitions("filename"), path, "csv", header=True, emptyValue="")


def document_file(doc: DataFrame, folder: str, dataset: str) -> str:
    """The document of a run (one row) as an indented JSON file, named for the dataset: its path."""
    safe = doc.sparkSession.range(1).select(grading.safe_name(F.lit(dataset)).alias("n")).first().n
    path = f"{folder.rstrip('/')}/full-eval-results-{safe}.json"
    _in_place(doc.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).coalesce(1), path, "text")
    return path


def attempts(found: DataFrame, numbers: list[int]) -> DataFrame:
    """found (number, ..), one row for each of the numbers: nulls where an attempt has no result."""
    wanted = found.sparkSession.createDataFrame([(int(n),) for n in numbers], "number int")
    return wanted.join(found, "number", "left")


def summary_json(summary: DataFrame, path: str) -> None:
    """One document a row."""
    summary.write.mode("overwrite").json(path)


def summary_text(summary: DataFrame) -> DataFrame:
    """A line of text for each run, as a report prints it."""
    pct = lambda c: F.format_string("%.2f%%", 100 * F.col(c))
    return summary.select(F.concat_ws("  ", F.concat(F.lit("accuracy "), "accuracy_verdict"), pct("pass_rate"), F.concat(F.lit("speed "), "speed_verdict"), F.format_string("%.2f ms", "latency_ok_mean")).alias("report"))


def worst_text(rows: DataFrame, n: int = 5) -> DataFrame:
    """place, report: a line of text for each of the n frames with the greatest angle, as a report prints them."""
    value = lambda form, c: F.when(c.isNotNull(), F.format_string(form, c)).otherwise("-")
    few = evaluation.worst(rows, "angle", n, ["filename"])
    by = W.orderBy(F.desc("angle"), "filename")  # n rows
    line = F.concat_ws("  ", "filename", value("%.2f deg", F.col("angle")), value("%.4f H", F.col("rho_norm")), F.concat(F.lit("iou "), value("%.3f", F.col("iou").cast("double"))))
    return few.select(F.row_number().over(by).alias("place"), line.alias("report"))


def markdown_section(text: str, marker: str, section: str) -> str:
    """A report file's text with everything from the marker on replaced by a new section."""
    head = text.split(marker, 1)[0].rstrip()
    return f"{head}\n\n{marker}\n\n{section.strip()}\n" if head else f"{marker}\n\n{section.strip()}\n"
