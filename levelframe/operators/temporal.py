"""Scenes and the line carried from frame to frame.

Whether a frame continues the scene depends on the two thumbnails alone, so that scenes are a window over the order.
Only the line before depends on outcomes; it starts anew with each scene, so that scenes are folded in parallel: their
frames, a few candidates each, stream by in order, and the line accepted last is all that is held.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from levelframe.functions.arrays import let
from levelframe.functions.lines import VERTICAL, angular_distance, positional_distance, temporal_prior
from levelframe.operators.scoring import SKY_BOOST, SKY_GATE, sky_overrides
from levelframe.session import stored

SCENE_DIFFERENCE = 22.0
WEIGHT = 2.0
CANDIDATE = "struct<source:string,place:int,raw:double,line:struct<vx:double,vy:double,x0:double,y0:double>,count:int>"


def thumbnail_difference(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p - q).cast("double")), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def long_scenes(frames: DataFrame, order: list[str], thumb: str = "thumb", clip: list[str] | None = None) -> DataFrame:
    """scenes() for clips of any length: the order is dealt to the tasks in ranges, each range numbers its own scenes,
    and what it needs of the ranges before, their last thumbnail and how many scenes they began, is handed on by a row
    a range and clip.
    """
    clip = list(clip or [])
    dealt = stored(frames.repartitionByRange(*clip, *order).withColumn("__part", F.spark_partition_id()))
    by = W.partitionBy("__part", *clip).orderBy(*order)
    difference = thumbnail_difference(F.col(thumb), F.lag(thumb).over(by))
    first = F.row_number().over(by) == 1
    inside = dealt.withColumns({"__first": first, "__near": F.coalesce(difference <= SCENE_DIFFERENCE, F.lit(False))})
    place = F.struct(*order)
    ends = inside.groupBy("__part", *clip).agg(
        F.min_by(thumb, place).alias("__head"), F.max_by(thumb, place).alias("__tail"), F.sum(F.when(F.col("__first") | F.col("__near"), 0).otherwise(1)).alias("__own")
    )
    # a row a range and clip
    turn = W.partitionBy(*clip).orderBy("__part")
    ends = ends.withColumn("__joins", F.coalesce(thumbnail_difference(F.col("__head"), F.lag("__tail").over(turn)) <= SCENE_DIFFERENCE, F.lit(False)))
    begun = F.col("__own") + F.when(F.col("__joins"), 0).otherwise(1)
    ends = ends.withColumn("__before", F.coalesce(F.sum(begun).over(turn.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ends = ends.select(*(F.col(c).alias(f"__{c}") for c in clip), F.col("__part").alias("__range"), "__joins", "__before")
    same = [F.col("__part") == F.col("__range"), *(F.col(c).eqNullSafe(F.col(f"__{c}")) for c in clip)]
    out = inside.join(ends, same)
    near = F.when(F.col("__first"), F.col("__joins")).otherwise(F.col("__near"))
    out = out.withColumn("continuous", near)
    scene = F.col("__before") + F.sum(F.when(F.col("continuous"), 0).otherwise(1)).over(by.rowsBetween(W.unboundedPreceding, 0)) - 1
    return out.withColumn("scene", scene.cast("int")).select(*frames.columns, "continuous", "scene")


def scenes(frames: DataFrame, order: list[str], thumb: str = "thumb", clip: list[str] | None = None) -> DataFrame:
    """frames with continuous and scene, counted from 0 in each clip, whose frames are one task's; without clips the
    whole table is one order, for which long_scenes() is."""
    if not clip:
        return long_scenes(frames, order, thumb)
    by = W.partitionBy(*(clip or [])).orderBy(*order)
    near = F.coalesce(thumbnail_difference(F.col(thumb), F.lag(thumb).over(by)) <= SCENE_DIFFERENCE, F.lit(False))
    out = frames.withColumn("continuous", near)
    return out.withColumn("scene", (F.sum(F.when(F.col("continuous"), 0).otherwise(1)).over(by.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("int"))


def chosen(candidates: Column, before: Column, height: int, width: int, floor: float) -> Column:
    """The winner of a frame's candidates given the line before, or null if the frame abstains."""

    def boosted(c: Column) -> Column:
        prior = F.when(before.isNotNull(), temporal_prior(angular_distance(c["line"], before), positional_distance(c["line"], before) / height)).otherwise(F.lit(0.0))
        sky = F.when(c["source"] == "sky", SKY_BOOST).otherwise(1.0)
        return F.struct(F.round(c["raw"] * sky * (1 + WEIGHT * prior), 9).alias("score"), (-c["place"]).alias("place"), c.alias("c"))

    def pick(best: Column) -> Column:
        sky = F.get(F.filter(candidates, lambda c: c["source"] == "sky"), F.lit(0))
        won = F.when(sky_overrides(best, sky, height, width), sky).otherwise(best)
        return let(won, lambda w: F.when((w["raw"] >= floor) & (w["count"] >= 2), w))

    return F.when(F.size(candidates) > 0, let(F.array_max(F.transform(candidates, boosted))["c"], pick))


def carried_rows(df: DataFrame, keys: list[str], order: list[str], step: Callable, schema: str) -> DataFrame:
    """A row for each row, from step(state, row) -> (state, values): the rows of each key stream by in order, and only
    the state is held, which starts as None with each key. df should have the columns that step reads, and few others.

    schema: of keys, order and what step returns. A key's rows are one task's, as each waits for the one before.
    """
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != now:
                    now, state = key, None
                state, found = step(state, row)
                out.append((*key, *(row[o] for o in order), *found))
            columns = list(zip(*out, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(of, kind)


def _hesse(line: dict) -> tuple[float, float]:
    size = math.hypot(line["vx"], line["vy"])
    nx, ny = -line["vy"] / size, line["vx"] / size
    sign = -1.0 if ny < 0 or (ny == 0 and nx < 0) else 1.0
    return math.degrees(math.atan2(line["vy"], line["vx"])), sign * (nx * line["x0"] + ny * line["y0"])


def prior(line: dict, before: dict | None, height: float) -> float:
    """temporal_prior of a line given the one before."""
    if before is None:
        return 0.0
    (a, p), (b, q) = _hesse(line), _hesse(before)
    d = abs(a - b) % 180
    return math.exp(-((min(d, 180 - d) / 8.0) ** 2 + (abs(p - q) / height / 0.14) ** 2))


def _y_at(line: dict, x: float) -> float:
    return line["y0"] + line["vy"] / line["vx"] * (x - line["x0"]) if abs(line["vx"]) > VERTICAL else line["y0"]


def choice(candidates: list[dict] | None, before: dict | None, height: float, width: float, floor: float) -> dict | None:
    """chosen() of one frame's candidates, as values: for what is carried from row to row, in batches and streams."""
    if not candidates:
        return None
    boost = lambda c: SKY_BOOST if c["source"] == "sky" else 1.0
    best = max(candidates, key=lambda c: (round(c["raw"] * boost(c) * (1 + WEIGHT * prior(c["line"], before, height)), 9), -c["place"]))
    sky = next((c for c in candidates if c["source"] == "sky"), None)
    if sky is not None and best["source"] != "sky" and sky["raw"] >= SKY_GATE and sky["raw"] >= 0.72 * best["raw"] and _y_at(best["line"], width / 2) - _y_at(sky["line"], width / 2) >= 0.08 * height:
        best = sky
    return best if best["raw"] >= floor and best["count"] >= 2 else None


def fold(frames: DataFrame, keys: list[str], order: str, height: int, width: int, floor: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """keys, order, result, and the columns to keep: the frames of each key (a scene) in order, each choosing with the
    line accepted before; a frame that abstains carries none.

    frames: keys, order, candidates.
    """

    def step(before: dict | None, row: dict) -> tuple[dict | None, tuple]:
        best = choice(row["candidates"], before, height, width, floor)
        return best and best["line"], (best, *(row[k] for k in keep))

    kinds = {c: frames.schema[c].dataType.simpleString() for c in (*keys, order, *keep)}
    named = lambda cs: [f"`{c}` {kinds[c]}" for c in cs]
    schema = ", ".join([*named((*keys, order)), f"result {CANDIDATE}", *named(keep)])
    return carried_rows(frames.select(*keys, order, "candidates", *keep), keys, [order], step, schema)


def smoothed(events: DataFrame, key: str, order: list[str], value: str, reset: float, weight: float = 0.5) -> DataFrame:
    """A running estimate of a value by key: each new value moves it by weight, a jump over reset starts it anew; a null
    value starts anew with none."""

    def step(at: float | None, row: dict) -> tuple[float | None, tuple]:
        v = row[value]
        jump = at is None or v is None or abs(v - at) > reset
        at = v if jump else at + weight * (v - at)
        return at, (at, jump)

    kinds = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in (key, *order))
    return carried_rows(events.select(key, *order, value), [key], order, step, f"{kinds}, estimate double, reset boolean")
