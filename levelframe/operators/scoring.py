"""How well candidate lines part a frame into two regions, and which one wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from levelframe.functions.arrays import let, total
from levelframe.functions.lines import angle_prior, roll, y_at
from levelframe.operators.raster import balance

LEAST_SIDE = 16
FLOORS = {7: 0.15, 8: 0.22, 9: 0.22, 10: 0.22}
DEGENERATE = 0.92
PATH_GATE, PATH_ROLL = 5.0, 25.0
SKY_GATE, SKY_ROLL = 1.0, 65.0
SKY_BOOST = 1.2
SOURCES = ("L", "b", "path", "sky")


def coherence(planes: Column, ln: Column, width: int, least: int = LEAST_SIDE) -> Column:
    """Distance of the two sides' means over their spread, times the angle prior; -1 if a side has too few places."""

    def of(side: Column) -> Column:
        up = F.size(F.filter(side, lambda s: s))
        down = F.size(side) - up

        def part(plane: Column) -> Column:
            own = F.zip_with(plane, side, lambda v, s: F.struct(v.cast("double").alias("v"), s.alias("s")))

            def moments(o: Column) -> Column:
                m = lambda lit: let(F.transform(F.filter(o, lambda q: q["s"] == lit), lambda q: q["v"]), lambda a: F.struct((total(a) / F.size(a)).alias("mu"), (total(F.transform(a, lambda v: v * v)) / F.size(a) - F.pow(total(a) / F.size(a), F.lit(2.0))).alias("var")))
                return let(m(True), lambda p: let(m(False), lambda q: F.struct(F.pow(p["mu"] - q["mu"], F.lit(2.0)).alias("d"), (p["var"] + q["var"]).alias("s"))))

            return let(own, moments)

        def score(parts: Column) -> Column:
            d = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["d"])
            s = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["s"])
            return d / (s + 1.0) * angle_prior(roll(ln))

        return F.when((up < least) | (down < least), F.lit(-1.0)).otherwise(let(F.transform(planes, part), score))

    lit = lambda i, q: ((i % width).cast("double") - q["x0"]) * q["vy"] - ((i / width).cast("int").cast("double") - q["y0"]) * q["vx"]
    return let(let(ln, lambda q: F.transform(planes[0], lambda v, i: F.round(lit(i, q), 9) < 0)), of)


def gate(source: Column, raw: Column, ln: Column) -> Column:
    """Whether a candidate may enter the pool: path and sky candidates have gates on score and roll."""
    r = roll(ln)
    return F.when(source == "path", (raw >= PATH_GATE) & (r <= PATH_ROLL)).when(source == "sky", (raw >= SKY_GATE) & (r <= SKY_ROLL)).otherwise(F.lit(True))


def admitted(pool: DataFrame) -> DataFrame:
    """The pool without path and sky candidates that miss their gates; needs source, raw, line."""
    return pool.filter(gate(F.col("source"), F.col("raw"), F.col("line")))


def degenerate(mask_a: Column, mask_b: Column) -> Column:
    """Both masks have nearly all places in one class: the frame has no horizon."""
    return (balance(mask_a) >= DEGENERATE) & (balance(mask_b) >= DEGENERATE)


def place_of(source: Column, rank: Column) -> Column:
    """The order in which equal scores win."""
    return (F.array_position(F.array(*(F.lit(s) for s in SOURCES)), source) * 1000 + rank).cast("int")


def with_place(pool: DataFrame) -> DataFrame:
    return pool.withColumn("place", place_of(F.col("source"), F.col("rank")))


def winners(pool: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate with the greatest score of each key, the first of equals."""
    order = W.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), "place")
    return pool.withColumn("__k", F.row_number().over(order)).filter("__k = 1").drop("__k")


def sky_overrides(best: Column, sky: Column, height: int, width: int) -> Column:
    """True where the sky candidate replaces another winner that lies well below it."""
    lower = y_at(best["line"], F.lit(width / 2)) - y_at(sky["line"], F.lit(width / 2))
    return F.coalesce((best["source"] != "sky") & (sky["raw"] >= SKY_GATE) & (sky["raw"] >= 0.72 * best["raw"]) & (lower >= 0.08 * height), F.lit(False))
