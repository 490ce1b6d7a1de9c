"""Places of rows in an order, where a key may hold any share of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from levelframe.session import stored


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "place") -> DataFrame:
    """df with each row's place from 1 within its keys, and __n, the rows of the keys.

    The order is dealt to the tasks in ranges of keys and order; a range counts its own rows, and the ranges before it
    are added from a row a range and key. Rows with equal keys and order stay in one range, in any order.
    """
    dealt = stored(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__own"))
    by = W.partitionBy(*keys)
    before = F.coalesce(F.sum("__own").over(by.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__part").alias("__range"), before.alias("__before"), F.sum("__own").over(by).alias("__n"))
    inside = dealt.withColumn("__row", F.row_number().over(W.partitionBy(*keys, "__part").orderBy(*order)))
    same = [F.col("__part") == F.col("__range"), *(F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)]
    out = inside.join(counts, same)
    return out.select(*df.columns, (F.col("__before") + F.col("__row")).cast("long").alias(name), F.col("__n").cast("long").alias("__n"))
