"""Exact order statistics per group, without gathering a group.

The value of nearest-rank percentile p of n values is the one of index round(p / 100 * (n - 1)) in ascending
order (the upper median for even n). Values are counted in buckets of about one percent of width; the bucket
that holds a wanted index is looked up in the counts, and only its distinct values are counted in turn. A group
that holds a third of all rows is a few thousand bucket counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_FINE = 64


def _bucket(value: Column) -> Column:
    return F.when(value < 0, F.lit(-1)).otherwise(F.floor(F.log2(value + F.lit(1)) * _FINE)).cast("int")


def order_stats(rows: DataFrame, keys: list[str], value: str, percents: dict[str, float]) -> DataFrame:
    """One row per group that has values: its keys, ``n``, and the percentile of each name in ``percents``."""
    v = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    counts = v.groupBy(*keys, "__v").agg(F.count("*").alias("__n")).withColumn("__b", _bucket(F.col("__v")))
    buckets = counts.groupBy(*keys, "__b").agg(F.sum("__n").alias("__n"))
    group = Window.partitionBy(*keys)
    running = group.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = buckets.withColumn("__below", F.sum("__n").over(running) - F.col("__n")).withColumn("__total", F.sum("__n").over(group))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), F.round(F.lit(p / 100.0) * (F.col("__total") - 1)).cast("long").alias("at")) for name, p in percents.items()))
    hits = buckets.withColumn("__w", F.filter(wanted, lambda w: (w["at"] >= F.col("__below")) & (w["at"] < F.col("__below") + F.col("__n")))).where(F.size("__w") > 0)
    hits = hits.select(*(F.col(k).alias(f"__of_{k}") for k in (*keys, "__b")), "__below", "__total", "__w")
    # null-safe: a plain join would filter nulls out below the counts on one side only, and they would be made twice
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in (*keys, "__b")))
    inside = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = counts.join(hits, same).withColumn("__up", F.col("__below") + F.sum("__n").over(inside))
    found = lambda name: F.min(F.when(F.exists("__w", lambda w: (w["name"] == name) & (w["at"] < F.col("__up"))), F.col("__v")))
    return near.groupBy(*keys).agg(F.first("__total").alias("n"), *(found(name).alias(name) for name in percents))
