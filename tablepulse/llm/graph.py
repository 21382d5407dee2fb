"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, join_spread, remove


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF))).alias("s")).first()
    return row["n"], row["x"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v): component is the least node that can be reached.

    Every round joins each node's neighbours to the least of them: first those above the node, then all; a
    number of rounds in the order of the logarithm of the longest path ends in stars. Minima are aggregated
    map-side, neighbours are joined and never gathered (those of a hub stay in the tasks that hold them), and each
    round's edges are cut off as a table.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w")).select("u", F.least("u", "m").alias("m"), "w")
        large = join_spread(both.where("v > u"), least, ["u"], "w", 2 * mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w"))
        small = join_spread(large, least, ["u"], "w", mark[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        remove(large)
        was, mark = mark, _mark(after)
        remove(edges)
        edges = after
        if mark == was:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
