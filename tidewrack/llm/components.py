"""Connected components by alternating large-star and small-star rounds over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm import scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def roots(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v; longs) -> (node, root), one row for each node that has an edge; the root is the least node.

    Every round replaces edges by ones to smaller nodes and keeps what is connected, until only stars are left. A
    node's neighbours are met by an aggregate and a join on the node, never gathered in one row, so a hub costs
    as much as its edges. An empty table gives no rows.
    """
    edges = scratch.table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.table(large.distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        small = large.join(least, F.col("u") == F.col("n"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
        edges = scratch.table(small.distinct(), "small")
        if (now := _mark(edges)) == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
