"""Global prefix sums without a single-task sort: range partitions, their totals, and sums inside each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.llm import scratch


def prefix_sums(df: DataFrame, keys: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with ``row_before`` (rows ahead in the order of ``keys``) and, for each ``sums`` item
    ``new: column``, the exclusive prefix sum of that column.

    The rows are dealt into key ranges. What crosses ranges is one total a range, so the only single-task window
    sees as many rows as there are partitions. Rows with equal keys may come in any order among themselves.
    """
    ranged = scratch.table(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_t_{new}") for new, c in sums.items()))
    starts = totals.select(
        "_range",
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_s_rows"),
        *(F.coalesce(F.sum(f"_t_{new}").over(ahead), F.lit(0)).alias(f"_s_{new}") for new in sums),
    )
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.join(F.broadcast(starts), "_range")
        .withColumn("row_before", F.col("_s_rows") + F.row_number().over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
        .withColumns({new: F.col(f"_s_{new}") + F.sum(c).over(inside) - F.col(c) for new, c in sums.items()})
        .drop("_range", "_s_rows", *(f"_s_{new}" for new in sums))
    )
