"""Sharding by bytes: contiguous, balanced shards from global prefix sums of sizes. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm import ordering, scratch


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, size, checksum, shard and slot.

    The size is the text's UTF-8 bytes plus one; a null text has no bytes and the checksum of an empty one. The
    order is (id, checksum, size), a null id first. A row belongs to the shard whose equal share of all bytes holds
    the row's midpoint, so a shard is a contiguous run and differs from the equal share by at most one row at each
    end. A row larger than a share leaves shards beside it empty. Slots count from 0 in each shard. Repeated rows
    get slots of their own. An empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = scratch.table(docs.select(F.col(id_col).alias(id_col), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32")), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 1
    placed = ordering.prefix_sums(rows, [F.col(id_col).asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc()], {"bytes_before": "size"})
    shard = F.expr(f"cast(least({shards - 1}, (2 * bytes_before + size) * {shards} div {2 * total}) as int)")
    placed = scratch.table(placed.withColumn("shard", shard), "placed")
    starts = placed.groupBy("shard").agg(F.min("row_before").alias("_first"))
    return placed.join(F.broadcast(starts), "shard").select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row_before") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt into 8 contiguous shards of near equal bytes."""
    return shard_by_bytes(scratch.dealt(spark.read.parquet(f"{sf_dir}/documents.parquet")))
