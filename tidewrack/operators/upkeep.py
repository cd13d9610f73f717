"""Purges, samples, freshness and change detection over relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.operators.working import stored


def purge_plan(sessions: DataFrame, keep: Column) -> DataFrame:
    """(id, keep): what a purge would do. A null predicate keeps nothing."""
    return sessions.select("id", F.coalesce(keep, F.lit(False)).alias("keep"))


def purge(relations: dict[str, DataFrame], keep: Column) -> dict[str, DataFrame]:
    """Every relation without the sessions that fail ``keep``; references to them become null. What goes is listed in
    ``pending_payload_purges``, so that payload can be removed later and again."""
    plan = purge_plan(relations["sessions"], keep)
    gone = plan.filter("not keep").select(F.col("id").alias("gone_id"))
    out = {n: df.join(gone, F.col("session_id") == F.col("gone_id"), "left_anti") for n, df in relations.items() if n != "sessions"}
    left = relations["sessions"].join(gone, F.col("id") == F.col("gone_id"), "left_anti")
    marked = left.join(gone.select("gone_id"), F.col("parent_session_id") == F.col("gone_id"), "left")
    out["sessions"] = marked.withColumn("parent_session_id", F.when(F.col("gone_id").isNull(), F.col("parent_session_id"))).drop("gone_id")
    out["pending_payload_purges"] = gone.select(F.col("gone_id").alias("session_id"))
    return out


def changed(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are new, or differ in modification time or size."""
    return listing.join(known.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")


def salted_hash(content: Column, facts: list[Column], domain: str) -> Column:
    """A content hash that also covers facts kept beside the file."""
    return F.sha2(F.concat_ws("\0", F.lit(domain), content, F.to_json(F.struct(*(f.alias(f"f{i}") for i, f in enumerate(facts))), {"ignoreNullFields": "false"})), 256)


def stratified(files: DataFrame, strata: int = 10, per_stratum: int = 10) -> DataFrame:
    """Evenly spaced files of each size stratum, one path an identity: (identity, path, size, stratum).

    Strata are equal shares of the files in the order of size and path. Files are dealt into ranges of that order and
    numbered there; what the ranges ahead hold is added, so no task sees more than a range."""
    one = files.groupBy("identity").agg(F.min(F.struct("path", "size")).alias("f")).select("identity", "f.path", "f.size")
    dealt = stored(one.repartitionByRange("size", "path").withColumn("range", F.spark_partition_id()))
    counts = dealt.groupBy("range").count()  # one row a range
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("range").alias("r"), F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"), F.sum("count").over(Window.partitionBy(F.lit(0))).alias("all"))
    at = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("size", "path", "identity")) - 1
    placed = dealt.join(F.broadcast(starts), F.col("range") == F.col("r")).withColumn("at", at)
    # The first ``all mod strata`` strata hold one file more than the others.
    small, extra = F.expr(f"all div {strata}"), F.col("all") % strata
    in_large = F.col("at") < extra * (small + 1)
    stratum = F.when(in_large, F.floor(F.col("at") / (small + 1))).otherwise(extra + F.floor((F.col("at") - extra * (small + 1)) / F.greatest(small, F.lit(1))))
    rows = placed.withColumn("s", stratum).withColumn("n", F.when(in_large, F.col("at") - F.col("s") * (small + 1)).otherwise(F.col("at") - extra - F.col("s") * small))
    of = small + (F.col("s") < extra).cast("int")
    step = F.greatest(F.lit(1), F.floor(of / per_stratum))
    rows = rows.filter((F.col("n") % step == 0) & (F.floor(F.col("n") / step) < per_stratum))
    return rows.select("identity", "path", "size", (F.col("s") + 1).cast("int").alias("stratum"))


def estimated_bytes(rows: DataFrame, column: str, fraction: float = 0.01, seed: int = 1) -> DataFrame:
    """An estimate of a column's bytes from a sample, scaled by the count of rows."""
    mean = rows.sample(fraction=fraction, seed=seed).agg(F.avg(F.octet_length(column)).alias("mean"))
    return rows.agg(F.count(F.lit(1)).alias("rows")).join(mean).select("rows", (F.col("rows") * F.coalesce("mean", F.lit(0.0))).cast("long").alias("estimated_bytes"))


def freshness(sessions: DataFrame, dirty: DataFrame) -> DataFrame:
    """One row: sessions that wait for extraction, the span of the corpus, and whether anything waits."""
    waiting = dirty.join(sessions.select(F.col("id").alias("session_id"), "started_at"), "session_id", "left").agg(F.count(F.lit(1)).alias("pending"), F.min("started_at").alias("pending_from"), F.max("started_at").alias("pending_to"))
    return waiting.withColumn("stale", F.col("pending") > 0)


def embedding_plan(chunks: DataFrame, embedded: DataFrame, model_id: str, limit: int) -> DataFrame:
    """The next chunks to embed with a model: those it lacks, in order of session and chunk."""
    todo = chunks.join(embedded.filter(F.col("model_id") == model_id).select("chunk_id"), "chunk_id", "left_anti")
    return todo.orderBy("session_id", "chunk").limit(limit)
