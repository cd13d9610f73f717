"""Working tables in the folder that the driver and all executors share.

A lineage is cut by writing a Parquet table, never by caching blocks on one executor: a lost executor then costs
the tasks it was running and nothing else. The folder is ``spark.checkpoint.dir``. Where a session has none, one on
this machine is used and removed when Python ends, but only with a local master: on a cluster each executor would
write to a disk of its own.
"""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@cache
def _fallback() -> str:
    folder = f"/tmp/checkpoints/{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def folder(spark: SparkSession) -> str:
    """The shared folder of this session. Without one, on a master that is not local, a ValueError."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master", "local").startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _fallback()


def table(df: DataFrame, name: str, compact: bool = False) -> DataFrame:
    """``df`` written once and read back. Its size on disk lets the planner decide on broadcasts. The shuffle files of
    the write go as soon as it is done. ``compact`` spends more time on compression, where a table holds texts."""
    spark = df.sparkSession
    path = f"{folder(spark).rstrip('/')}/tidewrack/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd" if compact else None)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete working tables that nothing will read again: all that came of them has been written."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
        for folder_of in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder_of)
            path.getFileSystem(conf).delete(path, True)


def dealt(df: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores, dealt out to all of them; a larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores ahead as make it unlike any column of ``df`` and any other name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows``: what is made of a slice stays small, whatever the session's setting."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
