"""Working tables of operators that need a result twice or go round by round."""

from __future__ import annotations

import atexit
import shutil
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _fallback() -> str:
    folder = f"/tmp/checkpoints/{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir`` and read back, which cuts its lineage.

    Without that setting a folder on this machine serves a local master; on a cluster, where every executor would write
    to a disk of its own, it is a ValueError."""
    spark: SparkSession = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.conf.get("spark.master", "local")
    if not folder and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(folder or _fallback()).rstrip('/')}/working/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
