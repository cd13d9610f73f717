"""Continuous ingest: micro-batches of changed sessions keep a folder of Parquet relations up to date.

Transcripts are appended to in place, which a file stream does not see, so each round lists a store, takes what is
new or changed by (path, mtime, size), parses it, and replaces whole sessions by id. A round that is repeated after a
failure gives the same tables. Sessions arrive as a stream as well (``follow``), by foreachBatch with the same code.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidewrack.operators.working import stored
from tidewrack.plans.contract import Locked
from tidewrack.sources import stores

KEYS = {"sessions": "id", "messages": "session_id", "tool_calls": "session_id", "tool_outputs": "session_id", "files": "path", "dirty": "session_id", "errors": "path", "heartbeat": "process"}
#: Parts of a table by a hash of its key: a replacement writes those that its keys fall in, whatever else there is.
BUCKETS = 256


class Corpus:
    """Parquet tables under a folder, each a pointer to its current version, so that readers never see half a write.

    A table is ``BUCKETS`` parts by a hash of its key. A version is a list of the parts that make it up, old ones and
    those written with it, and is then named in a one-row pointer table: the folder may be on any file system that
    Spark writes to. ``vacuum`` deletes what no version needs any more."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self, name: str) -> str | None:
        path, fs = self._fs(f"{self.folder}/{name}/_current")
        if not fs.exists(path):
            return None
        return self.spark.read.text(f"{self.folder}/{name}/_current").orderBy(F.desc("value")).first()[0].split(" ")[1]

    def _parts(self, name: str) -> tuple[StructType, dict[int, str]] | None:
        """The schema of the current version and where each of its parts is: ``BUCKETS`` lines at most."""
        version = self._pointer(name)
        if version is None:
            return None
        lines = [r["value"].split(" ", 1) for r in self.spark.read.text(f"{self.folder}/{name}/_parts/{version}").collect()]
        schema = next(StructType.fromJson(json.loads(v)) for k, v in lines if k == "schema")
        return schema, {int(k): v for k, v in lines if k != "schema"}

    def read(self, name: str) -> DataFrame | None:
        found = self._parts(name)
        return None if found is None else self._read(*found)

    def _read(self, schema: StructType, parts: dict[int, str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{p}" for p in parts.values()))

    def _bucket(self, name: str):
        return F.pmod(F.xxhash64(F.col(KEYS[name]).cast("string")), F.lit(BUCKETS)).cast("int")

    def write(self, name: str, df: DataFrame) -> None:
        self._write(name, df, {})

    def _write(self, name: str, df: DataFrame, kept: dict[int, str]) -> None:
        at = self._pointer(name)
        number = int(at.split("-")[0][1:]) + 1 if at else 0
        version = f"v{number:09d}-{uuid.uuid4().hex[:8]}"
        df.withColumn("_bucket", self._bucket(name)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{name}/{version}")
        path, fs = self._fs(f"{self.folder}/{name}/{version}")
        made = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        parts = kept | {int(d.split("=")[1]): f"{name}/{version}/{d}" for d in made if d.startswith("_bucket=")}
        lines = [("schema " + df.schema.json(),), *((f"{k} {v}",) for k, v in sorted(parts.items()))]
        self.spark.createDataFrame(lines, "value string").coalesce(1).write.text(f"{self.folder}/{name}/_parts/{version}")
        self.spark.createDataFrame([(f"{number:09d} {version}",)], "value string").coalesce(1).write.mode("append").text(f"{self.folder}/{name}/_current")

    def replace(self, name: str, rows: DataFrame, keys: DataFrame) -> None:
        """Rows of these keys are replaced by ``rows``: an anti-join and a union over the parts that the keys and rows
        fall in. The other parts are not read."""
        old, key = self._parts(name), KEYS[name]
        kept: dict[int, str] = {}
        if old is not None:
            schema, parts = old
            keys = keys.select(F.col(keys.columns[0]).alias(key)).distinct()
            touched = {r[0] for r in keys.unionByName(rows.select(key)).select(self._bucket(name)).distinct().collect()}  # BUCKETS rows at most
            same = self._read(schema, {k: v for k, v in parts.items() if k in touched}).join(keys, key, "left_anti")
            rows = same.unionByName(rows, allowMissingColumns=True)
            if set(rows.columns) == set(schema.names):
                kept = {k: v for k, v in parts.items() if k not in touched}
            else:  # a table with new columns is written anew, once
                rows = self._read(schema, {k: v for k, v in parts.items() if k not in touched}).unionByName(rows, allowMissingColumns=True)
        self._write(name, rows, kept)

    def vacuum(self, name: str) -> int:
        """Delete the parts, and lists of parts, of versions before the current one that it does not share; how many
        folders went. Not while someone reads an older version."""
        found, version = self._parts(name), self._pointer(name)
        if found is None:
            return 0
        needed, gone = {v.split("/", 1)[1] for v in found[1].values()}, 0
        root, fs = self._fs(f"{self.folder}/{name}")
        for s in fs.listStatus(root):
            folder = s.getPath().getName()
            if not folder.startswith("v"):
                continue
            for part in fs.listStatus(s.getPath()):
                if part.isDirectory() and f"{folder}/{part.getPath().getName()}" not in needed:
                    gone += bool(fs.delete(part.getPath(), True))
        for s in fs.listStatus(self._fs(f"{self.folder}/{name}/_parts")[0]):
            if s.getPath().getName() != version:
                fs.delete(s.getPath(), True)
        return gone


def absorb(corpus: Corpus, parsed: DataFrame) -> DataFrame:
    """Replace the sessions that ``parsed`` has and whose content is new; their ids are the dirty set, returned.

    Payloads go first and sessions last: a round that breaks off leaves sessions as they were, and the next one finds
    them changed and does it all again."""
    made = stores.relations(parsed)
    old = corpus.read("sessions")
    fresh = made["sessions"]
    if old is not None:
        fresh = fresh.join(old.select("id", "content_hash"), ["id", "content_hash"], "left_anti")
    dirty = fresh.select(F.col("id").alias("session_id")).distinct()
    corpus.write("dirty", dirty)
    dirty = corpus.read("dirty")
    for name in ("tool_outputs", "messages", "tool_calls", "sessions"):
        key = KEYS[name]
        corpus.replace(name, made[name].join(dirty.select(F.col("session_id").alias(key)), key, "left_semi"), dirty)
    return dirty


@contextmanager
def writing(corpus: Corpus, wait: float = 60.0, stale: float = 3600.0) -> Iterator[None]:
    """One writer at a time: a file that only one can create, taken over where its writer has been gone for ``stale``
    seconds. Locked where it does not come free within ``wait``."""
    path, fs = corpus._fs(f"{corpus.folder}/_lock")
    until = time.time() + wait
    while True:
        try:
            fs.create(path, False).close()
            break
        except Exception as taken:  # whatever a file system says where the file is there already
            try:
                age = time.time() - fs.getFileStatus(path).getModificationTime() / 1000
            except Exception:
                continue  # it has just gone
            if age > stale:
                fs.delete(path, False)
            elif time.time() > until:
                raise Locked(f"someone has been writing for {int(age)} s") from taken
            else:
                time.sleep(0.2)
    try:
        yield
    finally:
        fs.delete(path, False)


def ingest(corpus: Corpus, roots: dict[str, str], facts: dict[str, Callable[[dict[str, DataFrame]], DataFrame]], progress: Callable[[dict], None] | None = None) -> dict:
    """All stores (name: root), then all fact tables for what has changed, under the write lock: how many sessions
    each store changed, the files that failed, and the tables that were refreshed. The first store or table that
    cannot be done ends it, with what was done so far in the corpus. ``progress`` is told of each step."""
    tell, report = progress or (lambda event: None), {"changed": {}, "failed": [], "refreshed": []}
    with writing(corpus):
        dirty = None
        for store, root in roots.items():
            now = stored(poll(corpus, store, root).select("session_id"))
            report["changed"][store] = now.count()
            report["failed"] += [r.asDict() for r in corpus.read("errors").orderBy("path").limit(1000).collect()]
            dirty = now if dirty is None else dirty.unionByName(now)
            tell({"step": "import", "store": store, "changed": report["changed"][store]})
        for name, build in facts.items() if dirty is not None else ():
            refresh(corpus, name, build, dirty.distinct())
            report["refreshed"].append(name)
            tell({"step": "extract", "table": name})
        beat(corpus)
    return report


def beat(corpus: Corpus, process: str = "ingest") -> None:
    """Say that ingest is alive."""
    row = corpus.spark.createDataFrame([(process, time.time())], "process string, at double")
    corpus.replace("heartbeat", row, row.select("process"))


def last_beat(corpus: Corpus) -> float | None:
    beats = corpus.read("heartbeat")
    return beats.agg(F.max("at")).first()[0] if beats is not None else None


def poll(corpus: Corpus, store: str, root: str) -> DataFrame:
    """One round over a store: files that are new or changed since the last round, they or what is kept beside them,
    are read, nothing else is. A file that cannot be parsed does not become known: it is in the ``errors`` table
    (path, error) of this round and is read again in the next. The dirty sessions."""
    spark = corpus.spark
    listing = stored(stores.listing(spark, store, root))
    known = corpus.read("files")
    parsed = stored(stores.read_store(spark, store, root, known=known))
    corpus.write("errors", parsed.filter("error is not null").select("path", "error"))
    failed = corpus.read("errors")
    dirty = absorb(corpus, parsed.filter("error is null"))
    read = listing.join(failed.select("path"), "path", "left_anti")
    corpus.replace("files", read, read.select("path"))
    return dirty


def seed(corpus: Corpus, store: str, root: str) -> None:
    """Take the present files as known without reading them."""
    listing = stores.listing(corpus.spark, store, root)
    corpus.replace("files", listing, listing.select("path"))


def refresh(corpus: Corpus, name: str, build: Callable[[dict[str, DataFrame]], DataFrame], dirty: DataFrame | None = None) -> DataFrame:
    """A fact table rebuilt for the dirty sessions alone, or for all: ``build`` takes the core relations."""
    core = {n: corpus.read(n) for n in ("messages", "tool_calls")}
    KEYS.setdefault(name, "session_id")
    if dirty is None or corpus.read(name) is None:
        corpus.write(name, build(core))
    else:
        corpus.replace(name, build({n: d.join(dirty, "session_id", "left_semi") for n, d in core.items()}), dirty)
    return corpus.read(name)


def follow(spark: SparkSession, landing: str, corpus: Corpus, checkpoint: str, every: str | None = None, max_files: int = 1000) -> StreamingQuery:
    """A stream of parsed sessions (Parquet files of ``stores.PARSED``) into the corpus, batch by batch.

    Within a batch the last content of a session wins; a batch that is run again replaces the same sessions."""
    stream = spark.readStream.schema(stores.PARSED).option("maxFilesPerTrigger", max_files).parquet(landing)

    def batch(df: DataFrame, batch_id: int) -> None:
        last = Window.partitionBy("id").orderBy(F.desc_nulls_last("ended_at"), F.desc("path"))
        absorb(corpus, df.filter("error is null").withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n"))

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def activity(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Tool calls and failures by event-time window and tool, from a stream with ts, name and exit_code; rows later
    than the watermark are dropped and their windows are closed."""
    seen = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "name")
    return seen.agg(F.count(F.lit(1)).alias("calls"), F.count_if("exit_code <> 0").alias("failures"))
