"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewrack.llm import decontaminate, langid, mixing, scratch, sharding, simhash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart; those without a letter or a clear language go."""
    return langid.keep_identified(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles of Jaccard 0.8 or more, found by SimHash."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return mixing.draw(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document of the mix."""
    return sharding.shard_by_bytes(docs)


STAGES = [("language_id", language), ("simhash_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixture), ("sharding", shards)]

#: Neither compressed sizes nor XXH64 fingerprints can be had in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's rows, one for each time the mix takes a document.

    Rows of null, empty or wordless texts go in the first stage, as they have no language. Null and repeated ids, null
    sources, repeated rows and further columns pass through the stages; of equal rows one is left by the second. An
    empty table gives no rows, and a benchmark without items takes none out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = f"pipeline-{uuid.uuid4().hex[:8]}"
    for at, (stage, apply) in enumerate(STAGES):
        docs = scratch.table(apply(spark, docs, sf_dir), f"{name}-{at}-{stage}")
    return docs
