"""Language identification by compression: the language whose text, as a zstandard dictionary, encodes a text shortest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewrack.llm import scratch

UNDETERMINED = "und"
#: The bound of the training sample: rows a language, characters of a row, characters a language.
ROWS, LONGEST, CHARS = 200, 1 << 16, 1 << 18
#: A text is encoded in equal pieces of so many bytes at most, each twice in a row: the coder stores what it can't
#: shorten raw, and then lengths would say nothing. A dictionary saves a bounded number of bytes in one run, so over
#: a whole text its share, and the margin with it, would fall with the length.
PIECE, LEVEL = 2048, 9
NARROW = 0.005


def encoded(text: str) -> bytes:
    """The whole text, lower-cased, as the coders see it."""
    return text.lower().encode("utf-8", "surrogatepass")


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, rows: int = ROWS, longest: int = LONGEST, chars: int = CHARS) -> dict[str, bytes]:
    """Raw dictionaries by language, the most frequent language first, whatever the number of languages.

    They come from a bounded sample of rows that have an id, a text and a language and are not held out: whole texts
    of at most ``longest`` characters, in the order of a hash of the id, ``rows`` and ``chars`` a language. A row
    that is repeated takes as many places, with one text. Only ids, languages, lengths and hashes of the whole table are read to choose them;
    a group limit ahead of the shuffle keeps a frequent language from meeting in one task.
    """
    known = docs.filter("doc_id is not null and lang is not null and text is not null").filter(~held_out(F.col("doc_id")))
    known = known.select("lang", "doc_id", "text", F.xxhash64("text").alias("version"), F.char_length("text").alias("size"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "version")
    some = known.filter(F.col("size") <= longest).select("lang", "doc_id", "version", "size")
    some = some.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= rows).drop("n").distinct()
    some = some.withColumn("total", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter(F.col("total") <= chars)
    chosen = some.select(F.col("lang").alias("w_lang"), F.col("doc_id").alias("w_id"), F.col("version").alias("w_version"))
    names = [r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    same = (F.col("lang") == F.col("w_lang")) & (F.col("doc_id") == F.col("w_id")) & (F.col("version") == F.col("w_version"))
    sample = known.join(F.broadcast(chosen), same).groupBy("lang", "doc_id", "version").agg(F.first("text").alias("text"))
    texts: dict[str, list[str]] = {name: [] for name in names}
    for r in sorted(sample.collect(), key=lambda r: (str(r["doc_id"]), r["version"])):
        texts[r["lang"]].append(r["text"])
    return {name: b" ".join(map(encoded, t)) for name, t in texts.items() if any(t)}


def classifier(dictionaries: dict[str, bytes]) -> Callable[[str | None], tuple[str, float]]:
    """text -> (language, margin): by how much of its length the next best encoding is longer.

    A text's length is the sum over pieces of ``PIECE`` bytes at most that cover all of it, each encoded on its own.
    Equal lengths go to the more frequent language and have margin 0. A text that is null or has no letter is
    undetermined, as is any text where no language was learned; a single language has margin 1.
    """
    names = list(dictionaries)
    coders = [
        zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        for d in dictionaries.values()
    ]

    def classify(text: str | None) -> tuple[str, float]:
        if not names or not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        data = encoded(text)
        width = -(-len(data) // -(-len(data) // PIECE))
        pieces = [piece + b" " + piece for piece in (data[at : at + width] for at in range(0, len(data), width))]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in coders]
        best = min(range(len(names)), key=sizes.__getitem__)
        if len(names) == 1:
            return names[0], 1.0
        second = min(s for at, s in enumerate(sizes) if at != best)
        return names[best], (second - sizes[best]) / sizes[best]

    return classify


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (0 to 1, rising with the margin) and rejected:
    undetermined, or a margin under ``NARROW``. Whole texts are encoded; nothing else of a row is looked at. A null
    text, or one without a letter, is ``und`` with score 0; repeated rows stay, and an empty table gives no rows."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)  # of bounded size: CHARS a language

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = classifier(sent.value)
        for b in scratch.bounded(batches):
            found = [classify(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([n for n, _ in found], pa.string()), pa.array([m / (m + 0.05) for _, m in found], pa.float64()), pa.array([n == UNDETERMINED or m < NARROW for n, m in found], pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return rows.mapInArrow(label, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """``docs`` without those rejected: a null text, none with a letter, or no language ahead of the next. All columns
    are kept as they are, whatever else they are called, and repeated rows share their fate; an empty table stays so.
    The text is in column text."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)  # of bounded size: CHARS a language

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = classifier(sent.value)
        for b in scratch.bounded(batches):
            found = [classify(t.as_py()) for t in b.column("text")]
            yield b.filter(pa.array([n != UNDETERMINED and m >= NARROW for n, m in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out."""
    docs = scratch.dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return identify(docs, fit(docs))
