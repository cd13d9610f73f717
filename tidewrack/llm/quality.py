"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm import scratch

#: The bound of the training sample: labelled rows of each class, and bytes of a row.
ROWS, LONGEST = 600, 1 << 16
#: Bytes of a chunk, of the overlap of two, of a filter and between its places; filters, embedding and hidden units.
CHUNK, OVERLAP, WIDTH, STRIDE = 192, 32, 6, 2
FILTERS, EMBED, HIDDEN = 16, 6, 12
EPOCHS, BATCH, RATE, SEED = 14, 32, 0.01, 7
#: Chunks that are scored at a time.
BLOCK = 512


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def chunks(text: str | None) -> np.ndarray:
    """The text's bytes as rows of ``CHUNK``, each starting ``CHUNK - OVERLAP`` after the one before; every byte is
    in one. The last is filled with zeros, and an empty text is one row of them."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    step = CHUNK - OVERLAP
    rows = max(1, -(-(len(data) - OVERLAP) // step))
    whole = np.zeros((rows - 1) * step + CHUNK, np.uint8)
    whole[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(whole, CHUNK)[::step]


class Network:
    """embedding -> filters -> ReLU -> maximum over a chunk -> mean over the document -> hidden layer -> probability."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        draw = np.random.default_rng(SEED)
        shapes = {"embed": (256, EMBED), "filters": (WIDTH * EMBED, FILTERS), "bias": (FILTERS,), "hidden": (FILTERS, HIDDEN), "hidden_bias": (HIDDEN,), "out": (HIDDEN,), "out_bias": (1,)}
        fresh = {k: (draw.standard_normal(s) * (1.0 if k == "embed" else (2 / s[0]) ** 0.5)).astype(np.float32) if "bias" not in k else np.zeros(s, np.float32) for k, s in shapes.items()}
        self.w = weights or fresh

    def tables(self) -> np.ndarray:
        """For each place in a filter, what each byte adds to each filter."""
        kernel = self.w["filters"].reshape(WIDTH, EMBED, FILTERS)
        return np.einsum("be,jef->jbf", self.w["embed"], kernel).astype(np.float32)

    def pooled(self, rows: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's greatest response in each chunk, and where."""
        places = range(0, CHUNK - WIDTH + 1, STRIDE)
        response = np.zeros((len(rows), len(places), FILTERS), np.float32)
        for j in range(WIDTH):
            response += tables[j][rows[:, j : j + places[-1] + 1 : STRIDE]]
        at = response.argmax(axis=1)
        best = np.take_along_axis(response, at[:, None, :], axis=1)[:, 0] + self.w["bias"]
        return np.maximum(best, 0), at * STRIDE

    def head(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(features @ self.w["hidden"] + self.w["hidden_bias"], 0)
        return hidden, 1 / (1 + np.exp(-np.clip(hidden @ self.w["out"] + self.w["out_bias"], -30, 30)))

    def score(self, text: str | None, tables: np.ndarray) -> float:
        rows = chunks(text)
        total = np.zeros(FILTERS)
        for at in range(0, len(rows), BLOCK):
            total += self.pooled(rows[at : at + BLOCK], tables)[0].sum(axis=0)
        return float(self.head((total / len(rows)).astype(np.float32)[None])[1][0])


def constant(ones: int, of: int) -> Network:
    """A network that gives every text the same probability."""
    net = Network()
    net.w |= {"out": np.zeros(HIDDEN, np.float32), "out_bias": np.array([np.log((ones + 1) / (of - ones + 1))], np.float32)}
    return net


def train(samples: list[tuple[np.ndarray, int]]) -> Network:
    """Fit by Adam on the cross-entropy of whole documents. Only the places that won a maximum carry gradients."""
    net = Network()
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    draw = np.random.default_rng(SEED)
    counts = np.bincount([y for _, y in samples], minlength=2)
    weight = len(samples) / (2 * np.maximum(counts, 1))
    step = 0
    for _ in range(EPOCHS):
        for part in np.array_split(draw.permutation(len(samples)), max(1, len(samples) // BATCH)):
            rows = np.concatenate([samples[i][0] for i in part])
            of = np.repeat(np.arange(len(part)), [len(samples[i][0]) for i in part])
            share = 1 / np.bincount(of)
            y = np.array([samples[i][1] for i in part])
            best, at = net.pooled(rows, net.tables())
            features = np.zeros((len(part), FILTERS), np.float32)
            np.add.at(features, of, best * share[of][:, None])
            hidden, p = net.head(features)
            slope = ((p - y) * weight[y] / len(part)).astype(np.float32)
            g = {"out": hidden.T @ slope, "out_bias": slope.sum(keepdims=True)}
            to_hidden = slope[:, None] * net.w["out"] * (hidden > 0)
            g |= {"hidden": features.T @ to_hidden, "hidden_bias": to_hidden.sum(axis=0)}
            to_best = (to_hidden @ net.w["hidden"].T)[of] * share[of][:, None] * (best > 0)
            seen = rows[np.arange(len(rows))[:, None, None], at[:, :, None] + np.arange(WIDTH)]
            inputs = net.w["embed"][seen].reshape(len(rows), FILTERS, WIDTH * EMBED)
            g |= {"filters": np.einsum("rfk,rf->kf", inputs, to_best), "bias": to_best.sum(axis=0)}
            to_input = (to_best[:, :, None] * net.w["filters"].T[None]).reshape(-1, EMBED)
            g["embed"] = np.zeros_like(net.w["embed"])
            np.add.at(g["embed"], seen.reshape(-1), to_input)
            step += 1
            for k, (m, v) in moments.items():
                grad = g[k] + 1e-4 * net.w[k] * ("bias" not in k)
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                net.w[k] = (net.w[k] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, longest: int = LONGEST) -> Network:
    """The network trained on up to ``rows`` labelled, not held out documents of each class, chosen by a hash of the
    id among those of at most ``longest`` bytes, every chunk of them. An id with several labels has the higher one,
    and one with several texts the first of them by a hash. Without labelled documents of both classes there is
    nothing to tell apart: every text gets the share of label 1 (by the rule of succession; 0.5 without labels)."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("l_id")).agg(F.max("quality").cast("int").alias("quality"))
    # Which texts there are, by hash and length alone: a label may have no document, or one that is too long.
    sizes = docs.select(F.col("doc_id"), F.xxhash64("text").alias("version"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size")).filter(F.col("size") <= longest)
    known = known.join(sizes, F.col("l_id") == F.col("doc_id")).groupBy("l_id", "quality").agg(F.min("version").alias("l_version"))
    known = scratch.table(known, "labelled")
    order = [F.xxhash64("l_id"), F.col("l_id")]
    chosen = known.filter("quality = 0").orderBy(*order).limit(rows).unionByName(known.filter("quality = 1").orderBy(*order).limit(rows))
    chosen = scratch.table(chosen, "chosen")
    same = (F.col("doc_id") == F.col("l_id")) & (F.xxhash64("text") == F.col("l_version"))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), same).groupBy("l_id", "quality").agg(F.first("text").alias("text"))
    found = sorted(sample.collect(), key=lambda r: str(r["l_id"]))  # ``rows`` of each class, of ``longest`` bytes at most
    samples = [(chunks(r["text"]), r["quality"]) for r in found]
    return train(samples) if {y for _, y in samples} == {0, 1} else constant(sum(y for _, y in samples), len(samples))


def score(docs: DataFrame, network: Network) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (the probability of label 1) and predicted.

    Whole texts are scored, chunk by chunk; a null text counts as empty and has the score of an empty chunk. Ids pass
    through, null or repeated. An empty table gives no rows."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    weights = network.w  # some 30 kB, whatever the corpus

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(weights)
        tables = net.tables()
        for b in scratch.bounded(batches):
            p = np.array([net.score(t.as_py(), tables) for t in b.column("text")], np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(scored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels not held out."""
    docs = scratch.dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
