"""Embedders behind one interface, the embedding of pending chunks with a receipt, and the evaluation of retrieval."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.limits import BadArgument
from tidewrack.functions.vectors import DIMENSIONS, embed_terms, hash_embedding, norm
from tidewrack.operators.working import stored


@dataclass(frozen=True)
class Embedder:
    """A provider: its name, model and dimensions, documents as a column expression, and a query on the driver."""

    provider: str
    model: str
    dimensions: int
    documents: Callable[[Column], Column]
    query: Callable[[str], list[float]]

    @property
    def model_id(self) -> str:
        return f"{self.provider}/{self.model}/{self.dimensions}"


def _query_terms(text: str) -> list[float]:
    from tidewrack.operators.search import _terms

    return embed_terms(_terms(text))


EMBEDDERS: dict[str, Embedder] = {"hash": Embedder("hash", "sha256", DIMENSIONS, hash_embedding, _query_terms)}


def register(embedder: Embedder) -> None:
    """Add a provider of one's own; one over a network brings an Arrow UDF as its column expression."""
    EMBEDDERS[embedder.provider] = embedder


def clipped(text: str, embed: Callable[[str], list[float]], too_long: type[Exception], tries: int = 8, share: float = 0.7) -> list[float]:
    """What a remote model makes of a text, of which it gets ever less while it says that it is too long."""
    for _ in range(tries):
        try:
            return embed(text)
        except too_long:
            text = text[: int(len(text) * share)]
    raise BadArgument(f"the text does not fit the model after {tries} cuts")


def unit(vector: Sequence[float]) -> list[float]:
    length = sum(x * x for x in vector) ** 0.5
    return [x / length for x in vector] if length else list(vector)


def embed_pending(chunks: DataFrame, embedded: DataFrame, provider: str = "hash", limit: int = 100, dry_run: bool = False) -> tuple[DataFrame, dict]:
    """Embed the next chunks that a model lacks: the new rows (chunk_id, content_hash, model_id, dimensions, vector,
    vector_norm) and a receipt. ``chunks`` has chunk_id, content_hash, text and tokens; ``embedded`` has those columns.

    A text that the model has embedded under another chunk is taken from there. Running it again embeds what is left."""
    if provider not in EMBEDDERS:
        raise BadArgument(f"no provider {provider}; there are {', '.join(sorted(EMBEDDERS))}")
    if not 0 < limit <= 10_000:
        raise BadArgument("limit is 1 to 10,000")
    model, began = EMBEDDERS[provider], time.time()
    own = embedded.filter(F.col("model_id") == model.model_id)
    pending = chunks.join(own.select("chunk_id"), "chunk_id", "left_anti")
    total = pending.count()
    todo = pending.orderBy("chunk_id").limit(limit)
    known = own.groupBy("content_hash").agg(F.first("vector").alias("known"))
    rows = todo.join(known, "content_hash", "left").withColumn("cached", F.col("known").isNotNull())
    rows = rows.withColumn("vector", F.when(F.col("cached"), F.col("known")).otherwise(model.documents(F.col("text"))))
    receipt = {"provider": provider, "model": model.model, "dimensions": model.dimensions, "pending": total, "dry_run": dry_run}
    made = rows.select("chunk_id", "content_hash", F.lit(model.model_id).alias("model_id"), F.lit(model.dimensions).alias("dimensions"), "vector", norm(F.col("vector")).alias("vector_norm"), "cached", "tokens")
    if dry_run:
        count, tokens = todo.agg(F.count(F.lit(1)), F.sum("tokens")).first()
        return embedded.limit(0), receipt | {"would_embed": count, "tokens": tokens or 0, "status": "planned"}
    made = stored(made)
    count, hits, tokens = made.agg(F.count(F.lit(1)), F.count_if("cached"), F.sum("tokens")).first()
    done = receipt | {"embedded": count, "cache_hits": hits, "tokens": tokens or 0, "status": "done" if count == total else "partial", "seconds": round(time.time() - began, 3)}
    return made.drop("cached", "tokens"), done


@dataclass
class Question:
    """A query with the sessions that should come up, and those that must not."""

    text: str
    wanted: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = ()


def evaluate(ask: Callable[[str], dict], questions: Sequence[Question], k: int = 5) -> dict:
    """Counts over the first ``k`` sessions of each answer: hits among what was wanted, leaks of what was forbidden, lists
    withheld, and modes that were chosen. ``ask`` gives what ``similar`` does."""
    out = {"questions": len(questions), "hits": 0, "wanted": 0, "leaks": 0, "low_confidence": 0, "fallbacks": 0, "modes": {}}
    for q in questions:
        answer = ask(q.text)
        found = {s["session_id"] for s in answer["sessions"][:k]}
        out["hits"] += len(found & set(q.wanted))
        out["wanted"] += len(q.wanted)
        out["leaks"] += len(found & set(q.forbidden))
        out["low_confidence"] += answer["low_confidence"]
        out["fallbacks"] += bool(answer["mode"]["fallback_reasons"])
        mode = answer["mode"]["selected"]
        out["modes"][mode] = out["modes"].get(mode, 0) + 1
    return out
