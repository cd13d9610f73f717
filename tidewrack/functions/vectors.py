"""Vectors as array columns: norms, cosines, and an embedder that hashes terms."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack.functions.text import words

DIMENSIONS = 16


def dot(a: Column, b: Column) -> Column:
    """In double precision over the shorter length."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_b: Column | None = None) -> Column:
    """0 where either vector has no length."""
    lengths = norm(a) * (norm(b) if norm_b is None else norm_b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))


def embed_terms(terms: list[str], dimensions: int = DIMENSIONS) -> list[float]:
    """A unit vector: each term adds 1 or -1, by the parity of its SHA-256's second byte, at the place that the first
    byte gives. No terms give zeros."""
    out = [0.0] * dimensions
    for t in terms:
        digest = hashlib.sha256(t.encode()).digest()
        out[digest[0] % dimensions] += 1.0 if digest[1] % 2 == 0 else -1.0
    length = math.sqrt(sum(x * x for x in out))
    return [x / length for x in out] if length else out


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it: higher-order functions are interpreted,
    and a column that stands in one is evaluated anew for every element."""
    return F.transform(F.array(value), use)[0]


def hash_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """``embed_terms`` of a text's words, as one expression. Words are hashed once, then summed for each place."""
    # The first two bytes of each hash: the upper one gives the place, the lower one's parity the sign.
    heads = F.transform(words(text), lambda t: F.conv(F.substring(F.sha2(t, 256), 1, 4), 16, 10).cast("int"))
    signed = F.transform(heads, lambda h: F.struct((F.shiftright(h, 8) % dimensions).alias("at"), (1 - 2 * (h % 2)).alias("sign")))
    total = lambda terms, d: F.aggregate(F.filter(terms, lambda s: s["at"] == d), F.lit(0), lambda a, s: a + s["sign"]).cast("double")
    sums = _bound(signed, lambda terms: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: total(terms, d)))
    return _bound(sums, lambda v: _bound(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float"))))
