"""Secret scans: known forms, and sliding-window Shannon entropy per character class with an allow list."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm import scratch

Span = tuple[str, int, int]

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")


@dataclass(frozen=True)
class CharClass:
    """A run of ``chars`` is suspect where a window of ``width`` has at least ``bits`` of entropy a character, a
    digit and a letter, and (``mixed``) both cases."""

    name: str
    chars: re.Pattern[str]
    width: int
    bits: float
    mixed: bool


#: Random characters of these alphabets give about 3.4, 3.9 and 4.1 bits over such windows, words 3.6 at most.
CLASSES = (
    CharClass("hexadecimal", re.compile(r"[0-9A-Fa-f]{20,}"), 20, 3.0, False),
    CharClass("upper", re.compile(r"[0-9A-Z]{20,}"), 20, 3.6, False),
    CharClass("base64", re.compile(r"[A-Za-z0-9+/_-]{20,}"), 20, 3.75, True),
)
#: What is known to be no secret is cut out of a candidate, and the rest of it is looked at: stand-ins for a key, and
#: UUIDs that stand alone.
ALLOWED = (
    re.compile(r"(?i)example|sample|dummy|placeholder|changeme|redacted|x{5,}"),
    re.compile(r"(?i)(?<![0-9a-z])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-z])"),
)
#: A candidate right behind this is the data of a picture or the like.
EMBEDDED = re.compile(r"(?i)data:[a-z0-9.+/-]{1,60};base64,$")

_C_LOG_C = [0.0] + [c * math.log2(c) for c in range(1, 65)]


def windows(text: str, kind: CharClass) -> Iterator[tuple[int, int]]:
    """Merged (start, end) of the windows of ``text`` over the limits of ``kind``.

    With counts c of the characters of a window of w, the entropy is log2 w - sum(c log2 c) / w; moving on by one
    character changes two counts, and the sum by their terms alone. A window in half of which each character follows
    on the one before, as in a counter or an alphabet, is no secret.
    """
    w, counts = kind.width, dict.fromkeys(text, 0)
    total, digits, upper, lower, steps = 0.0, 0, 0, 0, 0
    most = w * (math.log2(w) - kind.bits)
    open_at = end = -1
    for at, new in enumerate(text):
        for ch, step in ((new, 1), (text[at - w], -1)) if at >= w else ((new, 1),):
            total += _C_LOG_C[counts[ch] + step] - _C_LOG_C[counts[ch]]
            counts[ch] += step
            digits, upper, lower = digits + step * ch.isdigit(), upper + step * ch.isupper(), lower + step * ch.islower()
        steps += at > 0 and ord(new) - ord(text[at - 1]) == 1
        steps -= at >= w and ord(text[at - w + 1]) - ord(text[at - w]) == 1
        if at >= w - 1 and total <= most + 1e-9 and digits and (upper and lower if kind.mixed else upper or lower) and 2 * steps < w:
            start = at - w + 1
            if open_at >= 0 and start > end:
                yield open_at, end
                open_at = -1
            open_at = start if open_at < 0 else open_at
            end = at + 1
    if open_at >= 0:
        yield open_at, end


def base_spans(text: str) -> list[Span]:
    """Assignments, access keys and hex runs in code points, in order."""
    low = text.lower()
    found: list[Span] = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _unknown(text: str, allowed: tuple[re.Pattern[str], ...]) -> Iterator[tuple[int, int]]:
    """What of ``text`` lies outside of all matches of the allow list."""
    at = 0
    for a, b in sorted(m.span() for p in allowed for m in p.finditer(text)):
        if a > at:
            yield at, a
        at = max(at, b)
    if at < len(text):
        yield at, len(text)


def entropy_spans(text: str, classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[re.Pattern[str], ...] = ALLOWED) -> list[Span]:
    """High-entropy stretches of candidate strings that the allow list does not know, overlapping ones merged."""
    found: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        if not any(map(str.isdigit, m[0])) or EMBEDDED.search(text[max(0, m.start() - 80) : m.start()]):
            continue
        for first, last in _unknown(m[0], allowed):
            for kind in classes:
                for run in kind.chars.finditer(m[0], first, last):
                    at = m.start() + run.start()
                    found += [(at + a, at + b) for a, b in windows(run[0], kind)]
    merged: list[list[int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [("entropy", a, b) for a, b in merged]


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """The base spans of a whole text, and all spans: entropy ones are added where no base span holds them."""
    base = base_spans(text or "")
    added = [s for s in entropy_spans(text or "") if not any(b[1] <= s[1] and s[2] <= b[2] for b in base)]
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256 and spans.

    Spans are kind:start:end in code points, the end exclusive, by start and kind. A null text is empty and has no
    spans; ids pass through, null or repeated. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scratch.bounded(batches):
            found = [scan(t.as_py()) for t in b.column("text")]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS[:3]]
            digest = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, digest, pa.array([_joined(s) for _, s in found], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return rows.mapInArrow(scanned, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return find_secrets(scratch.dealt(spark.read.parquet(f"{sf_dir}/documents.parquet")))
