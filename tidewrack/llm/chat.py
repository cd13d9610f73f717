"""Chat formatting by columnar byte assembly: segment lengths, offsets and one scatter into a single Arrow buffer.

A turn is written as ``<s>[INST] role`` newline, text, `` [/INST]</s>`` newline. Control strings inside roles and
texts are broken by a backslash after their first character, and backslashes are doubled, so that the written form
holds control strings only where the template put them, and the original can be had back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm import scratch

OPEN, MIDDLE, CLOSE = b"<s>[INST] ", b"\n", b" [/INST]</s>\n"
CONTROL = r"([<\[])(/?s>|/?INST\]|<SYS>>|</SYS>>)"
MASKED_ROLE = "assistant"
#: Code points of text that one assembled block holds at most, unless a single turn is longer.
BLOCK_CHARS = 1 << 22
#: Bytes of a piece that is copied by itself.
LONG = 1 << 16


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.replace_substring(texts, "\\", "\\\\"), CONTROL, r"\1\\\2")


def unescape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"\\(\\?)", r"\1")


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The data, start and length of a large_string column without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at[:-1], np.diff(at)


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copy piece i of ``data`` to ``out`` from ``at[i]`` on: short pieces all at once by their indices, and a long one
    as it is, as indices take sixteen times its room."""
    long = length > LONG
    for to, begin, n in zip(at[long].tolist(), start[long].tolist(), length[long].tolist(), strict=True):
        out[to : to + n] = data[begin : begin + n]
    at, start, length = at[~long], start[~long], length[~long]
    if not len(length):
        return
    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(at, length) + within] = data[np.repeat(start, length) + within]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The formatted turns, as views of one buffer, and where in each its text starts and how long it is, in bytes."""
    roles, texts = escape(roles), escape(texts)
    rows = len(texts)
    (role_data, role_at, role_n), (text_data, text_at, text_n) = _bytes(roles), _bytes(texts)
    length = len(OPEN) + role_n + len(MIDDLE) + text_n + len(CLOSE)
    ends = np.cumsum(length)
    starts = ends - length
    out = np.empty(int(ends[-1]) if rows else 0, np.uint8)
    at = starts
    for fixed, data, begin, n in ((OPEN, role_data, role_at, role_n), (MIDDLE, text_data, text_at, text_n), (CLOSE, None, None, None)):
        out[at[:, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
        at = at + len(fixed)
        if data is not None:
            _scatter(out, at, data, begin, n)
            at = at + n
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    turns = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets), pa.py_buffer(out))
    return turns, len(OPEN) + role_n + len(MIDDLE), text_n


def parse(written: bytes) -> tuple[pa.Array, pa.Array]:
    """Roles and texts read back from formatted turns, one after another, by their control strings alone."""
    turns = written.split(CLOSE)
    if turns.pop() or not all(t.startswith(OPEN) for t in turns):
        raise ValueError("not a sequence of formatted turns")
    # Newlines cannot be in a role (they are spelled out on the way in), so the first one ends it.
    pieces = [t[len(OPEN) :].split(MIDDLE, 1) for t in turns]
    roles, texts = (unescape(pa.array([p[k] for p in pieces], pa.large_binary()).cast(pa.large_string())) for k in (0, 1))
    return pc.replace_substring(pc.replace_substring(roles, "\x01n", "\n"), "\x01s", "\x01"), texts


def _spelled(roles: pa.Array) -> pa.Array:
    """Roles with newlines spelled out, so that the first newline of a turn ends its role."""
    return pc.replace_substring(pc.replace_substring(roles, "\x01", "\x01s"), "\n", "\x01n")


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of bounded size, so that scatter indices stay small."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + BLOCK_CHARS, "right")))
        yield batch.slice(at, end - at)
        at = end


def _formatted(block: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    roles = pc.fill_null(block.column("role").cast(pa.large_string()), "")
    return assemble(_spelled(roles), pc.fill_null(block.column("text").cast(pa.large_string()), ""))


def _in_order(turns: DataFrame) -> DataFrame:
    """All turns of a conversation in one task, in order; what a task holds at a time does not grow with either."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(turns: DataFrame) -> DataFrame:
    """One row a turn: conv_id, turn, formatted and the loss mask's span in it (mask_start, mask_bytes; 0 bytes for
    other roles than the assistant's). A conversation is the concatenation of its rows by (turn, role, text).

    Nulls of role and text are empty; a null conv_id is a conversation of its own; repeated rows are turns.
    """

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scratch.bounded(batches, 1024):
            for block in _blocks(batch):
                formatted, start, n = _formatted(block)
                masked = pc.fill_null(pc.equal(block.column("role"), MASKED_ROLE), False).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([block.column("conv_id"), block.column("turn"), formatted.cast(pa.string()), pa.array(start), pa.array(np.where(masked, n, 0))], ["conv_id", "turn", "formatted", "mask_start", "mask_bytes"])

    return _in_order(turns).mapInArrow(assembled, "conv_id long, turn long, formatted string, mask_start long, mask_bytes long")


def digests(turns: DataFrame) -> DataFrame:
    """One row a conversation, all read back from its formatted turns: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. An empty table gives no rows.

    Turns and their number come from parsing the bytes of a conversation, the loss from its mask over them. The
    digests run over a conversation in one task, by running hash states: even a conversation with most of all turns
    takes no more memory than another.
    """

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, state = object(), None
        done: list[tuple] = []

        def close() -> None:
            if state:
                n, whole, chars, loss, formatted_chars = state
                done.append((now, n, whole.hexdigest(), chars, loss.hexdigest(), formatted_chars))

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done.clear()
            return out

        for batch in scratch.bounded(batches, 1024):
            for block in _blocks(batch):
                formatted, start, n = _formatted(block)
                data, at, size = _bytes(formatted)
                ends = at + size
                masked = pc.fill_null(pc.equal(block.column("role"), MASKED_ROLE), False).to_numpy(zero_copy_only=False)
                convs = block.column("conv_id").to_pylist()
                cuts = [0, *(k for k in range(1, len(convs)) if convs[k] != convs[k - 1]), len(convs)]
                # All that a conversation has in this block is one run of bytes: what is read of it is found there.
                for first, last in zip(cuts, cuts[1:], strict=False):
                    if state is None or convs[first] != now:
                        close()
                        now, state = convs[first], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    written = data[at[first] : ends[last - 1]].tobytes()
                    roles, texts = parse(written)
                    state[0] += len(roles)
                    state[1].update("".join(f"{role}\n{text}\n" for role, text in zip(roles.to_pylist(), texts.to_pylist(), strict=True)).encode())
                    spans = [(int(at[k] - at[first] + start[k]), int(n[k])) for k in range(first, last) if masked[k]]
                    loss = unescape(pa.array([written[a : a + size] for a, size in spans], pa.large_binary()).cast(pa.large_string()))
                    state[2] += pc.sum(pc.utf8_length(loss)).as_py() or 0
                    state[3].update("".join(loss.to_pylist()).encode())
                    state[4] += len(written.decode())
            if done:
                yield rows()
        close()
        if done:
            yield rows()

    return _in_order(turns).mapInArrow(read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, formatted and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return digests(turns.unionByName(extra))
