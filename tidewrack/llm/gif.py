"""GIF as a column: LZW code streams, palettes, disposal and transparency, timed frames and colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm import scratch

WIDTH, MAX_ROWS, DELAY_CS = 64, 1024, 10
#: Pixels of a canvas or a frame beyond which a GIF counts as unreadable: its header alone would claim the memory.
MAX_PIXELS = 1 << 26
#: Codes that fit between two clear codes: one more would need an entry beyond 12 bits.
RUN = 3838
LAST = 257 + RUN


@dataclass
class Frame:
    """A frame as shown: the whole canvas, how long it stays, and the frame's own rectangle (left, top, width, height)."""

    rgb: np.ndarray
    delay_ms: int
    box: tuple[int, int, int, int]


def _widths(count: int, bits: int) -> np.ndarray:
    """Code widths after a clear code: the table grows by one entry with each code but the first."""
    entries = (1 << bits) + 2 + np.maximum(np.arange(count) - 1, 0)
    return np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, bits + 1, 12)


def _places(widths: np.ndarray) -> np.ndarray:
    """Which of the 16 bits of each code are written."""
    return np.arange(16) < widths[:, None]


_ENCODE_WIDTHS = _widths(RUN + 2, 8)
#: The bits of a run's codes. The clear code that begins a run has the width that the run before ended with.
_FIRST_PLACES, _LATER_PLACES = (_places(np.concatenate([[clear], _ENCODE_WIDTHS])) for clear in (9, _ENCODE_WIDTHS[RUN]))
#: What follows a code in the table, under the code above a symbol; entries are codes in that form, 0 where there is
#: none. Tables are a megabyte of places and are emptied place by place, so they are kept for the next stream.
_SHIFTED = [code << 8 for code in range(LAST + 1)]
_TABLES: list[list[int]] = []
#: Code widths by symbol bits, for as many codes as fill any table; after that they have 12 bits.
FULL = 4200
_WIDTHS = {bits: _widths(FULL, bits) for bits in range(2, 9)}


def lzw_encode(data: bytes) -> bytes:
    """Bytes to an LZW code stream of 8-bit symbols."""
    table = _TABLES.pop() if _TABLES else [0] * ((LAST + 1) << 8)
    entries = _SHIFTED[258 : 258 + RUN]
    out: list[np.ndarray] = []
    symbols = iter(data)
    prefix = _SHIFTED[next(symbols, 257)]
    more = bool(data)
    while more:
        run, used = [256 << 8], []
        put, use = run.append, used.append
        for entry in entries:
            for symbol in symbols:
                key = prefix + symbol
                if longer := table[key]:
                    prefix = longer
                else:
                    break
            else:
                more = False
                break
            put(prefix)
            use(key)
            table[key] = entry
            prefix = _SHIFTED[symbol]
        for key in used:
            table[key] = 0
        if more:
            out.append(_bits(run, not out))
    _TABLES.append(table)
    # The last run ends with the last prefix, if there are any data, and the end code.
    last = [*run, prefix, 257 << 8] if data else [256 << 8, 257 << 8]
    out.append(_bits(last, not out))
    return np.packbits(np.concatenate(out), bitorder="little").tobytes()


def _bits(run: list[int], first: bool) -> np.ndarray:
    """The bits of a run's codes, each in its width."""
    codes = (np.array(run, np.int32) >> 8).astype("<u2")
    each = np.unpackbits(codes.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return each[(_FIRST_PLACES if first else _LATER_PLACES)[: len(run)]]


def lzw_decode(data: bytes, bits: int, size: int) -> bytes:
    """An LZW code stream to at most ``size`` symbols of ``bits`` bits.

    Code widths depend only on the distance from the last clear code, so a whole run of codes is unpacked at once.
    A stream that ends early or holds a code that cannot be there gives what came before it.
    """
    clear, end = 1 << bits, (1 << bits) + 1
    # A code of 12 bits at most lies in three bytes.
    stream = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int32)
    length = 8 * len(data)
    literal = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    made = at = 0

    def unpack(most: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Up to ``most`` codes from here, where each ends, and how many belong to this run. Code j, from 0, may
        name j - 1 entries and the one it is about to make."""
        width = _WIDTHS[bits][:most]
        if most > FULL:
            width = np.concatenate([width, np.full(most - FULL, 12)])
        stop = np.cumsum(width)
        count = int(np.searchsorted(stop, length - at, "right"))
        width, stop = width[:count], stop[:count]
        start = at + stop - width
        byte = start >> 3
        taken = stream[byte] | stream[byte + 1] << 8 | stream[byte + 2] << 16
        codes = taken >> (start & 7) & (1 << width) - 1
        halts = np.nonzero((codes == clear) | (codes == end) | (codes > clear + 1 + np.arange(count)))[0]
        return codes, stop, int(halts[0]) if len(halts) else count

    while made < size:
        codes, stop, last = unpack(min(FULL, (length - at) // (bits + 1) + 1))
        if last == FULL:
            codes, stop, last = unpack((length - at) // (bits + 1) + 1)
        table = literal.copy()
        add = table.append
        pieces = []
        put = pieces.append
        before = b""
        for code in codes[:last].tolist():
            if before:
                try:
                    entry = table[code]
                except IndexError:  # the one entry that is being made
                    entry = before + before[:1]
                add(before + entry[:1])
                before = entry
            else:
                before = table[code]
            put(before)
        out.append(b"".join(pieces))
        made += len(out[-1])
        if last == len(codes) or codes[last] != clear:
            break
        at += int(stop[last])
    return b"".join(out)[:size]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode(payload: bytes, width: int = WIDTH, max_rows: int = MAX_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A payload (a positive multiple of ``width`` bytes) as a grey GIF: one byte a pixel, a new frame every
    ``max_rows`` rows."""
    rows = len(payload) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, max_rows), 0xF7, 0, 0), bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))]
    for at in range(0, rows, max_rows):
        part = payload[at * width : (at + max_rows) * width]
        out.append(b"\x21\xf9\x04\x04" + struct.pack("<H", delay_cs) + b"\0\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08" + _blocks(lzw_encode(part)))
    return b"".join([*out, b"\x3b"])


def decode(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF, composed on its canvas, one at a time.

    Local and global palettes, interlaced rows, transparent pixels (which leave the canvas as it is), and disposal:
    keep, clear the frame's rectangle, or put back what was there. Pixels beyond a truncated stream stay as they are.
    What is no GIF, ends in a header, names a code size that there is not or claims more than ``MAX_PIXELS`` is a
    ValueError; frames ahead of that have been given by then.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        yield from _frames(data)
    except (IndexError, struct.error) as cut:
        raise ValueError("the file ends in a header") from cut


def _frames(data: bytes) -> Iterator[Frame]:
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at = 13
    if width * height > MAX_PIXELS:
        raise ValueError("too many pixels")

    def palette(flag: int) -> np.ndarray:
        nonlocal at
        n = 2 << (flag & 7)
        colours = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return colours

    def sub_blocks() -> bytes:
        nonlocal at
        parts = []
        while at < len(data) and (n := data[at]):
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(parts)

    shared = palette(flags) if flags & 0x80 else np.zeros((256, 3), np.uint8)
    canvas = np.zeros((height, width, 3), np.uint8)
    delay, disposal, transparent = 0, 0, -1
    while at < len(data):
        kind = data[at]
        at += 1
        if kind == 0x21:
            label = data[at]
            at += 1
            body = sub_blocks()
            if label == 0xF9 and len(body) >= 4:
                delay, disposal = 10 * (body[1] | body[2] << 8), body[0] >> 2 & 7
                transparent = body[3] if body[0] & 1 else -1
        elif kind == 0x2C:
            left, top, w, h, flag = struct.unpack_from("<HHHHB", data, at)
            at += 9
            colours = palette(flag) if flag & 0x80 else shared
            bits = data[at]
            at += 1
            if not 2 <= bits <= 8 or w * h > MAX_PIXELS:
                raise ValueError("no such code size, or too many pixels")
            pixels = np.frombuffer(lzw_decode(sub_blocks(), bits, w * h), np.uint8)
            index = np.full(w * h, -1, np.int16)
            index[: len(pixels)] = pixels
            index = index.reshape(h, w)
            if flag & 0x40:
                order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
                straight = np.empty_like(index)
                straight[order] = index
                index = straight
            before = canvas.copy() if disposal == 3 else None
            index = index[: max(0, height - top), : max(0, width - left)]
            drawn = (index >= 0) & (index != transparent) & (index < len(colours))
            region = canvas[top : top + index.shape[0], left : left + index.shape[1]]
            if drawn.all():
                region[:] = colours[index]
            else:
                region[drawn] = colours[index[drawn]]
            yield Frame(canvas.copy(), delay, (left, top, w, h))
            if disposal == 2:
                region[:] = 0
            elif before is not None:
                canvas = before
            delay, disposal, transparent = 0, 0, -1
        else:
            break


def histogram(frame: Frame, bins: int = 4) -> list[int]:
    """Pixels of a frame's own rectangle by colour, ``bins`` steps a channel: bins ** 3 counts."""
    left, top, w, h = frame.box
    part = frame.rgb[top : top + h, left : left + w].reshape(-1, 3)
    step = np.arange(256) * bins // 256
    return np.bincount((step * bins**2)[part[:, 0]] + (step * bins)[part[:, 1]] + step[part[:, 2]], minlength=bins**3).tolist()


def padded(text: str | None) -> tuple[bytes, int]:
    """The text's bytes with zeros up to a positive multiple of 64, and how many it had."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % 64 or (0 if data else 64)), len(data)


FRAMES = pa.schema([("frame", pa.int64()), ("delay_ms", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("rgb", pa.binary()), ("histogram", pa.list_(pa.int64()))])
FRAMES_DDL = "frame long, delay_ms long, width long, height long, rgb binary, histogram array<long>"


def decode_column(media: DataFrame, id_col: str = "doc_id", media_col: str = "gif") -> DataFrame:
    """GIF bytes to timed frames, one row each: id, frame (from 0), delay_ms, width, height, rgb (the canvas) and
    histogram (colours of the frame's rectangle).

    A null value, and one that is unreadable from the start, has one row with a null frame; one that breaks off later
    has the frames ahead of that. A task holds one frame at a time. Null and repeated ids pass through, an empty
    table gives no rows, and other columns are ignored."""
    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))

    def read(data: bytes | None) -> Iterator[dict]:
        shown = 0
        try:
            for f in decode(data or b""):
                yield {"frame": shown, "delay_ms": f.delay_ms, "width": f.rgb.shape[1], "height": f.rgb.shape[0], "rgb": f.rgb.tobytes(), "histogram": histogram(f)}
                shown += 1
        except ValueError:
            pass
        if not shown:
            yield dict.fromkeys(FRAMES.names)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                for frame in read(b.column("media")[at].as_py()):
                    columns = [pa.array([frame[f.name]], f.type) for f in FRAMES]
                    yield pa.RecordBatch.from_arrays([b.column("id").slice(at, 1), *columns], ["id", *FRAMES.names])

    return rows.mapInArrow(decoded, f"id {rows.schema['id'].dataType.simpleString()}, {FRAMES_DDL}").withColumnRenamed("id", id_col)


def store(text: str | None) -> dict:
    """A text's payload as a GIF, read back frame by frame, and what was found."""
    payload, n = padded(text)
    media = encode(payload)
    digest, tail, size, frames, delays = hashlib.sha256(), b"", 0, 0, 0
    counts = np.zeros(64, np.int64)
    for frame in decode(media):
        left, top, w, h = frame.box
        part = frame.rgb[top : top + h, left : left + w, 0].tobytes()
        digest.update(part)
        tail = (tail + part)[-64:]
        size, frames, delays = size + len(part), frames + 1, delays + frame.delay_ms
        counts += histogram(frame)
    grey = ".".join(str(c) for c in counts[[0, 21, 42, 63]].tolist())
    return {"n_bytes": n, "payload_bytes": size, "payload_sha256": digest.hexdigest(), "tail_crc32": zlib.crc32(tail), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": f"frames={frames};ms={delays};histogram={grey}", "frames": frames, "duration_ms": delays, "histogram": counts.tolist()}


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the digests of ``store``, and frames, duration_ms and histogram (64 colour
    bins over all frames); all of payload and features are read back from the stored bytes. Null texts are empty; equal texts give equal values; an empty table gives no rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("frames", pa.int64()), ("duration_ms", pa.int64()), ("histogram", pa.list_(pa.int64()))]

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scratch.bounded(batches, 32):
            found = [store(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([f[k] for f in found], kind) for k, kind in fields)], ["doc_id", *(k for k, _ in fields)])

    ddl = ", ".join(f"{k} {'string' if kind == pa.string() else 'array<long>' if pa.types.is_list(kind) else 'long'}" for k, kind in fields)
    return rows.mapInArrow(stored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {ddl}")


def op9_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as GIFs and read back."""
    return media_digests(scratch.dealt(spark.read.parquet(f"{sf_dir}/documents.parquet")))
