"""Queries without SQL, recomputed row by row in plain Python over the whole test table."""

import hashlib
import re
import zlib

import pytest

from tests.conftest import DATA
from tidewrack.llm import registry


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def text_of(row):
    return row["text"] or ""


def test_shards(spark, docs):
    """Every shard, slot, size and checksum: a row goes where the middle of its bytes falls."""
    rows = sorted(docs.values(), key=lambda r: r["doc_id"])
    sizes = [len(text_of(r).encode()) + 1 for r in rows]
    total, before, slots, want = sum(sizes), 0, {}, {}
    for r, size in zip(rows, sizes, strict=True):
        shard = min(7, (2 * before + size) * 8 // (2 * total))
        slots[shard] = slots.get(shard, -1) + 1
        want[r["doc_id"]] = (size, zlib.crc32(text_of(r).encode()), "bytes", shard, slots[shard], None)
        before += size
    got = registry.QUERIES["op3_shard_bytes"](spark, DATA).collect()
    assert len(got) == len(want) and {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["shard"], r["slot"], r["grown_shard"]) for r in got} == want


def test_chat(spark):
    """All conversations, and the one whose texts are control strings."""
    turns = [(r["conv_id"], r["turn"], r["role"] or "", r["text"] or "") for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()]
    turns += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    turns.sort(key=lambda t: (t[0], t[1], t[2], t[3]))
    want = {}
    for conv in {t[0] for t in turns}:
        own = [(role, text) for c, _, role, text in turns if c == conv]
        loss = "".join(text for role, text in own if role == "assistant")
        want[conv] = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = registry.QUERIES["op5_chat_format"](spark, DATA).collect()
    assert len(got) == len(want) and {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want
    assert all(r["formatted_chars"] >= r["loss_chars"] + 25 * r["n_turns"] for r in got)


def plain_spans(text):
    """The base kinds by walking over the text, a character at a time."""
    value, access, hexa = (frozenset(a) for a in ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef"))

    def run(at, letters):
        end = at
        while end < len(text) and text[end] in letters:
            end += 1
        return end

    def assign(at):
        low = "".join(c.lower() if c.isascii() else c for c in text[at : at + 8])
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(word):
                end = at + len(word)
                end += text[end : end + 1] in ("'", '"') and end < len(text)
                end = run(end, " ")
                if text[end : end + 1] not in (":", "=") or end == len(text):
                    continue
                end = run(end + 1, " ")
                end += text[end : end + 1] in ("'", '"') and end < len(text)
                last = run(end, value)
                if last > end:
                    return last, last - end >= 6
        return None

    found, at = [], 0
    while at < len(text):
        if text[at] in "pPsStTaA" and (hit := assign(at)):
            if hit[1]:
                found.append(("assign", at, hit[0]))
            at = hit[0]
        else:
            at += 1
    for kind, head, letters, least in (("access", "AKIA", access, 20), ("hex", "", hexa, 24)):
        at = 0
        while at < len(text):
            if text.startswith(head, at) and text[at] in letters and run(at + len(head), letters) > at + len(head):
                end = run(at + len(head), letters)
                if end - at >= least:
                    found.append((kind, at, end))
                at = end
            else:
                at += 1
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secrets(spark):
    folder = "/root/testdata/sf0.01"  # the smallest table that holds any
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in registry.QUERIES["op7_secret_scan"](spark, folder).collect()}
    assert got.keys() == docs.keys()
    seen = 0
    for i, row in docs.items():
        want = plain_spans(text_of(row))
        seen += bool(want)
        joined = [f"{k}:{a}:{b}" for k, a, b in want]
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(k == kind for k, *_ in want) for kind in ("assign", "access", "hex"))
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        spans = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert [s for s in spans if not s.startswith("entropy:")] == joined and len(spans) == len(set(spans))
    assert seen


def test_media(spark, docs):
    """What is read back is the payload; the stored form is a GIF of the payload's size and the features are its own."""
    got = {r["doc_id"]: r for r in registry.QUERIES["op9_gif_media"](spark, DATA).collect()}
    assert got.keys() == docs.keys()
    for i, row in docs.items():
        data = text_of(row).encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        frames = -(-len(payload) // 65536)
        grey = ".".join(str(sum(64 * k <= b < 64 * k + 64 for b in payload)) for k in range(4))
        assert r["feature"] == f"frames={frames};ms={100 * frames};histogram={grey}"
    same = {}
    for i, row in docs.items():
        same.setdefault(text_of(row), set()).add((got[i]["media_bytes"], got[i]["media_sha256"], got[i]["feature"]))
    assert all(len(v) == 1 for v in same.values())


def test_held_out(spark, docs):
    """Languages and scores of rows that were held out, and the columns that say which those are."""
    lang = registry.QUERIES["op4_language_id"](spark, DATA).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in lang)
    assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", text_of(docs[r["doc_id"]]))) for r in lang)
    held = [r for r in lang if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)
    quality = registry.QUERIES["op10_quality"](spark, DATA).collect()
    assert len(quality) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in quality)
