"""Transcript stores: which files each holds, read with Spark, parsed on executors, flattened to relations."""

from __future__ import annotations

import hashlib
import json
import sqlite3
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions.text import redact
from tidewrack.sources import parsers


@dataclass(frozen=True)
class Store:
    """``glob`` picks the session files below a root; ``sibling`` rewrites a file's path (a Java pattern and its
    replacement) to that of the file kept beside it."""

    name: str
    glob: str
    parse: parsers.Parser
    sibling_glob: str | None = None
    sibling: tuple[str, str] | None = None
    only: str | None = None


STORES: dict[str, Store] = {
    s.name: s
    for s in (
        Store("claude-code", "*.jsonl", parsers.claude_code),
        Store("cursor", "*.jsonl", parsers.cursor),
        Store("codex", "*.jsonl", parsers.codex, only=r"/rollout-[^/]*\.jsonl$|/[^/]*\.jsonl$"),
        Store("gemini", "*.jsonl", parsers.gemini),
        Store("qwen", "*.jsonl", parsers.qwen),
        Store("cline", "*.messages.json", parsers.cline, "*.json", (r"\.messages\.json$", ".json")),
        Store("copilot", "events.jsonl", parsers.copilot),
        Store("pi", "*.jsonl", parsers.pi),
        Store("droid", "*.jsonl", parsers.droid, "*.settings.json", (r"\.jsonl$", ".settings.json")),
        Store("vibe", "messages.jsonl", parsers.vibe, "meta.json", (r"messages\.jsonl$", "meta.json")),
    )
}

TOOLS = "array<struct<idx: int, name: string, args_json: string, args_hash: string, output: string, exit_code: int, call_id: string>>"
PARSED = f"""path string, error string, content_hash string, id string, source string, external_id string, parent_session_id string,
agent_type string, project_path string, git_branch string, model string, title string, started_at long, ended_at long,
input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, reasoning_tokens long,
messages array<struct<turn: long, role: string, text: string, ts: long, tools: {TOOLS}>>"""
FIELDS = [f.strip().split(" ")[0] for f in PARSED.split("messages array")[0].split(",") if f.strip()]
COUNTERS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "reasoning_tokens")


def register(name: str, glob: str, parse: parsers.Parser) -> None:
    """Add a store of one's own: a name, the files it holds and a function of (text, path, sibling)."""
    STORES[name] = Store(name, glob, parse)


def files(spark: SparkSession, root: str, glob: str, since: str | None = None) -> DataFrame:
    """(path, mtime, size, content) of the files below ``root``; content is read only where it is asked for."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    reader = reader.option("modifiedAfter", since) if since else reader
    return reader.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("content"))


def row_of(session: parsers.Session, path: str, digest: str) -> dict:
    return {"path": path, "error": None, "content_hash": digest} | {f: getattr(session, f) for f in FIELDS[3:14]} | {c: session.usage.get(c) for c in COUNTERS} | {"messages": session.messages}


def parse_files(texts: DataFrame, parse: parsers.Parser) -> DataFrame:
    """Canonical sessions, one row a file that has one. A file that cannot be parsed gives a row with its error and
    does not stop the others. ``texts`` has path, content and sibling."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content, sibling in pdf[["path", "content", "sibling"]].itertuples(index=False):
                digest = hashlib.sha256("\0".join((content or "", sibling or "")).encode("utf-8", "surrogatepass")).hexdigest()
                try:
                    session = parse(content or "", path, sibling)
                    if session:
                        out.append(row_of(session, path, digest))
                except Exception as bad:  # one bad file is reported, whatever is wrong with it
                    out.append({"path": path, "error": f"{type(bad).__name__}: {bad}"[:500], "content_hash": digest})
            made = pd.DataFrame(out, columns=[*FIELDS, "messages"]).astype(object)
            yield made.where(made.notna(), None)

    return texts.select("path", "content", "sibling").mapInPandas(run, PARSED)


def listing(spark: SparkSession, name: str, root: str) -> DataFrame:
    """(path, mtime, size) of a store's session files: the later time and the sizes together where a file is kept
    beside one, so that a change of either shows."""
    store = STORES[name]
    found = files(spark, root, store.glob).select("path", "mtime", "size").filter("size > 0")
    found = found.filter(F.col("path").rlike(store.only)) if store.only else found
    if not store.sibling:
        return found
    beside = files(spark, root, store.sibling_glob).select(F.col("path").alias("s_path"), F.col("mtime").alias("s_mtime"), F.col("size").alias("s_size"))
    both = found.join(beside, F.regexp_replace("path", *store.sibling) == F.col("s_path"), "left")
    return both.select("path", F.greatest("mtime", "s_mtime").alias("mtime"), (F.col("size") + F.coalesce("s_size", F.lit(0))).alias("size"))


def read_store(spark: SparkSession, name: str, root: str, since: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """The sessions of a store. ``known`` (path, mtime, size; see ``listing``) takes out files that have not changed."""
    if name not in STORES:
        raise ValueError(f"no store {name}; there are {', '.join(sorted(STORES))}")
    store = STORES[name]
    found = files(spark, root, store.glob, since)
    if store.only:
        found = found.filter(F.col("path").rlike(store.only))
    found = found.filter("size > 0")
    if known is not None:
        fresh = listing(spark, name, root).join(known.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")
        found = found.join(fresh.select("path"), "path", "left_semi")
    if store.sibling:
        beside = files(spark, root, store.sibling_glob).select(F.col("path").alias("s_path"), F.col("content").alias("sibling"))
        found = found.join(beside, F.regexp_replace("path", *store.sibling) == F.col("s_path"), "left")
    else:
        found = found.withColumn("sibling", F.lit(None).cast("string"))
    return parse_files(found, store.parse)


def read_opencode(spark: SparkSession, root: str) -> DataFrame:
    """The file tree of sessions, messages and parts, each scanned once and met by session id."""

    def docs(kind: str) -> DataFrame:
        key = "$.id" if kind == "session" else "$.sessionID"
        return files(spark, f"{root.rstrip('/')}/{kind}", "*.json").select(F.get_json_object("content", key).alias("sid"), "path", F.col("content").alias(kind))

    parts = docs("part").groupBy("sid").agg(F.collect_list("part").alias("parts"))
    messages = docs("message").groupBy("sid").agg(F.collect_list("message").alias("messages"))
    joined = docs("session").join(messages, "sid").join(parts, "sid", "left")
    packed = joined.select("path", F.to_json(F.struct("session", "messages", "parts")).alias("content"), F.lit(None).cast("string").alias("sibling"))

    def parse(content: str, path: str, sibling: str | None) -> parsers.Session | None:
        doc = json.loads(content)
        return parsers.opencode(json.loads(doc["session"]), [json.loads(m) for m in doc.get("messages") or []], [json.loads(p) for p in doc.get("parts") or []])

    return parse_files(packed, parse)


def read_database(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Sessions of a live store that keeps one database file on this machine (opencode-db, kilo, goose): ids are
    listed, and each session is read and parsed by itself. The file is opened read-only on the driver."""
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    con.row_factory = sqlite3.Row
    out = []
    try:
        if name == "goose":
            for s in con.execute("SELECT * FROM sessions ORDER BY id"):
                s = dict(s)
                session = parsers.Session(f"goose--{s['id']}", "goose", str(s["id"]), project_path=s.get("working_dir"), title=s.get("description") or s.get("name"), started_at=parsers.epoch(s.get("created_at")))
                session.add_usage(input_tokens=s.get("accumulated_input_tokens"), output_tokens=s.get("accumulated_output_tokens"))
                for m in con.execute("SELECT role, content_json, created_timestamp FROM messages WHERE session_id = ? ORDER BY id", (s["id"],)):
                    parsers.blocks(session, m["role"], json.loads(m["content_json"] or "[]"), parsers.epoch(m["created_timestamp"]))
                out.append(session)
        else:
            source, prefix = ("kilo", "kilo") if name == "kilo" else ("opencode", "oc")
            for s in con.execute("SELECT * FROM session ORDER BY id"):
                s = dict(s)
                doc = json.loads(s["data"]) if s.get("data") else {"id": s["id"], "directory": s.get("directory"), "title": s.get("title"), "parentID": s.get("parent_id"), "time": {"created": s.get("time_created"), "updated": s.get("time_updated")}}
                load = lambda sql, sid=s["id"]: [{**json.loads(r["data"]), **{k: r[k] for k in r.keys() if k != "data"}} for r in con.execute(sql, (sid,))]  # noqa: E731, SIM118
                found = parsers.opencode(doc, load("SELECT id, data FROM message WHERE session_id = ?"), load("SELECT id, message_id AS messageID, data FROM part WHERE session_id = ?"), source, prefix)
                out += [found] if found else []
    finally:
        con.close()
    rows = [row_of(s, path, hashlib.sha256(json.dumps(s.messages, sort_keys=True).encode()).hexdigest()) for s in out if s.messages]
    order = [*FIELDS, "messages"]
    return spark.createDataFrame([tuple(r.get(c) for c in order) for r in rows], PARSED)


def workflows(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(run_id, manifest_json) and (run_id, seq, line_json) of workflow manifests and journals below ``root``."""
    found = files(spark, root, "wf_*.json").filter(F.col("path").rlike(r"/workflows/wf_[^/]*\.json$"))
    runs = found.select(F.coalesce(F.get_json_object("content", "$.runId"), F.regexp_extract("path", r"/wf_([^/]*)\.json$", 1)).alias("run_id"), F.col("content").alias("manifest_json"))
    journal = files(spark, root, "journal.jsonl").filter(F.col("path").rlike(r"/subagents/workflows/[^/]+/journal\.jsonl$"))
    lines = journal.select(F.regexp_extract("path", r"/workflows/([^/]+)/journal\.jsonl$", 1).alias("run_id"), F.posexplode(F.split("content", "\n")).alias("seq", "line_json"))
    return runs, lines.filter("trim(line_json) <> ''")


def redacted(parsed: DataFrame) -> DataFrame:
    """Parsed sessions without secrets in what is kept as text: titles, messages and the outputs of tools. Arguments
    stay as they are, as facts are read from them and redact what they keep."""
    tools = lambda m: F.transform(m["tools"], lambda t: t.withField("output", redact(t["output"])))
    messages = F.transform("messages", lambda m: m.withField("text", redact(m["text"])).withField("tools", tools(m)))
    return parsed.withColumn("title", redact(F.col("title"))).withColumn("messages", messages)


def relations(parsed: DataFrame) -> dict[str, DataFrame]:
    """sessions, messages and tool_calls of parsed sessions, secrets taken out; a session that two files hold is taken
    from the file with the greatest path."""
    good = redacted(parsed.filter("error is null"))
    latest = good.groupBy("id").agg(F.max("path").alias("path"))
    good = good.join(latest, ["id", "path"], "left_semi")
    sessions = good.drop("messages", "error").withColumn("duration_s", F.col("ended_at") - F.col("started_at"))
    turns = good.select(F.col("id").alias("session_id"), F.explode("messages").alias("m"))
    messages = turns.select("session_id", "m.turn", "m.role", "m.ts", "m.text", F.size("m.tools").cast("long").alias("tools"))
    calls = turns.select("session_id", F.col("m.turn").alias("turn"), F.col("m.ts").alias("ts"), F.explode("m.tools").alias("c"))
    calls = calls.select("session_id", "turn", "c.idx", "c.name", "c.args_hash", "c.args_json", F.substring("c.output", 1, 500).alias("output_preview"), F.octet_length("c.output").alias("output_bytes"), "c.exit_code", F.lit(None).cast("long").alias("duration_ms"), "ts", F.col("c.call_id").alias("call_id"))
    outputs = turns.select("session_id", F.col("m.turn").alias("turn"), F.explode("m.tools").alias("c")).filter("c.output is not null").select("session_id", "turn", "c.idx", "c.output")
    return {"tool_outputs": outputs, "messages": messages, "tool_calls": calls, "sessions": sessions}


SessionFilter = Callable[[DataFrame], DataFrame]


def allowed(sessions: DataFrame, parts: list[str]) -> DataFrame:
    """Sessions whose project holds one of ``parts``; without parts all pass, with parts a null project does not."""
    wanted = [p.strip() for p in parts if p.strip()]
    return sessions if not wanted else sessions.filter(F.exists(F.array(*map(F.lit, wanted)), lambda p: F.contains(F.col("project_path"), p)))
