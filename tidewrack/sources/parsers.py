"""Transcript formats: the text of one session file (and its sibling) to one canonical session.

Each parser takes (text, path, sibling text) and gives a ``Session`` or None where there is nothing to keep. They run
on executors, one file at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

Json = dict[str, Any]


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


@dataclass
class Session:
    id: str
    source: str
    external_id: str
    parent_session_id: str | None = None
    agent_type: str | None = None
    project_path: str | None = None
    git_branch: str | None = None
    model: str | None = None
    title: str | None = None
    started_at: int | None = None
    ended_at: int | None = None
    usage: Json = field(default_factory=dict)
    messages: list[Json] = field(default_factory=list)
    calls: dict[str, Json] = field(default_factory=dict)

    def say(self, role: str, text: str | None, ts: int | None = None) -> Json | None:
        """Add a message; thinking is a message of its own."""
        if not text and role in ("user", "thinking", "system"):
            return None
        self.messages.append({"turn": len(self.messages) + 1, "role": role, "text": text or "", "ts": ts, "tools": []})
        self.seen(ts)
        return self.messages[-1]

    def seen(self, ts: int | None) -> None:
        if ts is not None:
            self.started_at = ts if self.started_at is None else min(self.started_at, ts)
            self.ended_at = ts if self.ended_at is None else max(self.ended_at, ts)

    def call(self, message: Json, name: str, args: Any, call_id: str | None = None) -> Json:
        text = args if isinstance(args, str) and _is_json(args) else json.dumps(args, sort_keys=True, ensure_ascii=False)
        made = {"idx": len(message["tools"]), "name": name, "args_json": text, "args_hash": hashlib.sha256(text.encode()).hexdigest(), "output": None, "exit_code": None, "call_id": call_id}
        message["tools"].append(made)
        if call_id:
            self.calls[call_id] = made
        return made

    def result(self, call_id: str | None, output: str | None, failed: bool | None = None, exit_code: int | None = None) -> None:
        if made := self.calls.get(call_id or ""):
            made["output"] = output
            made["exit_code"] = exit_code if exit_code is not None else (None if failed is None else int(failed))

    def assistant(self, ts: int | None) -> Json:
        """The assistant message that a tool call belongs to: the last one, or an empty new one."""
        last = self.messages[-1] if self.messages else None
        return last if last and last["role"] == "assistant" else self.say("assistant", "", ts)

    def add_usage(self, **counts: int | None) -> None:
        for k, n in counts.items():
            if isinstance(n, int):
                if n < 0:
                    raise ValueError(f"negative {k}")
                self.usage[k] = self.usage.get(k, 0) + n


def epoch(value: Any) -> int | None:
    """Seconds of an ISO time or of a number of milliseconds."""
    if isinstance(value, (int, float)):
        return int(value // 1000) if value > 1e11 else int(value)
    if isinstance(value, str) and value:
        try:
            at = datetime.fromisoformat(value.replace("Z", "+00:00"))
        except ValueError:
            return None
        return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp())
    return None


def lines(text: str) -> Iterator[Json]:
    """The objects of a JSONL file; lines that are none are passed over."""
    for line in text.splitlines():
        try:
            found = json.loads(line)
        except ValueError:
            continue
        if isinstance(found, dict):
            yield found


def stem(path: str) -> str:
    return re.sub(r"\.(messages\.json|jsonl?|json)$", "", path.rstrip("/").rpartition("/")[2])


def flat(content: Any) -> str:
    """Text of a content that may be a string, a block or a list of blocks."""
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        return "\n".join(t for t in map(flat, content) if t)
    if isinstance(content, dict):
        return next((v for k in ("text", "content", "output") if isinstance(v := content.get(k), str)), "")
    return ""


# Fixed values. Lines and wrappers that are no conversation.
DROPPED_LINES = {"progress", "file-history-snapshot", "queue-operation", "permission-mode", "attachment", "last-prompt", "system"}
DROPPED_WRAPPERS = re.compile(r"^\s*<(local-command-|command-|bash-input>|bash-stdout>|bash-stderr>|persisted-output>|system-reminder>|task-notification>|retrieval>)")


def blocks(session: Session, role: str, content: Any, ts: int | None) -> None:
    """Messages of the block format: text, thinking, tool_use and tool_result."""
    if isinstance(content, str):
        content = [{"type": "text", "text": content}]
    text = "\n".join(b.get("text", "") for b in content or [] if b.get("type") in ("text", "input_text", "output_text"))
    for b in content or []:
        if b.get("type") == "thinking":
            session.say("thinking", b.get("thinking") or b.get("text"), ts)
        elif b.get("type") == "tool_result":
            session.result(b.get("tool_use_id"), flat(b.get("content")), bool(b.get("is_error")))
    uses = [b for b in content or [] if b.get("type") == "tool_use"]
    if role == "user" and (not text or DROPPED_WRAPPERS.match(text)):
        return
    if text or uses:
        message = session.say(role, text, ts)
        for b in uses:
            session.call(message, b.get("name", ""), b.get("input", {}), b.get("id"))


def claude_code(text: str, path: str, sibling: str | None = None, source: str = "claude-code", prefix: str = "cc") -> Session | None:
    session, counted = Session("", source, stem(path)), set()
    for e in lines(text):
        message = e.get("message")
        if e.get("type") in DROPPED_LINES or not isinstance(message, dict):
            continue
        session.external_id = e.get("sessionId") or session.external_id
        session.project_path = session.project_path or e.get("cwd")
        session.git_branch = session.git_branch or e.get("gitBranch")
        ts, role = epoch(e.get("timestamp")), message.get("role", e.get("type"))
        session.model = message.get("model") or session.model
        # Several lines may repeat one message with the same counters: they count once.
        key = message.get("id") or e.get("uuid")
        if (usage := message.get("usage")) and key not in counted:
            counted.add(key)
            session.add_usage(input_tokens=usage.get("input_tokens"), output_tokens=usage.get("output_tokens"), cache_read_tokens=usage.get("cache_read_input_tokens"), cache_creation_tokens=usage.get("cache_creation_input_tokens"))
        blocks(session, role, message.get("content"), ts)
    if "/subagents/" in path:
        session.agent_type, session.parent_session_id = "subagent", f"{prefix}--{session.external_id}"
        session.external_id = stem(path)
    session.id = f"{prefix}--{session.external_id}"
    return session if session.messages else None


def cursor(text: str, path: str, sibling: str | None = None) -> Session | None:
    session = Session(f"cu--{stem(path)}", "cursor", stem(path))
    if m := re.search(r"/([^/]+)/subagents/", path):
        session.parent_session_id, session.agent_type = f"cu--{m[1]}", "subagent"
    for e in lines(text):
        message = e.get("message") or {}
        content = [b for b in message.get("content") or [] if isinstance(b, dict)]
        raw = "\n".join(b.get("text", "") for b in content if b.get("type") == "text")
        if m := re.search(r"<timestamp>([^<]*)</timestamp>", raw):
            session.seen(epoch(m[1].strip()))
        if e.get("role") == "user":
            asked = re.search(r"<user_query>\s*(.*?)\s*</user_query>", raw, re.S)
            session.say("user", asked[1] if asked else re.sub(r"<([a-z_]+)>.*?</\1>", "", raw, flags=re.S).strip())
        else:
            blocks(session, "assistant", [b for b in content if b.get("type") in ("text", "tool_use") and b.get("text", "x")], None)
    return session if session.messages else None


def codex(text: str, path: str, sibling: str | None = None) -> Session | None:
    session = Session("", "codex", stem(path))
    for e in lines(text):
        p, ts = e.get("payload") or {}, epoch(e.get("timestamp"))
        kind = p.get("type")
        if e.get("type") == "session_meta":
            session.external_id = p.get("id") or session.external_id
            session.project_path, session.started_at = p.get("cwd"), epoch(p.get("timestamp"))
            sub = p.get("source", {}).get("subagent") if isinstance(p.get("source"), dict) else None
            spawn = sub.get("thread_spawn", sub) if isinstance(sub, dict) else {}
            parent = p.get("parent_thread_id") or spawn.get("parent_thread_id")
            session.parent_session_id = f"cx--{parent}" if parent else None
            guardian = sub == "guardian" or (isinstance(sub, dict) and "guardian" in (sub.get("other"), sub.get("kind"), *sub))
            session.agent_type = "guardian" if guardian else p.get("agent_path") or spawn.get("agent_path") or p.get("agent_role") or spawn.get("agent_role")
        elif e.get("type") == "turn_context":
            session.model, session.project_path = p.get("model") or session.model, session.project_path or p.get("cwd")
        elif e.get("type") == "event_msg" and kind == "token_count":
            total = ((p.get("info") or {}).get("total_token_usage")) or {}
            if any(isinstance(n, int) and n < 0 for n in total.values()):
                raise ValueError("negative token counter")
            # Counters are running totals: the last one stands.
            session.usage |= {k: total[s] for k, s in (("input_tokens", "input_tokens"), ("output_tokens", "output_tokens"), ("cache_read_tokens", "cached_input_tokens"), ("reasoning_tokens", "reasoning_output_tokens")) if s in total}
        elif e.get("type") == "response_item":
            if kind == "message" and p.get("role") in ("user", "assistant"):
                session.say(p["role"], flat(p.get("content")), ts)
            elif kind == "reasoning":
                session.say("thinking", flat(p.get("summary")), ts)
            elif kind in ("function_call", "custom_tool_call"):
                session.call(session.assistant(ts), p.get("name", ""), p.get("arguments", p.get("input", "")), p.get("call_id"))
            elif kind in ("function_call_output", "custom_tool_call_output"):
                out = flat(p.get("output"))
                code = re.search(r"(?:exited with code|\"exit_code\":)\s*(-?\d+)", out)
                session.result(p.get("call_id"), out, exit_code=int(code[1]) if code else None)
    session.id = f"cx--{session.external_id}"
    return session if session.messages else None


def _gemini_parts(e: Json) -> tuple[str, list[Json]]:
    parts = e.get("content") if isinstance(e.get("content"), list) else [{"text": e.get("content") or ""}]
    return "\n".join(p.get("text", "") for p in parts if isinstance(p, dict) and p.get("text")), e.get("toolCalls") or []


def gemini(text: str, path: str, sibling: str | None = None) -> Session | None:
    session, kept = Session("", "gemini", stem(path)), {}
    for e in lines(text):
        if "sessionId" in e and "type" not in e:
            session.external_id = e["sessionId"]
            session.project_path = next(iter(e.get("directories") or []), None)
            session.agent_type = "subagent" if e.get("kind") == "subagent" else None
            session.seen(epoch(e.get("startTime")))
        elif isinstance(e.get("$set"), dict) and isinstance(e["$set"].get("messages"), list):
            kept = {m.get("id"): m for m in e["$set"]["messages"]}
        elif isinstance(e.get("$rewindTo"), str):
            order = list(kept)
            kept = {k: kept[k] for k in order[: order.index(e["$rewindTo"])]} if e["$rewindTo"] in kept else kept
        elif e.get("id"):
            kept[e["id"]] = e  # the last revision of a message stands, in its first place
    for e in kept.values():
        ts, (body, calls) = epoch(e.get("timestamp")), _gemini_parts(e)
        if e.get("type") == "user":
            session.say("user", body, ts)
            continue
        session.model = e.get("model") or session.model
        if t := e.get("tokens"):
            session.add_usage(input_tokens=t.get("input"), output_tokens=t.get("output"), cache_read_tokens=t.get("cached"), reasoning_tokens=t.get("thoughts"))
        for thought in e.get("thoughts") or []:
            session.say("thinking", thought.get("description") or thought.get("subject"), ts)
        if body or calls:
            message = session.say("assistant", body, ts)
            for c in calls:
                session.call(message, c.get("name", ""), c.get("args", {}), c.get("id"))
                session.result(c.get("id"), flat(c.get("resultDisplay") or c.get("result")), c.get("status") == "error")
    session.id = f"gm--{session.external_id}"
    return session if session.messages else None


def qwen(text: str, path: str, sibling: str | None = None) -> Session | None:
    session = Session("", "qwen", stem(path))
    for e in lines(text):
        session.external_id = e.get("sessionId") or session.external_id
        session.project_path, session.git_branch = session.project_path or e.get("cwd"), session.git_branch or e.get("gitBranch")
        session.model = e.get("model") or session.model
        ts, parts = epoch(e.get("timestamp")), (e.get("message") or {}).get("parts") or []
        if u := e.get("usageMetadata"):
            session.add_usage(input_tokens=u.get("promptTokenCount"), output_tokens=u.get("candidatesTokenCount"), cache_read_tokens=u.get("cachedContentTokenCount"), reasoning_tokens=u.get("thoughtsTokenCount"))
        for p in parts:
            if p.get("thought"):
                session.say("thinking", p.get("text"), ts)
        body = "\n".join(p["text"] for p in parts if p.get("text") and not p.get("thought"))
        uses = [p["functionCall"] for p in parts if p.get("functionCall")]
        if e.get("type") == "tool_result":
            for p in parts:
                if r := p.get("functionResponse"):
                    session.result(r.get("id"), flat((r.get("response") or {}).get("output")), (e.get("toolCallResult") or {}).get("status") == "error")
        elif body or uses:
            message = session.say("user" if e.get("type") == "user" else "assistant", body, ts)
            for u in uses:
                session.call(message, u.get("name", ""), u.get("args", {}), u.get("id"))
    session.id = f"qw--{session.external_id}"
    return session if session.messages else None


def cline(text: str, path: str, sibling: str | None = None) -> Session | None:
    doc, meta = json.loads(text), json.loads(sibling) if sibling else {}
    name = doc.get("sessionId") or stem(path)
    session = Session(f"cline--{name}", "cline", name, project_path=meta.get("cwd"), model=meta.get("model"), started_at=epoch(meta.get("started_at")), title=(meta.get("metadata") or {}).get("title"))
    if "__" in name:
        session.parent_session_id, session.agent_type = f"cline--{name.split('__')[0]}", doc.get("agent")
    for m in doc.get("messages") or []:
        session.model = (m.get("modelInfo") or {}).get("id") or session.model
        if u := m.get("metrics"):
            session.add_usage(input_tokens=u.get("inputTokens"), output_tokens=u.get("outputTokens"), cache_read_tokens=u.get("cacheReadTokens"), cache_creation_tokens=u.get("cacheWriteTokens"))
        content = m.get("content")
        if m.get("role") == "user" and isinstance(content, list):
            content = [{**b, "text": re.sub(r"</?user_input[^>]*>", "", b.get("text", ""))} if b.get("type") == "text" else b for b in content]
        blocks(session, m.get("role", "user"), content, epoch(m.get("ts")))
    return session if session.messages else None


def copilot(text: str, path: str, sibling: str | None = None) -> Session | None:
    session = Session("", "copilot", path.rstrip("/").split("/")[-2] if "/" in path else stem(path))
    for e in lines(text):
        d, ts, kind = e.get("data") or {}, epoch(e.get("timestamp")), e.get("type")
        if kind == "session.start":
            session.external_id, context = d.get("sessionId") or session.external_id, d.get("context") or {}
            session.project_path, session.git_branch = context.get("cwd"), context.get("branch")
            session.seen(epoch(d.get("startTime")))
        elif kind == "session.model_change":
            session.model = d.get("newModel") or session.model
        elif kind == "user.message":
            session.say("user", d.get("content"), ts)
        elif kind == "assistant.message":
            session.model = d.get("model") or session.model
            if d.get("content") or d.get("toolRequests"):
                message = session.say("assistant", d.get("content"), ts)
                for c in d.get("toolRequests") or []:
                    session.call(message, c.get("name", ""), c.get("arguments", {}), c.get("toolCallId"))
        elif kind == "tool.execution_complete":
            out = flat(d.get("result"))
            code = re.search(r"exit code (-?\d+)", out)
            session.result(d.get("toolCallId"), out, not d.get("success", True), int(code[1]) if code else None)
        elif kind == "session.shutdown":
            for m in (d.get("modelMetrics") or {}).values():
                u = m.get("usage") or {}
                session.add_usage(input_tokens=u.get("inputTokens"), output_tokens=u.get("outputTokens"), cache_read_tokens=u.get("cacheReadTokens"), cache_creation_tokens=u.get("cacheWriteTokens"), reasoning_tokens=u.get("reasoningTokens"))
    session.id = f"copilot--{session.external_id}"
    return session if session.messages else None


def pi(text: str, path: str, sibling: str | None = None) -> Session | None:
    session = Session("", "pi", stem(path))
    for e in lines(text):
        ts, m = epoch(e.get("timestamp")), e.get("message") or {}
        if e.get("type") == "session":
            session.external_id, session.project_path = e.get("id") or session.external_id, e.get("cwd")
            session.seen(ts)
        elif e.get("type") == "session_info":
            session.title = e.get("name") or session.title
        elif e.get("type") == "message" and m.get("role") == "toolResult":
            session.result(m.get("toolCallId"), flat(m.get("content")), bool(m.get("isError")))
        elif e.get("type") == "message":
            session.model = m.get("model") or session.model
            u = m.get("usage") or {}
            session.add_usage(input_tokens=u.get("input"), output_tokens=u.get("output"), cache_read_tokens=u.get("cacheRead"), cache_creation_tokens=u.get("cacheWrite"))
            content = m.get("content")
            if isinstance(content, list):
                content = [{"type": "tool_use", "id": b.get("id"), "name": b.get("name"), "input": b.get("arguments", {})} if b.get("type") == "toolCall" else b for b in content]
            blocks(session, m.get("role", "user"), content, ts)
    session.id = f"pi--{session.external_id}"
    return session if session.messages else None


def droid(text: str, path: str, sibling: str | None = None) -> Session | None:
    session, settings = Session("", "droid", stem(path)), json.loads(sibling) if sibling else {}
    session.model = settings.get("model")
    for e in lines(text):
        if e.get("type") == "session_start":
            session.external_id, session.title, session.project_path = e.get("id") or session.external_id, e.get("title"), e.get("cwd")
        elif e.get("type") == "message":
            m = e.get("message") or {}
            session.model = session.model or m.get("modelId")
            blocks(session, m.get("role", "user"), m.get("content"), epoch(e.get("timestamp")))
    u = settings.get("tokenUsage") or {}
    session.add_usage(input_tokens=u.get("inputTokens"), output_tokens=u.get("outputTokens"), cache_read_tokens=u.get("cacheReadTokens"), cache_creation_tokens=u.get("cacheCreationTokens"), reasoning_tokens=u.get("thinkingTokens"))
    session.id = f"droid--{session.external_id}"
    return session if session.messages else None


def vibe(text: str, path: str, sibling: str | None = None) -> Session | None:
    meta = json.loads(sibling) if sibling else {}
    name = meta.get("session_id") or path.rstrip("/").split("/")[-2]
    config, stats = meta.get("config") or {}, meta.get("stats") or {}
    active = (config.get("models") or {}).get(config.get("active_model")) or {}
    session = Session(f"vibe--{name}", "vibe", name, project_path=(meta.get("environment") or {}).get("working_directory"), git_branch=meta.get("git_branch"), title=meta.get("title"), model=active.get("name") or config.get("active_model"), started_at=epoch(meta.get("start_time")), ended_at=epoch(meta.get("end_time")))
    session.add_usage(input_tokens=stats.get("session_prompt_tokens"), output_tokens=stats.get("session_completion_tokens"), cache_read_tokens=stats.get("session_cached_tokens"))
    for m in lines(text):
        if m.get("role") == "tool":
            out = (m.get("tool_result") or {}).get("output") or {}
            session.result(m.get("tool_call_id"), flat(m.get("content")), exit_code=out.get("returncode") if isinstance(out, dict) else None)
            continue
        if m.get("injected"):
            continue
        session.say("thinking", m.get("reasoning_content"))
        if m.get("content") or m.get("tool_calls"):
            message = session.say(m.get("role", "assistant"), m.get("content"))
            for c in m.get("tool_calls") or [] if message else []:
                session.call(message, (c.get("function") or {}).get("name", ""), (c.get("function") or {}).get("arguments", ""), c.get("id"))
    return session if session.messages else None


def opencode(session_doc: Json, messages: list[Json], parts: list[Json], source: str = "opencode", prefix: str = "oc") -> Session | None:
    """A session from its three kinds of records, ordered by creation and id."""
    name, times = session_doc.get("id", ""), session_doc.get("time") or {}
    session = Session(f"{prefix}--{name}", source, name, project_path=session_doc.get("directory"), title=session_doc.get("title"), started_at=epoch(times.get("created")), ended_at=epoch(times.get("updated")))
    if session_doc.get("parentID"):
        session.parent_session_id, session.agent_type = f"{prefix}--{session_doc['parentID']}", "subagent"
    by_message: dict[str, list[Json]] = {}
    for p in sorted(parts, key=lambda p: p.get("id", "")):
        by_message.setdefault(p.get("messageID", ""), []).append(p)
    for m in sorted(messages, key=lambda m: ((m.get("time") or {}).get("created") or 0, m.get("id", ""))):
        own, ts = by_message.get(m.get("id", ""), []), epoch((m.get("time") or {}).get("created"))
        session.model = m.get("modelID") or session.model
        t = m.get("tokens") or {}
        session.add_usage(input_tokens=t.get("input"), output_tokens=t.get("output"), reasoning_tokens=t.get("reasoning"), cache_read_tokens=(t.get("cache") or {}).get("read"), cache_creation_tokens=(t.get("cache") or {}).get("write"))
        for p in own:
            if p.get("type") == "reasoning":
                session.say("thinking", p.get("text"), ts)
        body, tools = "\n".join(p["text"] for p in own if p.get("type") == "text" and p.get("text")), [p for p in own if p.get("type") == "tool"]
        if body or tools:
            message = session.say(m.get("role", "assistant"), body, ts)
            for p in tools if message else []:
                state = p.get("state") or {}
                session.call(message, p.get("tool", ""), state.get("input", {}), p.get("callID"))
                session.result(p.get("callID"), state.get("output") or state.get("error"), state.get("status") == "error")
    return session if session.messages else None


Parser = Callable[[str, str, str | None], Session | None]
