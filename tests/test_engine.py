"""The command surface on a few seeded sessions."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewrack.functions.limits import BadArgument
from tidewrack.functions.vectors import embed_terms
from tidewrack.operators import embedding, retrieval, sessions, upkeep
from tidewrack.plans.engine import Engine

S = "id string, source string, external_id string, project_path string, parent_session_id string, agent_type string, model string, title string, started_at long, turn_count long, tool_call_count long"


@pytest.fixture(scope="module")
def engine(spark):
    rows = [("cc--aaaa-1", "claude-code", "aaaa-1", "/p/x", None, None, "m", "One", 100, 3, 1), ("cc--aaaa-2", "claude-code", "aaaa-2", "/p/x/sub", "cc--aaaa-1", "worker", "m", "Two", 200, 2, 0), ("cx--bbbb", "codex", "bbbb", "/p/xy", None, None, "n", None, None, 1, 0)]
    messages = [("cc--aaaa-1", 1, "user", "fix the parser bug", 1, 0), ("cc--aaaa-1", 2, "assistant", "done with parser", 2, 1), ("cc--aaaa-2", 1, "user", "write docs", 3, 0), ("cx--bbbb", 1, "user", "parser tests", 4, 0)]
    calls = [("cc--aaaa-1", 2, 0, "Bash", '{"command": "ls"}', "h", "out", 0)]
    chunks = [("cc--aaaa-1", 0, embed_terms(["parser", "bug"])), ("cc--aaaa-2", 1, embed_terms(["docs"])), ("cx--bbbb", 2, embed_terms(["parser", "tests"]))]
    return Engine(
        spark,
        {
            "sessions": spark.createDataFrame(rows, S),
            "messages": spark.createDataFrame(messages, "session_id string, turn long, role string, text string, ts long, tools long"),
            "tool_calls": spark.createDataFrame(calls, "session_id string, turn long, idx int, name string, args_json string, args_hash string, output_preview string, exit_code int"),
            "chunks": spark.createDataFrame(chunks, "session_id string, chunk long, embedding array<double>"),
        },
    )


def test_lists(engine):
    assert [r["id"] for r in engine.sessions().data] == ["cc--aaaa-2", "cc--aaaa-1", "cx--bbbb"]
    assert [r["id"] for r in engine.sessions(project="/P/X/").data] == ["cc--aaaa-2"]
    assert [r["id"] for r in engine.sessions(has_subagents=True).data] == ["cc--aaaa-1"]
    assert [r["id"] for r in engine.sessions(root_only=True, min_turns=2, where="model = 'm' OR 1 = 0").data] == ["cc--aaaa-1"]
    assert engine.timeline("month").data[0]["sessions"] == 2 and engine.timeline("year").status == "error"
    assert engine.top("nothing").exit_code == 2


def test_session(engine):
    find = lambda name: sessions.resolve(engine.r["sessions"], name)
    assert find("cc--aaaa-1") == "cc--aaaa-1" and find("aaaa-2") == "cc--aaaa-2" and find("bbb") is None and find("cx--b") == "cx--bbbb"
    with pytest.raises(sessions.AmbiguousId):
        find("aaaa")
    got = engine.session("aaaa-1", tail=1)
    assert [m["turn"] for m in got.data["messages"]] == [2] and len(got.data["tool_calls"]) == 1
    assert engine.session("aaaa-1", head=1, tail=1).status == "error" and engine.session("zzzz").status == "error"
    assert json.loads(got.line())["command"] == "session"
    text = sessions.markdown(engine.r["sessions"], engine.r["messages"], engine.r["tool_calls"]).filter("id = 'cc--aaaa-1'").first()["markdown"]
    assert text.startswith("# One\n\nclaude-code · m · /p/x") and "- `Bash`" in text and text.index("fix the") < text.index("- `Bash`")
    with pytest.raises(BadArgument):
        sessions.turns(engine.r["messages"], "x", head=1, between=(1, 2))


def test_projects(engine):
    known = engine.r["sessions"]
    assert known.filter(sessions.in_project("/p/x")).count() == 2
    assert [sessions.infer_project(known, c).first()[0] for c in ("/p/x", "/p/x/sub/deep", "/p")] == ["/p/x", "/p/x/sub", "/p/x"]


def test_search(engine):
    got = engine.fts("parser NOT tests").data
    assert {(r["session_id"], r["turn"]) for r in got} == {("cc--aaaa-1", 1), ("cc--aaaa-1", 2)} and "[parser]" in got[0]["snippet"]
    assert engine.fts("foo/bar").warnings == ["QUERY_SANITIZED"]
    assert {r["session_id"] for r in engine.similar("parser").data["sessions"]} == {"cc--aaaa-1", "cx--bbbb"}
    auto = engine.similar("parser tests", exclude=["cc--aaaa-2"], project="/p/xy").data
    assert auto["mode"]["selected"] == "hybrid" and auto["sessions"][0]["session_id"] == "cx--bbbb" and auto["sessions"][0]["snippets"]
    assert engine.similar("parser").data["mode"]["fallback_reasons"] == ["missing_current_session_exclusion", "missing_project_scope"]
    first = next(r for r in engine.similar("parser", mode="fts").data["sessions"] if r["session_id"] == "cc--aaaa-1")
    assert first["matched_turns"] == 2 and sorted(s["turn"] for s in first["snippets"]) == [1, 2] and "[parser]" in first["snippets"][0]["snippet"]
    assert engine.similar("parser", mode="fts", since="1970-01-01T00:05:00Z").data["sessions"] == []
    # Four words or more, of which no session shows two: nothing is better than noise.
    low = engine.similar("parser of quantum flux capacitors", mode="fts")
    assert low.data["low_confidence"] and low.data["sessions"] == [] and low.warnings == ["low_confidence_matches"]
    assert not engine.similar("fix the parser bug", mode="fts").data["low_confidence"]
    assert engine.similar("docs", mode="embedding").data["sessions"][0]["session_id"] == "cc--aaaa-2"


def test_similar_past_a_hot_session(engine, spark):
    """A session with more good chunks than the lexical pool holds does not push the others out."""
    hot = [("cc--aaaa-1", i, embed_terms(["parser"])) for i in range(200)] + [("cc--aaaa-2", 200, embed_terms(["parser", "docs"])), ("cx--bbbb", 201, embed_terms(["parser", "tests", "more"]))]
    crowded = Engine(spark, engine.r | {"chunks": spark.createDataFrame(hot, "session_id string, chunk long, embedding array<double>")}, register=False)
    assert [r["session_id"] for r in crowded.similar("parser", mode="embedding", n=3).data["sessions"]] == ["cc--aaaa-1", "cc--aaaa-2", "cx--bbbb"]
    fused = {r["session_id"]: r["semantic_rank"] for r in crowded.similar("parser", mode="hybrid", n=3).data["sessions"]}
    assert fused == {"cc--aaaa-1": 0, "cc--aaaa-2": 1, "cx--bbbb": 2}


def test_semantic_ranks(spark):
    scores = [None if i % 50 == 0 else round(math.cos(i), 2) for i in range(300)] + [1.0, 1.0000000000000002, -1.0]
    got = retrieval.ranked(spark.createDataFrame(list(enumerate(scores)), "session_id long, score double")).orderBy("semantic_rank").collect()
    order = sorted(range(len(scores)), key=lambda i: (scores[i] is None, -(scores[i] or 0), i))
    assert [(r["session_id"], r["semantic_rank"]) for r in got] == [(s, n) for n, s in enumerate(order)]


def test_best_chunk(spark):
    """In the order of chunks, a later one needs 0.02 more, or the same within 0.02 and more of the query's words."""
    def fold(chunks):
        best = None
        for chunk, score, text in chunks:
            mask = [t in text for t in ("red", "blue", "green")]
            if best and not (score > best[1] + 0.02 or (score >= best[1] - 0.02 and sum(mask) > sum(best[2]))):
                if best[3] < 3:
                    best = (best[0], best[1], [a or b for a, b in zip(best[2], mask, strict=True)], best[3] + 1)
                continue
            best = (chunk, score, mask, 1)
        return best[:2]

    draw = random.Random(3)
    rows = [(s, c, round(0.5 + draw.choice([0, 0.005, 0.01, 0.015, 0.02, 0.03]), 3), " ".join(draw.sample(["red", "blue", "green", "x"], draw.randrange(4)))) for s in range(40) for c in range(draw.randrange(1, 9))]
    frame = spark.createDataFrame(rows, "session_id long, chunk long, score double, preview string")
    got = {r["session_id"]: (r["chunk"], r["score"]) for r in retrieval.best_per_session(frame, retrieval.covered(F.col("preview"), ["red", "blue", "green"])).collect()}
    assert got == {s: fold([r[1:] for r in rows if r[0] == s]) for s in {r[0] for r in rows}}
    shown = spark.createDataFrame([("New session - 1", "x", "text"), (None, "Continuation prompt", "tool_summary"), ("t", "x", "tool_summary")], "title string, preview string, kind string")
    scores = lambda q: [round(r[0], 4) for r in shown.select(retrieval.adjusted(F.lit(1.0), F.col("kind"), F.col("title"), F.col("preview"), q)).collect()]
    assert scores("colours") == [0.35, 0.2275, 0.65] and scores("run git-log") == [0.35, 0.35, 1.0]


def test_injected_chunks(spark):
    chunks = spark.createDataFrame([("a", 0, 1, 2), ("a", 1, 3, 3), ("b", 0, 1, 9), ("c", 0, None, None)], "session_id string, chunk long, start_turn long, end_turn long")
    messages = spark.createDataFrame([("a", 3, "  <system-reminder> x"), ("a", 2, "plain"), ("b", 9, "Stop hook feedback: y"), ("c", 1, "<skill>")], "session_id string, turn long, text string")
    assert sorted((r["session_id"], r["chunk"]) for r in retrieval.without_injected(chunks, messages).collect()) == [("a", 0), ("c", 0)]


def test_commands(spark, engine):
    """Lists by their options, totals, and workflow runs."""
    facts = {
        "user_corrections": spark.createDataFrame([("cc--aaaa-1", "undo", 0, 1), ("cx--bbbb", "undo", 1, 2), ("cx--bbbb", "style", 0, 3)], "session_id string, kind string, followed_by_revert int, preceding_tool_calls int"),
        "skills_invoked": spark.createDataFrame([("cc--aaaa-1", "a"), ("cc--aaaa-2", "b"), ("cc--aaaa-2", "b")], "session_id string, skill_name string"),
        "web_fetches": spark.createDataFrame([("cc--aaaa-1", "ex.org", "fetch"), ("cc--aaaa-1", "other.org", "fetch")], "session_id string, domain string, kind string"),
        "shell_commands": spark.createDataFrame([("cc--aaaa-1", 1, "git", "git x", 1), ("cc--aaaa-1", 2, "ls", "ls", 0)], "session_id string, turn long, cmd_head string, cmd_full string, exit_code int"),
        "tool_errors": spark.createDataFrame([("cc--aaaa-1", "Bash", "timeout"), ("cc--aaaa-1", "Read", "parse")], "session_id string, tool_name string, error_category string"),
        "subagent_invocations": spark.createDataFrame([("cc--aaaa-1", "explore", "cx--bbbb"), ("cc--aaaa-1", None, None)], "parent_session_id string, subagent_type string, child_session_id string"),
        "prompt_templates": spark.createDataFrame([("h", "do <n>", 4, "[]"), ("g", "go", 9, "[]")], "hash string, template string, count long, example_session_ids string"),
        "workflow_runs": spark.createDataFrame([("r1", "w", "done", 3, 10, 5, 100, 7, "cc--aaaa-1"), ("r2", "w", "failed", 9, 90, 1, 50, 8, None)], "run_id string, workflow_name string, status string, agent_count long, total_tokens long, total_tool_calls long, duration_ms long, started_at long, orchestrating_session_id string"),
        "workflow_run_phases": spark.createDataFrame([("r1", 0, "t", "d")], "run_id string, phase_index int, title string, detail string"),
        "workflow_agents": spark.createDataFrame([("r1", "x", 0, 5, "é" * 3000), ("r1", "y", 0, 4, None)], "run_id string, agent_id string, phase_index long, started_at long, result string"),
    }
    e = Engine(spark, engine.r | facts, register=False)
    lists = lambda what, key, **o: [r[key] for r in e.top(what, **o).data]
    assert lists("corrections", "kind") == ["undo", "style"] and lists("corrections", "source", by="source") == ["codex", "claude-code"] and lists("corrections", "project_path", by="project") == ["/p/xy", "/p/x"]
    assert e.top("corrections", by="moon").exit_code == 2 and e.top("sequences", n_gram=5).exit_code == 2
    assert lists("skills", "skill_name") == ["b", "a"] and lists("skills", "skill_name", until="1970-01-01T00:02:30Z") == ["a"]
    assert lists("web", "domain", domain="ex") == ["ex.org"] and lists("commands", "cmd_head", head="git") == ["git"] and lists("errors", "tool_name", tool="Read") == ["Read"]
    assert lists("subagents", "dispatches") == [1, 1] and lists("subagents", "dispatches", since="1970-01-01T00:05:00Z") == [] and lists("prompts", "hash") == ["g", "h"]
    stats = e.stats().data
    assert stats["totals"]["sessions"] == 3 and stats["totals"]["tool_errors"] == 2 and [r["source"] for r in stats["by_source"]] == ["claude-code", "codex"] and stats["date_range"]["earliest"] == 100
    assert [r["run_id"] for r in e.workflows().data] == ["r2", "r1"] and [r["run_id"] for r in e.workflows(sort="tools", status="done").data] == ["r1"] and e.workflows(sort="name").exit_code == 2
    run = e.workflow("r1").data
    assert run["run"]["project_path"] == "/p/x" and [a["agent_id"] for a in run["agents"]] == ["y", "x"] and run["agents"][1]["result_bytes"] == 6000 and len(run["agents"][1]["result"]) == 2000
    assert e.workflow("r9").status == "error"
    # A dispatched session belongs to the family of the one that dispatched it.
    assert {r[0] for r in e._family(["cx--bbbb"]).collect()} == {"cx--bbbb", "cc--aaaa-1", "cc--aaaa-2"}
    assert e.sessions(where="reflect('a', 'b') = 'c'").exit_code == 2


def test_embedding(spark, engine):
    """Pending chunks are embedded once, from the cache where the text is known, and the receipt says what was done."""
    chunks = spark.createDataFrame([(f"c{i}", f"h{i % 4}", f"words of text {i % 4}", 10) for i in range(6)], "chunk_id string, content_hash string, text string, tokens long")
    none = spark.createDataFrame([], "chunk_id string, content_hash string, model_id string, dimensions int, vector array<float>, vector_norm double")
    e = Engine(spark, engine.r | {"chunk_texts": chunks, "embeddings": none}, register=False)
    assert e.embed(dry_run=True).data | {"pending": 6, "would_embed": 6, "tokens": 60, "status": "planned"} == e.embed(dry_run=True).data
    first = e.embed(n=4)
    assert first.data["embedded"] == 4 and first.data["cache_hits"] == 0 and first.status == "partial" and first.exit_code == 1
    rest = e.embed(n=100)
    assert rest.data["embedded"] == 2 and rest.data["cache_hits"] == 2 and rest.data["status"] == "done" and rest.exit_code == 0
    assert e.embed().data["embedded"] == 0 and e.embed("moon").exit_code == 2 and e.embed(n=20_000).exit_code == 2
    rows = {r["chunk_id"]: (list(r["vector"]), round(r["vector_norm"], 6)) for r in e.r["embeddings"].collect()}
    assert len(rows) == 6 and rows["c0"] == rows["c4"] and rows["c0"][1] == 1.0
    assert rows["c1"][0] == pytest.approx(embedding.EMBEDDERS["hash"].query("words of text 1"))

    class TooLong(Exception):
        pass

    def remote(text):
        if len(text) > 30:
            raise TooLong
        return [float(len(text)), 0.0]

    assert embedding.clipped("x" * 100, remote, TooLong) == [23.0, 0.0] and embedding.unit([3.0, 4.0]) == [0.6, 0.8]
    with pytest.raises(BadArgument):
        embedding.clipped("x" * 10**6, remote, TooLong)
    asked = [embedding.Question("parser", ("cc--aaaa-1", "cx--bbbb"), ("cc--aaaa-2",)), embedding.Question("parser of quantum flux capacitors")]
    got = embedding.evaluate(lambda t: engine.similar(t, mode="fts").data, asked)
    assert got == {"questions": 2, "hits": 2, "wanted": 2, "leaks": 0, "low_confidence": 1, "fallbacks": 0, "modes": {"fts": 2}}


def test_contract(spark, engine):
    answer = engine.sessions(n=2)
    line = json.loads(answer.line())
    assert line["pagination"] == {"limit": 2, "offset": 0, "total": 3, "has_more": True} and line["_meta"]["duration_ms"] >= 0 and answer.exit_code == 0
    missing = engine.session("zzzz")
    assert json.loads(missing.line())["errors"][0]["code"] == 1002 and missing.exit_code == 2
    assert engine.version().data["context"] in ("ci", "tty", "agent")
    feed = spark.createDataFrame([("m", 1e-6, 2e-6, None, None)], "key string, input_cost_per_token double, output_cost_per_token double, cache_read_input_token_cost double, cache_creation_input_token_cost double")
    tokens = F.lit(5).cast("long")
    own = engine.r["sessions"].withColumns({c: tokens for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "reasoning_tokens")})
    e = Engine(spark, engine.r | {"sessions": own, "model_prices": spark.createDataFrame([], "model string, input_per_mtok double, output_per_mtok double, cache_read_per_mtok double, cache_write_per_mtok double")}, register=False)
    assert e.top("tokens").warnings == ["NO_PRICES_LOADED"]
    assert [(r["model"], r["input_per_mtok"]) for r in e.prices(feed).data] == [("m", 1.0), ("n", None)]
    assert e.top("tokens").warnings == ["INCOMPLETE_PRICING: 3 sessions, costs are a lower bound"]


def test_query_and_schema(engine):
    assert engine.query("SELECT count(*) AS n FROM sessions").data["rows"] == [{"n": 3}]
    assert engine.query("DELETE FROM sessions").status == "error"
    assert {"name": "id", "type": "string"} in engine.schema("sessions").data and "sessions" in engine.schema("sesions").errors[0]


def test_upkeep(engine, spark, tmp_path):
    assert engine.purge(["/p/xy"]).data == {"kept": 1, "purged": 2, "dry_run": True}
    after = upkeep.purge({k: engine.r[k] for k in ("sessions", "messages")}, F.col("id") != "cc--aaaa-1")
    assert after["messages"].count() == 2 and after["sessions"].filter("parent_session_id is not null").count() == 0 and after["pending_payload_purges"].count() == 1
    assert engine.backup(f"file://{tmp_path}/b").data["messages"] == 4
    files = spark.createDataFrame([(i % 50, f"/f{i}", i % 50) for i in range(100)], "identity int, path string, size long")
    assert {r["count"] for r in upkeep.stratified(files, 5, 2).groupBy("stratum").count().collect()} == {2}
    listing = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "path string, mtime long, size long")
    assert [r["path"] for r in upkeep.changed(listing, listing.filter("path = 'a'")).collect()] == ["b"]
    assert upkeep.freshness(engine.r["sessions"], spark.createDataFrame([("cc--aaaa-1",)], "session_id string")).first()["pending_from"] == 100
    a, b = spark.range(1).select(upkeep.salted_hash(F.lit("x"), [F.lit(None).cast("string")], "d"), upkeep.salted_hash(F.lit("x"), [F.lit("")], "d")).first()
    assert a != b


def test_skill_listings(spark):
    event = lambda text, first: json.dumps({"type": "attachment", "attachment": {"type": "skill_listing", "isInitial": first, "content": text}})
    raw = spark.createDataFrame([("s", 1, event("# User skills\n- a: old\n# Other\n- b: x: y", True)), ("s", 2, event("## project\n- a: new", False)), ("s", 3, "{")], "session_id string, seq long, raw_json string")
    got = sorted(map(tuple, sessions.skill_listings(raw).select("skill_name", "description", "origin", "source_seq", "is_initial").collect()))
    assert got == [("a", "new", "project", 2, 0), ("b", "x: y", "unknown", 1, 1)]
