"""Facts: one row for each thing a tool call or message says happened. DataFrames of relations in, a DataFrame out.

``tool_calls`` has session_id, turn, idx, name, args_json, args_hash, output_preview, exit_code; ``messages`` has
session_id, turn, role, ts, text. Arguments that are no JSON give no facts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions import patterns as P
from tidewrack.functions import shell
from tidewrack.functions.text import LEADING_SPACE, correction, error_category, interruption_reason, is_noise, prompt_template, redact
from tidewrack.operators.working import stored

CALL = ["session_id", "turn", "idx"]


def _args(calls: DataFrame) -> DataFrame:
    return calls.withColumn("args", F.try_parse_json("args_json"))


def _string(args: Column, path: str) -> Column:
    """The value at ``path`` if it is a string; numbers and objects are none."""
    value = F.try_variant_get(args, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(args, path, "string"))


def _picked(args: Column, keys: tuple[str, ...]) -> Column:
    """The first of the keys that has a string with more than white space in it, trimmed."""
    trimmed = (F.regexp_replace(_string(args, f"$.{k}"), f"{LEADING_SPACE}|{LEADING_SPACE.removeprefix('^')}$", "") for k in keys)
    return F.coalesce(*(F.when(v != "", v) for v in trimmed))


def _strings(args: Column, path: str) -> Column:
    """The strings of an array; other elements, and anything but an array, are none."""
    items = F.coalesce(F.try_variant_get(args, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))


def _first(args: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*(_string(args, f"$.{k}") for k in keys))


def files_touched(calls: DataFrame) -> DataFrame:
    """session_id, turn, op, path; one row for each. A patch is one JSON string, and names a file on lines of its own."""
    args = _args(calls.filter(F.col("name").isin(*P.FILE_TOOLS, "apply_patch", "opencode_patch")))
    op = F.element_at(F.create_map(*(F.lit(x) for kv in P.FILE_TOOLS.items() for x in kv)), F.col("name"))
    single = F.filter(F.array(*(_string(F.col("args"), f"$.{k}") for k in P.PATH_KEYS)), lambda p: p.isNotNull() & (p != ""))
    plain = args.filter(F.col("name").isin(*P.FILE_TOOLS)).select("session_id", "turn", op.alias("op"), F.explode(F.concat(single, _strings(F.col("args"), "$.paths"))).alias("path"))
    patch = F.when(F.schema_of_variant("args") == "STRING", F.try_variant_get("args", "$", "string"))
    edits = F.regexp_extract_all(patch, F.lit(r"(?m)^\*\*\* (?:Add|Update|Delete) File: .+$"), F.lit(0))
    patched = args.filter("name = 'apply_patch'").select("session_id", "turn", F.explode(edits).alias("line"))
    kind = F.regexp_extract("line", r"^\*\*\* (Add|Update|Delete) File: (.+)$", 1)
    patched = patched.select("session_id", "turn", F.when(kind == "Add", "write").when(kind == "Update", "edit").otherwise("delete").alias("op"), F.trim(F.regexp_extract("line", r"File: (.+)$", 1)).alias("path"))
    listed = F.filter(_strings(F.col("args"), "$.files"), lambda p: p != "")
    opencode = args.filter("name = 'opencode_patch'").select("session_id", "turn", F.lit("edit").alias("op"), F.explode(listed).alias("path"))
    return plain.unionByName(patched.filter("path <> ''")).unionByName(opencode).distinct()


def shell_commands(calls: DataFrame) -> DataFrame:
    """session_id, turn, idx, cmd_head, cmd_full (redacted), exit_code, duration_ms. A command that cannot be parsed
    keeps its row with a null head."""
    runs = _args(calls.filter(F.col("name").isin(*P.SHELL_TOOLS)))
    runs = runs.withColumn("raw", _picked(F.col("args"), P.COMMAND_KEYS)).filter("raw is not null")
    return runs.select(*CALL, shell.command_head(F.col("raw")).alias("cmd_head"), redact(F.col("raw")).alias("cmd_full"), "exit_code", "duration_ms")


def tool_errors(calls: DataFrame) -> DataFrame:
    failed = calls.filter("exit_code <> 0")
    text = F.coalesce("output_preview", F.lit(""))
    return failed.select(*CALL, F.col("name").alias("tool_name"), error_category(text, F.col("name")).alias("error_category"), F.substring(text, 1, 500).alias("error_text"))


def _in_order() -> Window:
    return Window.partitionBy("session_id").orderBy("turn")


def with_tool_counts(messages: DataFrame, calls: DataFrame) -> DataFrame:
    counts = calls.groupBy("session_id", "turn").agg(F.count(F.lit(1)).alias("tools"))
    return messages.join(counts, ["session_id", "turn"], "left").withColumn("tools", F.coalesce("tools", F.lit(0)))


def user_corrections(messages: DataFrame) -> DataFrame:
    """session_id, turn, kind, confidence, correction_text, preceding_turn, preceding_tool_calls, response_time_ms of
    user turns after the first that a rule knows. ``messages`` has tools (see with_tool_counts)."""
    before = _in_order().rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("role") == "assistant", F.struct("turn", "ts", "tools")), ignorenulls=True).over(before)
    nth = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(_in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = messages.withColumn("previous", last).withColumn("nth", nth).filter("role = 'user' and nth > 1")
    seen = seen.filter(~is_noise(F.col("text"))).withColumn("found", correction(F.col("text"))).filter("found is not null")
    return seen.select(
        "session_id", "turn", "found.kind", "found.confidence", F.substring("text", 1, 500).alias("correction_text"),
        F.col("previous.turn").alias("preceding_turn"), F.col("previous.tools").alias("preceding_tool_calls"),
        ((F.col("ts") - F.col("previous.ts")) * 1000).alias("response_time_ms"),
    )


def with_reverts(corrections: DataFrame, calls: DataFrame, commands: DataFrame) -> DataFrame:
    """``corrections`` with followed_by_revert: 2 where an edit within 15 turns puts back the text that the edit
    before the correction replaced, 1 where the same file is edited or git undoes something within 10 turns, else 0.

    The edit before is met by its turn, what follows by blocks of turns, and each correction gets one aggregate back."""
    args = _args(calls.filter(F.col("name").isin(*P.EDIT_TOOLS, "Write")))
    path = _first(F.col("args"), ("file_path", "path"))
    first_edit = F.col("args")
    old = F.coalesce(_string(first_edit, "$.edits[0].old_string"), _string(first_edit, "$.edits[0].old_str"), _first(first_edit, ("old_string", "old_str")))
    new_of = F.concat(
        F.transform(F.coalesce(F.try_variant_get("args", "$.edits", "array<variant>"), F.array().cast("array<variant>")), lambda e: _first(e, ("new_string", "new_str", "content"))),
        F.array(_first(F.col("args"), ("new_string", "new_str", "content"))),
    )
    edits = args.select("session_id", F.col("turn").alias("e_turn"), "name", path.alias("path"), old.alias("old"), new_of.alias("new")).filter("path is not null")
    key = ["session_id", "turn"]
    block = lambda turn: F.floor(turn / 16)
    after = F.explode(F.sequence(block(F.col("turn")), block(F.col("turn") + 15))).alias("block")
    prior = corrections.select(*key, F.col("preceding_turn").alias("e_turn")).join(edits, ["session_id", "e_turn"]).select(*key, "path", F.when(F.col("name") != "Write", F.col("old")).alias("target"))
    ahead = edits.select("session_id", block(F.col("e_turn")).alias("block"), "e_turn", "path", "new")
    later = prior.select("*", after).join(ahead, ["session_id", "block", "path"]).filter("e_turn > turn and e_turn <= turn + 15")
    tier = F.when(F.col("target").isNotNull() & (F.col("target") != "") & F.array_contains("new", F.col("target")), 2).when(F.col("e_turn") <= F.col("turn") + 10, 1).otherwise(0)
    undone = r"(?<![A-Za-z0-9_])git\s+(revert|restore|reset\s+--hard)(?![A-Za-z0-9_])"
    undoing = commands.filter(F.col("cmd_full").rlike(undone)).select("session_id", block(F.col("turn")).alias("block"), F.col("turn").alias("g_turn"))
    by_git = corrections.select(*key, after).join(undoing, ["session_id", "block"]).filter("g_turn > turn and g_turn <= turn + 10")
    tiers = later.select(*key, tier.alias("tier")).unionByName(by_git.select(*key, F.lit(1).alias("tier"))).groupBy(*key).agg(F.max("tier").alias("tier"))
    return corrections.join(tiers, key, "left").withColumn("followed_by_revert", F.coalesce("tier", F.lit(0))).drop("tier")


def preserve_labels(facts: DataFrame, old: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """``facts`` with labels that others wrote into the earlier build, by key."""
    kept = old.select(*keys, *labels).dropDuplicates(keys)
    return facts.drop(*labels).join(kept, keys, "left")


def user_interruptions(messages: DataFrame) -> DataFrame:
    """Short user turns right after an assistant turn of 3 or more tool calls, within 5 s where both times are known."""
    seen = messages.withColumn("before", F.lag(F.struct("role", "ts", "tools")).over(_in_order()))
    seen = seen.withColumn("response_time_ms", (F.col("ts") - F.col("before.ts")) * 1000)
    short = F.char_length(F.coalesce("text", F.lit(""))).between(1, 80)
    quick = F.col("response_time_ms").isNull() | (F.col("response_time_ms") <= 5000)
    seen = seen.filter((F.col("role") == "user") & (F.col("before.role") == "assistant") & (F.col("before.tools") >= 3) & short & quick)
    return seen.select("session_id", "turn", "response_time_ms", interruption_reason(F.col("text")).alias("reason_hint"))


def skills_invoked(calls: DataFrame) -> DataFrame:
    """session_id, turn, idx, skill_name: of the skill tool by its arguments, of a tool named after a skill, and of any
    call whose arguments name a skill's file."""
    args = _args(calls)
    path = F.coalesce(*(F.when(~F.is_variant_null(v), v) for v in (F.try_variant_get("args", f"$.{k}", "variant") for k in ("path", "file_path"))))
    file = F.when(F.schema_of_variant(path) == "STRING", F.try_variant_get(path, "$", "string"))
    by_key = F.coalesce(_picked(F.col("args"), P.SKILL_KEYS), F.regexp_extract(file, P.SKILL_FILE, 1))
    by_name = F.regexp_extract("name", r"(?i)^skill[_:-](.+)$", 1)
    skill = F.when(F.lower("name") == "skill", by_key).when(by_name != "", by_name).otherwise(F.regexp_extract("args_json", P.SKILL_FILE, 1))
    return args.select(*CALL, skill.alias("skill_name")).filter("skill_name <> ''")


def skills_hook_injected(messages: DataFrame) -> DataFrame:
    """session_id, turn, skill_slug, source_path of user messages that begin with a skill's base directory."""
    found = messages.filter((F.col("role") == "user") & F.col("text").ilike("Base directory for this skill:%"))
    found = found.select("session_id", "turn", F.regexp_extract("text", r"(?m)^Base directory for this skill:\s*(\S+)", 1).alias("source_path"))
    slugs = [F.regexp_extract("source_path", p, 1) for p in (f"(?i){P.SKILL_FILE}", P.SKILL_FOLDER)]
    found = found.withColumn("skill_slug", F.when(slugs[0] != "", slugs[0]).otherwise(slugs[1])).filter("skill_slug <> ''")
    return found.groupBy("session_id", "turn", "skill_slug").agg(F.min("source_path").alias("source_path"))


def mcp_calls(calls: DataFrame) -> DataFrame:
    """session_id, turn, idx, server, tool, exit_code: of wrapper tools by their arguments, of others by their name."""
    args = _args(calls)
    wrapper = F.lower("name").isin(*P.MCP_WRAPPERS) | F.col("name").isin(*P.MCP_WRAPPERS_AS_SPELLED)
    server, tool = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern in reversed(P.MCP_NAMES):
        known = F.col("name").rlike(pattern)
        server = F.when(known, F.regexp_extract("name", pattern, 1)).otherwise(server)
        tool = F.when(known, F.regexp_extract("name", pattern, 2)).otherwise(tool)
    server = F.when(wrapper, _picked(F.col("args"), P.MCP_SERVER_KEYS)).otherwise(server)
    tool = F.when(wrapper, _picked(F.col("args"), P.MCP_TOOL_KEYS)).otherwise(tool)
    return args.select(*CALL, server.alias("server"), tool.alias("tool"), "exit_code").filter("server is not null and tool is not null")


def domain(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def web_fetches(calls: DataFrame) -> DataFrame:
    """session_id, turn, idx, kind, url, query, domain of calls that have a URL or a query."""
    args = _args(calls.filter(F.col("name").isin(*P.WEB_TOOLS)))
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in P.WEB_TOOLS.items() for x in kv)), F.col("name"))
    trimmed = F.transform(_strings(F.col("args"), "$.queries"), lambda q: F.regexp_replace(q, f"{LEADING_SPACE}|{LEADING_SPACE.removeprefix('^')}$", ""))
    query = F.coalesce(_picked(F.col("args"), P.QUERY_KEYS), F.get(F.filter(trimmed, lambda q: q != ""), F.lit(0)))
    rows = args.select(*CALL, kind.alias("kind"), _picked(F.col("args"), P.URL_KEYS).alias("url"), query.alias("query"))
    return rows.withColumn("domain", domain(F.col("url"))).filter("url is not null or query is not null")


def git_operations(commands: DataFrame) -> DataFrame:
    """Every git command of shell rows whose head is git, numbered within a turn in the order they run."""
    ops = commands.filter("cmd_head = 'git'").select("session_id", "turn", F.col("idx").alias("call"), "exit_code", F.posexplode(shell.git_column(F.col("cmd_full"))).alias("at", "g"))
    nth = F.row_number().over(Window.partitionBy("session_id", "turn").orderBy("call", "at")) - 1
    return ops.select("session_id", "turn", nth.alias("idx"), F.col("g.op").alias("op"), F.col("g.branch").alias("branch"), F.col("g.commit").alias("commit_hash"), "exit_code")


def commit_status(sessions: DataFrame, operations: DataFrame) -> DataFrame:
    """id, ended_with_commit, ended_with_commit_attempted from the last commit; a source without exit codes attempts."""
    last = operations.filter("op = 'commit'").groupBy("session_id").agg(F.max_by(F.struct("exit_code"), F.struct("turn", "idx")).alias("last"))
    joined = sessions.select("id", "source").join(last, F.col("id") == F.col("session_id"), "left")
    is_cursor = F.col("source") == "cursor"
    return joined.select("id", F.when(F.col("last").isNotNull() & ~is_cursor & (F.col("last.exit_code") == 0), 1).otherwise(0).alias("ended_with_commit"), F.when(F.col("last").isNotNull() & is_cursor, 1).otherwise(0).alias("ended_with_commit_attempted"))


def _is(value: str) -> Callable[[Column], Column]:
    return lambda x: x == value


def todo_events(calls: DataFrame) -> DataFrame:
    """session_id, turn, idx, how many items have each state, and total: the items with any. The first list that is
    there counts, and one that is no array has no items."""
    args = _args(calls.filter(F.col("name").isin(*P.TODO_TOOLS)))
    items = F.coalesce(*(F.when(~F.is_variant_null(v), v) for v in (F.try_variant_get("args", f"$.{k}", "variant") for k in P.TODO_LISTS)))
    states = F.transform(F.coalesce(F.try_variant_get(items, "$", "array<variant>"), F.array().cast("array<variant>")), lambda t: _string(t, "$.status"))
    rows = args.select(*CALL, F.filter(states, lambda s: s.isNotNull()).alias("states")).filter(F.size("states") > 0)
    return rows.select(*CALL, *(F.size(F.filter("states", _is(k))).alias(k) for k in P.TODO_STATES), F.size("states").alias("total"))


def search_calls(calls: DataFrame) -> DataFrame:
    args = _args(calls.filter(F.col("name").isin(*P.SEARCH_TOOLS)))
    rows = args.select(*CALL, F.lower("name").alias("tool"), _picked(F.col("args"), P.SEARCH_PATTERN_KEYS).alias("pattern"), _picked(F.col("args"), P.SEARCH_PATH_KEYS).alias("path"), _picked(F.col("args"), P.SEARCH_INCLUDE_KEYS).alias("include"))
    return rows.filter("pattern is not null or path is not null")


def subagent_dispatches(calls: DataFrame) -> DataFrame:
    """session_id, turn, idx, subagent_type, task_text (500 characters, a sealed message replaced by the task's name)
    of dispatching calls, and what links them to a child: stable_key, output_id and failed. Calls with neither type nor
    text are none."""
    rows = _args(calls.filter(F.lower("name").isin(*P.DISPATCH_TOOLS))).withColumn("output", F.try_parse_json("output_preview"))
    args = F.col("args")
    rows = rows.filter(F.schema_of_variant("args").startswith("OBJECT"))
    spawned = F.lower("name") == "spawn_agent"
    text = _picked(args, P.DISPATCH_TEXT_KEYS)
    sealed = spawned & (F.char_length(text) >= 80) & text.rlike(r"^gAAAA[A-Za-z0-9_-]*={0,2}$")
    text = F.coalesce(F.when(sealed, _picked(args, ("task_name", "taskName"))).otherwise(text), F.lit(""))
    told = F.lower(F.coalesce("output_preview", F.lit("")))
    failed = spawned & F.reduce(F.array(*(F.lit(p) for p in P.DISPATCH_FAILURES)), F.lit(False), lambda a, p: a | F.contains(told, p))
    rows = rows.select(*CALL, _picked(args, P.DISPATCH_TYPE_KEYS).alias("subagent_type"), F.substring(text, 1, 500).alias("task_text"), _picked(args, P.STABLE_KEYS).alias("stable_key"), _picked(F.col("output"), P.OUTPUT_ID_KEYS).alias("output_id"), failed.alias("failed"))
    return rows.filter("subagent_type is not null or task_text <> ''")


def prompt_templates(sessions: DataFrame, least: int = 3) -> DataFrame:
    """First prompts that recur once what varies is taken out: hash, template, count, five example sessions.

    Prompts are taken apart once, into rows of an id, a hash and 500 characters. Examples come from a bounded
    aggregate: the five smallest ids, kept small on the way by a group limit."""
    prompts = sessions.filter(F.col("first_user_prompt").isNotNull() & ~is_noise(F.col("first_user_prompt")))
    prompts = prompts.select("id", prompt_template(F.col("first_user_prompt")).alias("template")).filter("template <> ''")
    prompts = stored(prompts.select("id", F.substring(F.sha2("template", 256), 1, 16).alias("hash"), F.substring("template", 1, 500).alias("template")))
    counts = prompts.groupBy("hash").agg(F.min("template").alias("template"), F.count(F.lit(1)).alias("count")).filter(F.col("count") >= least)
    firsts = prompts.select("id", "hash").withColumn("n", F.row_number().over(Window.partitionBy("hash").orderBy("id"))).filter("n <= 5")
    firsts = firsts.groupBy("hash").agg(F.to_json(F.array_sort(F.collect_list("id"))).alias("example_session_ids"))
    return counts.join(firsts, "hash")


def workflow_facts(runs: DataFrame, journal: DataFrame, sessions: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, phases and agents from manifests (run_id, manifest_json and, where known, orchestrating_external_id) and
    journals (run_id, seq, line_json). With ``sessions`` (id), runs and agents are linked to those that their external
    ids name. A manifest that is no JSON gives nothing; of an agent's results the last counts."""
    external = F.col("orchestrating_external_id") if "orchestrating_external_id" in runs.columns else F.lit(None).cast("string")
    doc = runs.select("run_id", external.alias("external"), F.try_parse_json("manifest_json").alias("m")).filter(F.col("m").isNotNull())
    get = lambda path, kind: F.try_variant_get("m", path, kind)
    seconds = lambda ms: F.floor(ms / 1000).cast("long")
    run = doc.select("run_id", "external", get("$.workflowName", "string").alias("workflow_name"), get("$.status", "string").alias("status"), get("$.agentCount", "long").alias("agent_count"), get("$.totalTokens", "long").alias("total_tokens"), get("$.totalToolCalls", "long").alias("total_tool_calls"), get("$.durationMs", "long").alias("duration_ms"), seconds(get("$.startTime", "double")).alias("started_at"), get("$.summary", "string").alias("summary"), get("$.scriptPath", "string").alias("script_path"))
    phases = doc.select("run_id", F.posexplode(get("$.phases", "array<struct<title: string, detail: string>>")).alias("phase_index", "p")).select("run_id", "phase_index", "p.title", "p.detail")
    results = journal.select("run_id", "seq", F.try_parse_json("line_json").alias("j"))
    results = results.filter(F.try_variant_get("j", "$.type", "string") == "result").groupBy("run_id", F.try_variant_get("j", "$.agentId", "string").alias("agent_id")).agg(F.max_by(F.try_variant_get("j", "$.result", "string"), "seq").alias("result"))
    listed = doc.select("run_id", F.explode(get("$.workflowProgress", "array<struct<type: string, index: long, agentId: string, label: string, model: string, state: string, attempt: long, tokens: long, toolCalls: long, durationMs: long, startedAt: double, phaseIndex: long, phaseTitle: string>>")).alias("a")).filter("a.agentId is not null")
    plain = {"label": "label", "model": "model", "state": "state", "attempt": "attempt", "tokens": "tokens", "toolCalls": "tool_calls", "durationMs": "duration_ms", "phaseIndex": "phase_index", "phaseTitle": "phase_title"}
    agents = listed.select("run_id", F.col("a.agentId").alias("agent_id"), *(F.col(f"a.{k}").alias(v) for k, v in plain.items()), seconds(F.col("a.startedAt")).alias("started_at"))
    agents = agents.join(results, ["run_id", "agent_id"], "left")
    if sessions is not None:
        known = lambda name: sessions.select(F.col("id").alias(name)).distinct()
        run = run.join(known("orchestrating_session_id"), F.concat(F.lit("cc--"), "external") == F.col("orchestrating_session_id"), "left")
        agents = agents.join(known("agent_session_id"), F.concat(F.lit("cc--"), "agent_id") == F.col("agent_session_id"), "left")
    return run.drop("external"), phases, agents
