"""Queries of the fact extractors over tool calls and messages whose arguments are made, row by row, from the tables.

Every rule and its exceptions occur: keys in their order, blanks, numbers where strings belong, arguments that are no
JSON. The SQL states the rules by DuckDB's JSON functions and shares nothing with the extractors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import patterns as P
from tidewrack.operators import facts, rollups
from tidewrack.plans.relations import CTES, Relations

#: Tool calls by event: name and arguments. ``n`` stands for a number of the event; Spark and DuckDB read this alike.
CASES = (
    ("Read", """'{"file_path": "/src/m' || n || '.py"}'"""),
    ("Write", """'{"path": "out/' || n || '.txt", "file_path": ""}'"""),
    ("Edit", """'{"filePath": "a/' || n || '.ts", "old_string": "x", "new_string": "y"}'"""),
    ("MultiEdit", """'{"target_file": "t' || n || '", "rel_path": "r' || n || '", "paths": ["p' || n || '", 7, "q"]}'"""),
    ("read", """'{"paths": ["p' || n || '", "p' || n || '"], "path": "p' || n || '"}'"""),
    ("Read", """'{"file_path": ' || n || '}'"""),
    ("Read", """'{"file_path": "cut ' || n"""),
    ("delete", """'{"targetFile": "old/' || n || '"}'"""),
    ("apply_patch", """'"*** Begin Patch' || chr(92) || 'n*** Add File: n' || n || '.md ' || chr(92) || 'n+*** Add File: no' || chr(92) || 'n*** Update File: u.py' || chr(92) || 'n*** Delete File: d' || n || '"'"""),
    ("apply_patch", """'{"input": "*** Add File: x' || n || '"}'"""),
    ("opencode_patch", """'{"files": ["z' || n || '", "", 3]}'"""),
    ("Bash", """'{"command": " npm test -- --k=' || n || ' "}'"""),
    ("bash", """'{"cmd": "git add . && git commit -m x' || n || '"}'"""),
    ("Shell", """'{"command": "   ", "shellCommand": "ls ' || n || '"}'"""),
    ("exec_command", """'{"shell_command": "git checkout -b br' || n || '"}'"""),
    ("shell", """'{"command": "  "}'"""),
    ("execute_command", """'{"command": "git -C /w show abcdef' || (n % 10) || ' | head"}'"""),
    ("bash", """'{"command": "git ci -m done' || n || '"}'"""),
    ("Skill", """'{"skill": " sk' || (n % 9) || ' ", "name": "other"}'"""),
    ("skill", """'{"skill_id": " ", "path": "/x/skills-team/sk' || (n % 9) || '/SKILL.md"}'"""),
    ("skill", """'{"path": 5, "file_path": "/x/skills/no/SKILL.md"}'"""),
    ("Skill_create-rule", "'{}'"),
    ("Read", """'{"file_path": "/h/skills/sk' || (n % 9) || '/SKILL.md"}'"""),
    ("Read", """'{"file_path": "/h/other/sk/SKILL.md"}'"""),
    ("mcp__srv__a__tool", "'{}'"),
    ("mcp__srv", "'{}'"),
    ("mcp_git-hub_issue_list", "'{}'"),
    ("CallMcpTool", """'{"server": 5, "serverName": "s' || (n % 4) || '", "toolName": " ", "tool": "t' || (n % 3) || '"}'"""),
    ("CALL_MCP_TOOL", """'{"server_name": "s' || (n % 4) || '", "name": "t"}'"""),
    ("callmcptool", """'{"server": "s", "tool": "t"}'"""),
    ("use_mcp_tool", """'{"server": "s"}'"""),
    ("WebFetch", """'{"url": "https://Ex' || (n % 5) || '.com/a?b#c"}'"""),
    ("WebSearch", """'{"url": " ", "query": " how ' || n || ' "}'"""),
    ("web_search", """'{"queries": [4, " ", "q' || n || '", "r"]}'"""),
    ("browser_navigate", """'{"href": "http://u@n' || (n % 3) || '.org:80/"}'"""),
    ("fetch", """'{"prompt": "no"}'"""),
    ("TodoWrite", """'{"todos": [{"status": "pending"}, {"status": "completed"}, {"status": "' || CASE n % 3 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'in_progress' ELSE 'odd' END || '"}, {"content": "none"}, {"status": 1}, 2]}'"""),
    ("update_plan", """'{"todos": null, "plan": [{"status": "in_progress"}], "items": [{"status": "pending"}]}'"""),
    ("todowrite", """'{"todos": "none", "plan": [{"status": "pending"}]}'"""),
    ("todo_write", """'{"items": []}'"""),
    ("Grep", """'{"pattern": "x' || n || '", "cwd": "src", "glob": "*.py"}'"""),
    ("glob", """'{"pattern": " ", "query": "**/*", "filter": "f"}'"""),
    ("grep", """'{"directory": "d' || (n % 5) || '"}'"""),
    ("Glob", """'{"include": "only"}'"""),
    ("Task", """'{"subagent_type": "explore", "prompt": "look ' || n || '"}'"""),
    ("spawn_agent", """'{"task_name": "w' || (n % 7) || '", "message": "gAAAA' || repeat('b', 90) || '"}'"""),
    ("agent", """'{"message": "gAAAA' || repeat('b', 90) || '", "type": 3}'"""),
    ("Agent", """'{"type": "t", "description": " "}'"""),
    ("subagent", """'{"instructions": "' || repeat('long ', 120) || '"}'"""),
    ("task", """'{"prompt": " "}'"""),
)


def _case(column: int) -> str:
    values = (f"'{c[0]}'" if column == 0 else c[1] for c in CASES)
    return "CASE v " + " ".join(f"WHEN {at} THEN {value}" for at, value in enumerate(values)) + " END"


#: Hook-injected skill bodies, and user texts that only look like one.
HOOKS = (
    "'Base directory for this skill: /home/u/skills/sk' || (n % 6) || chr(10) || chr(10) || 'body'",
    "'base directory for this skill: x' || chr(10) || 'Base directory for this skill: /u/skills-team/deep/SKILL.md'",
    "'Base directory for this skill: /home/u/other/sk'",
    "'Base directory for this skill:  /a/Skills/up' || (n % 6) || '/'",
    "'See Base directory for this skill: /home/u/skills/no'",
)
HOOK_CASE = "CASE n % 5 " + " ".join(f"WHEN {at} THEN {value}" for at, value in enumerate(HOOKS)) + " END"
TURN = "CAST((event_id * 7919) % 5 AS BIGINT)"
CTES["made_calls"] = f"SELECT session_id, turn, idx, v, n, {_case(0)} AS name, {_case(1)} AS args_json, CASE n % 4 WHEN 3 THEN NULL WHEN 2 THEN 1 ELSE 0 END AS exit_code FROM (SELECT CAST(user_id AS VARCHAR) AS session_id, {TURN} AS turn, CAST(event_id AS BIGINT) AS idx, CAST(event_id % {len(CASES)} AS INTEGER) AS v, CAST(event_id // {len(CASES)} AS BIGINT) AS n FROM events)"
CTES["valid_calls"] = "SELECT *, CASE WHEN json_valid(args_json) THEN args_json::JSON END AS args FROM made_calls"
CTES["made_hooks"] = f"SELECT CAST(event_id % 50 AS VARCHAR) AS session_id, {TURN} AS turn, CASE WHEN event_id % 11 = 0 THEN 'assistant' ELSE 'user' END AS role, {HOOK_CASE} AS text FROM (SELECT *, CAST(event_id AS BIGINT) AS n FROM events)"


def made_calls(r: Relations) -> DataFrame:
    """The calls of ``CTES["made_calls"]`` in Spark."""
    n = len(CASES)
    rows = r.read("events").select(F.col("user_id").cast("string").alias("session_id"), F.expr(TURN).alias("turn"), F.col("event_id").cast("long").alias("idx"), (F.col("event_id") % n).cast("int").alias("v"), F.expr(f"CAST(event_id div {n} AS BIGINT)").alias("n"))
    exit_code = F.expr("CASE n % 4 WHEN 3 THEN NULL WHEN 2 THEN 1 ELSE 0 END")
    return rows.select("session_id", "turn", "idx", F.expr(_case(0)).alias("name"), F.expr(_case(1)).alias("args_json"), exit_code.alias("exit_code"), F.lit(None).cast("string").alias("output_preview"), F.lit(None).cast("long").alias("duration_ms"))


def made_hooks(r: Relations) -> DataFrame:
    rows = r.read("events").withColumn("n", F.col("event_id").cast("long"))
    return rows.select((F.col("event_id") % 50).cast("string").alias("session_id"), F.expr(TURN).alias("turn"), F.expr("CASE WHEN event_id % 11 = 0 THEN 'assistant' ELSE 'user' END").alias("role"), F.expr(HOOK_CASE).alias("text"))


def _string(key: str) -> str:
    return f"CASE WHEN json_type(args, '$.{key}') = 'VARCHAR' THEN json_extract_string(args, '$.{key}') END"


def _picked(keys: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim({_string(k)}), '')" for k in keys) + ", NULL)"


def _names(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _items(path: str) -> str:
    """The elements of an array, of which only those of an array are rows."""
    return f"unnest(CASE WHEN json_type(args, '{path}') = 'ARRAY' THEN json_extract(args, '{path}[*]') ELSE []::JSON[] END)"


OPS = "CASE " + " ".join(f"WHEN name = '{name}' THEN '{op}'" for name, op in P.FILE_TOOLS.items()) + " END"
KINDS = "CASE " + " ".join(f"WHEN name = '{name}' THEN '{kind}'" for name, kind in P.WEB_TOOLS.items()) + " END"
FILES = f"""
WITH single AS (SELECT session_id, turn, {OPS} AS op, unnest([{", ".join(_string(k) for k in P.PATH_KEYS)}]) AS path FROM valid_calls WHERE name IN {_names(P.FILE_TOOLS)}),
many AS (SELECT session_id, turn, {OPS} AS op, {_items("$.paths")} AS e FROM valid_calls WHERE name IN {_names(P.FILE_TOOLS)}),
lines AS (SELECT session_id, turn, unnest(string_split(args ->> '$', chr(10))) AS line FROM valid_calls WHERE name = 'apply_patch' AND json_type(args) = 'VARCHAR'),
patched AS (SELECT session_id, turn, regexp_extract(line, '^\\*\\*\\* (Add|Update|Delete) File: (.+)$', 1) AS verb, trim(regexp_extract(line, '^\\*\\*\\* (Add|Update|Delete) File: (.+)$', 2)) AS path FROM lines),
listed AS (SELECT session_id, turn, {_items("$.files")} AS e FROM valid_calls WHERE name = 'opencode_patch')
SELECT DISTINCT * FROM (
  SELECT session_id, turn, op, path FROM single WHERE path <> ''
  UNION ALL SELECT session_id, turn, op, e ->> '$' FROM many WHERE json_type(e) = 'VARCHAR'
  UNION ALL SELECT session_id, turn, CASE verb WHEN 'Add' THEN 'write' WHEN 'Update' THEN 'edit' ELSE 'delete' END, path FROM patched WHERE verb <> '' AND path <> ''
  UNION ALL SELECT session_id, turn, 'edit', e ->> '$' FROM listed WHERE json_type(e) = 'VARCHAR' AND (e ->> '$') <> '')
"""
#: The heads of the shell cases, and their git operations, as the rules for words, wrappers and flags give them.
SHELL = f"""
SELECT session_id, turn, idx, CASE v WHEN 11 THEN 'npm' WHEN 13 THEN 'ls' ELSE 'git' END AS cmd_head, cmd AS cmd_full, exit_code
FROM (SELECT *, {_picked(P.COMMAND_KEYS)} AS cmd FROM valid_calls WHERE name IN {_names(P.SHELL_TOOLS)}) WHERE cmd IS NOT NULL
"""
GIT_OPS = """ops AS (
  SELECT session_id, turn, idx AS call, 0 AS nth, CASE v WHEN 12 THEN 'add' WHEN 14 THEN 'checkout' WHEN 16 THEN 'show' ELSE 'commit' END AS op, CASE v WHEN 14 THEN 'br' || n END AS branch, CASE v WHEN 16 THEN 'abcdef' || (n % 10) END AS commit_hash, exit_code FROM made_calls WHERE v IN (12, 14, 16, 17)
  UNION ALL SELECT session_id, turn, idx, 1, 'commit', NULL, NULL, exit_code FROM made_calls WHERE v = 12)"""
GIT = f"WITH {GIT_OPS} SELECT session_id, turn, row_number() OVER (PARTITION BY session_id, turn ORDER BY call, nth) - 1 AS idx, op, branch, commit_hash, exit_code FROM ops"
COMMITS = f"""
WITH {GIT_OPS},
commits AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC, call DESC, nth DESC) AS k FROM ops WHERE op = 'commit'),
ids AS (SELECT DISTINCT session_id AS id FROM made_calls)
SELECT id, CASE WHEN k = 1 AND CAST(id AS BIGINT) % 3 <> 0 AND exit_code = 0 THEN 1 ELSE 0 END AS ended_with_commit, CASE WHEN k = 1 AND CAST(id AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END AS ended_with_commit_attempted
FROM ids LEFT JOIN commits ON id = session_id AND k = 1
"""
SKILLS = f"""
SELECT session_id, turn, idx, skill_name FROM (
  SELECT *, CASE
    WHEN lower(name) = 'skill' THEN coalesce({_picked(P.SKILL_KEYS)}, CASE WHEN coalesce(nullif(json_type(args, '$.path'), 'NULL'), '') = '' THEN regexp_extract({_string("file_path")}, 'skills(?:-[a-z]+)?/([^/]+)/SKILL\\.md', 1) ELSE regexp_extract({_string("path")}, 'skills(?:-[a-z]+)?/([^/]+)/SKILL\\.md', 1) END)
    WHEN regexp_matches(name, '(?i)^skill[_:-].') THEN name[7:]
    ELSE regexp_extract(args_json, 'skills(?:-[a-z]+)?/([^/]+)/SKILL\\.md', 1) END AS skill_name
  FROM valid_calls) WHERE skill_name <> ''
"""
HOOKED = """
WITH p AS (SELECT session_id, turn, regexp_extract(text, '(?m)^Base directory for this skill:\\s*(\\S+)', 1) AS source_path FROM made_hooks WHERE role = 'user' AND text ILIKE 'Base directory for this skill:%'),
s AS (SELECT *, coalesce(nullif(regexp_extract(source_path, '(?i)skills(?:-[a-z]+)?/([^/]+)/SKILL\\.md', 1), ''), regexp_extract(source_path, '(?i)/skills(?:-[a-z]+)?/([^/\\s]+)/?$', 1)) AS skill_slug FROM p)
SELECT session_id, turn, skill_slug, min(source_path) AS source_path FROM s WHERE skill_slug <> '' GROUP BY ALL
"""
MCP = f"""
SELECT session_id, turn, idx, server, tool, exit_code FROM (
  SELECT session_id, turn, idx, exit_code,
    CASE WHEN lower(name) IN ('mcp_tool', 'call_mcp_tool') OR name IN ('CallMcpTool', 'use_mcp_tool') THEN {_picked(P.MCP_SERVER_KEYS)} WHEN name LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN nullif(regexp_extract(name, '^mcp__([a-zA-Z0-9._-]+)__(.+)$', 1), '') ELSE nullif(regexp_extract(name, '^mcp_([a-zA-Z0-9.-]+)_(.+)$', 1), '') END AS server,
    CASE WHEN lower(name) IN ('mcp_tool', 'call_mcp_tool') OR name IN ('CallMcpTool', 'use_mcp_tool') THEN {_picked(P.MCP_TOOL_KEYS)} WHEN name LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN nullif(regexp_extract(name, '^mcp__([a-zA-Z0-9._-]+)__(.+)$', 2), '') ELSE nullif(regexp_extract(name, '^mcp_([a-zA-Z0-9.-]+)_(.+)$', 2), '') END AS tool
  FROM valid_calls) WHERE server IS NOT NULL AND tool IS NOT NULL
"""
WEB = f"""
SELECT session_id, turn, idx, kind, url, query, lower(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1), '')) AS domain FROM (
  SELECT session_id, turn, idx, {KINDS} AS kind, {_picked(P.URL_KEYS)} AS url,
    coalesce({_picked(P.QUERY_KEYS)}, list_filter(list_transform(CASE WHEN json_type(args, '$.queries') = 'ARRAY' THEN json_extract(args, '$.queries[*]') ELSE []::JSON[] END, lambda e: CASE WHEN json_type(e) = 'VARCHAR' THEN trim(e ->> '$') ELSE '' END), lambda q: q <> '')[1]) AS query
  FROM valid_calls WHERE name IN {_names(P.WEB_TOOLS)}) WHERE url IS NOT NULL OR query IS NOT NULL
"""
TODOS = f"""
WITH lists AS (SELECT session_id, turn, idx, CASE WHEN coalesce(json_type(args, '$.todos'), 'NULL') <> 'NULL' THEN json_extract(args, '$.todos') WHEN coalesce(json_type(args, '$.plan'), 'NULL') <> 'NULL' THEN json_extract(args, '$.plan') ELSE json_extract(args, '$.items') END AS l FROM valid_calls WHERE name IN {_names(P.TODO_TOOLS)}),
each AS (SELECT session_id, turn, idx, unnest(CASE WHEN json_type(l) = 'ARRAY' THEN json_extract(l, '$[*]') ELSE []::JSON[] END) AS e FROM lists),
states AS (SELECT session_id, turn, idx, e ->> '$.status' AS s FROM each WHERE json_type(e, '$.status') = 'VARCHAR')
SELECT session_id, turn, idx, {", ".join(f"count(*) FILTER (s = '{s}') AS {s}" for s in P.TODO_STATES)}, count(*) AS total FROM states GROUP BY session_id, turn, idx
"""
SEARCHES = f"""
SELECT session_id, turn, idx, lower(name) AS tool, pattern, path, include FROM (
  SELECT *, {_picked(P.SEARCH_PATTERN_KEYS)} AS pattern, {_picked(P.SEARCH_PATH_KEYS)} AS path, {_picked(P.SEARCH_INCLUDE_KEYS)} AS include FROM valid_calls WHERE name IN {_names(P.SEARCH_TOOLS)}) WHERE pattern IS NOT NULL OR path IS NOT NULL
"""
DISPATCHES = f"""
SELECT session_id, turn, idx, subagent_type, left(coalesce(CASE WHEN sealed THEN {_picked(("task_name", "taskName"))} ELSE t END, ''), 500) AS task_text FROM (
  SELECT *, lower(name) = 'spawn_agent' AND length(t) >= 80 AND regexp_matches(t, '^gAAAA[A-Za-z0-9_-]*={{0,2}}$') AS sealed FROM (
    SELECT *, {_picked(P.DISPATCH_TYPE_KEYS)} AS subagent_type, {_picked(P.DISPATCH_TEXT_KEYS)} AS t FROM valid_calls WHERE lower(name) IN {_names(P.DISPATCH_TOOLS)}))
WHERE subagent_type IS NOT NULL OR coalesce(CASE WHEN sealed THEN {_picked(("task_name", "taskName"))} ELSE t END, '') <> ''
"""


#: What a failed call printed, and the category it belongs to: the first rule in order that knows it.
FAILURES = (
    ("File has not been read yet. Read it first", "file_not_read"), ("String to replace not found in file.", "not_found"), ("File has been modified since read, either by the user", "file_modified_since_read"),
    ("Found 3 matches of the string to replace", "string_not_unique"), ("old_string and new_string are exactly the same.", "string_unchanged"), ("The user doesn''t want to proceed with this tool use", "user_rejected"),
    ("Cancelled: parallel tool call Bash errored", "parallel_cancelled"), ("PreToolUse:Bash hook error: no", "blocked_by_hook"), ("cat: x: No such file or directory", "file_not_found"),
    ("EACCES: permission denied, and a timeout", "permission"), ("request TIMED OUT", "timeout"), ("429 too many", "rate_limit"), ("connect ECONNREFUSED 1.2.3.4", "network"), ("SyntaxError near x", "parse"),
    ("branch already exists", "conflict"), ("HTTP 404", "not_found"), ("boom", "unclassified"), ("", "unclassified"),
)
CTES["made_failures"] = f"SELECT session_id, turn, idx, name, exit_code, CASE idx % {len(FAILURES)} {' '.join(f"WHEN {k} THEN '{t}'" for k, (t, _) in enumerate(FAILURES))} END AS output_preview, CASE idx % {len(FAILURES)} {' '.join(f"WHEN {k} THEN '{c}'" for k, (_, c) in enumerate(FAILURES))} END AS expected FROM made_calls"
ERRORS = "SELECT session_id, turn, idx, name AS tool_name, expected AS error_category, output_preview AS error_text FROM made_failures WHERE exit_code <> 0"

#: What a user says to an answer, and the kind and confidence it has.
REPLIES = (
    ("no, that breaks it", "reject", 0.9), ("STOP", "reject", 0.9), ("please undo the change", "undo", 0.9), ("roll back, thanks", "undo", 0.9), ("actually it is `main.py` in there", "factual", 0.8),
    ("make it shorter", "style", 0.7), ("only touch utils.py", "scope", 0.7), ("instead try a queue", "pivot", 0.7), ("can you log it", "refine", 0.5), ("also add tests", "refine", 0.5), ("thanks, looks good", None, None),
    ("<system-reminder> no", None, None), ("nothing more", None, None),
)
#: What an assistant does next, and whether that takes back the edit ahead of the reply.
FOLLOW_UPS = (
    ("Edit", """'{"file_path": "/f", "old_string": "NEW", "new_string": "OLD' || s || '"}'""", 2), ("Edit", """'{"file_path": "/f", "old_string": "NEW", "new_string": "ELSE"}'""", 1), ("Bash", """'{"command": "git revert HEAD"}'""", 1),
    ("Edit", """'{"file_path": "/g", "old_string": "NEW", "new_string": "OLD' || s || '"}'""", 0), ("Bash", """'{"command": "git status"}'""", 0), ("MultiEdit", """'{"file_path": "/f", "edits": [{"old_string": "a", "new_string": "b"}, {"old_string": "NEW", "new_string": "OLD' || s || '"}]}'""", 2),
)
#: Sessions of eight turns: a request, an edit, a reply to it, what follows, and two more rounds.
_ROLE = "CASE WHEN p % 2 = 0 THEN 'user' ELSE 'assistant' END"
_SAID = f"CASE WHEN p = 0 THEN 'no, start' WHEN p = 2 THEN CASE s % {len(REPLIES)} {' '.join(f"WHEN {k} THEN '{t}'" for k, (t, *_) in enumerate(REPLIES))} END WHEN p % 2 = 0 THEN 'go on' ELSE 'done' END"
_TOOL = f"CASE WHEN p = 1 THEN 'Edit' ELSE CASE s % {len(FOLLOW_UPS)} {' '.join(f"WHEN {k} THEN '{t}'" for k, (t, *_) in enumerate(FOLLOW_UPS))} END END"
_ARGS = f"""CASE WHEN p = 1 THEN '{{"file_path": "/f", "old_string": "OLD' || s || '", "new_string": "NEW"}}' ELSE CASE s % {len(FOLLOW_UPS)} {' '.join(f"WHEN {k} THEN {a}" for k, (_, a, _) in enumerate(FOLLOW_UPS))} END END"""
CTES["made_turns"] = f"SELECT CAST(s AS VARCHAR) AS session_id, p + 1 AS turn, {_ROLE} AS role, s * 1000 + p * 7 AS ts, {_SAID} AS text, s, p FROM (SELECT CAST(event_id // 8 AS BIGINT) AS s, CAST(event_id % 8 AS BIGINT) AS p FROM events)"


def made_turns(r: Relations) -> tuple[DataFrame, DataFrame]:
    """Messages and tool calls of sessions in which users correct what was done."""
    rows = r.read("events").select(F.expr("event_id div 8").cast("long").alias("s"), (F.col("event_id") % 8).cast("long").alias("p"))
    rows = rows.withColumns({"session_id": F.col("s").cast("string"), "turn": F.col("p") + 1})
    messages = rows.select("session_id", "turn", F.expr(_ROLE).alias("role"), F.expr("s * 1000 + p * 7").alias("ts"), F.expr(_SAID).alias("text"))
    calls = rows.filter("p in (1, 3)").select("session_id", "turn", F.lit(0).alias("idx"), F.expr(_TOOL).alias("name"), F.expr(_ARGS).alias("args_json"), F.lit(0).alias("exit_code"), F.lit(None).cast("long").alias("duration_ms"))
    return messages, calls


_REPLY_KIND = f"CASE s % {len(REPLIES)} {' '.join(f"WHEN {k} THEN '{kind}'" for k, (_, kind, _) in enumerate(REPLIES) if kind)} END"
_REPLY_SURE = f"CASE s % {len(REPLIES)} {' '.join(f"WHEN {k} THEN {c}::DOUBLE" for k, (_, _, c) in enumerate(REPLIES) if c)} END"
_UNDONE = f"CASE s % {len(FOLLOW_UPS)} {' '.join(f"WHEN {k} THEN {u}" for k, (_, _, u) in enumerate(FOLLOW_UPS))} END"
CORRECTIONS = f"""
SELECT session_id, turn, kind, confidence, text AS correction_text, 2::BIGINT AS preceding_turn, 1::BIGINT AS preceding_tool_calls, 7000::BIGINT AS response_time_ms,
  CASE WHEN EXISTS (SELECT 1 FROM made_turns b WHERE b.s = a.s AND b.p = 3) THEN {_UNDONE} ELSE 0 END AS followed_by_revert
FROM (SELECT *, {_REPLY_KIND} AS kind, {_REPLY_SURE} AS confidence FROM made_turns a WHERE p = 2) a WHERE kind IS NOT NULL
"""
BY_KIND = f"SELECT kind, count(*) AS n, count(DISTINCT session_id) AS sessions, count(*) FILTER (followed_by_revert = 1) + 2 * count(*) FILTER (followed_by_revert = 2) AS reverts, avg(preceding_tool_calls) AS avg_tools_before FROM ({CORRECTIONS}) GROUP BY kind"


def _corrections(r: Relations) -> DataFrame:
    messages, calls = made_turns(r)
    return facts.with_reverts(facts.user_corrections(facts.with_tool_counts(messages, calls)), calls, facts.shell_commands(calls))


#: Workflow manifests and journals by order: two phases, two agents and what has no agent, results of which the last counts.
_MANIFEST = """'{"workflowName": "w' || (o_orderkey % 5) || '", "status": "' || o_orderstatus || '", "agentCount": ' || (o_orderkey % 9) || ', "totalTokens": ' || (o_orderkey * 7) || ', "totalToolCalls": 3, "durationMs": 1500, "startTime": ' || (o_orderkey * 1000 + 999) || ', "summary": null, "scriptPath": "/w.js", "phases": [{"title": "plan", "detail": "d"}, {"title": "do"}], "workflowProgress": [{"type": "agent", "agentId": "' || o_orderkey || '-a", "label": "one", "model": "m", "state": "done", "attempt": 1, "tokens": ' || o_orderkey || ', "toolCalls": 2, "durationMs": 5, "startedAt": 2999, "phaseIndex": 1, "phaseTitle": "do"}, {"type": "phase", "index": 1}, {"type": "agent", "agentId": "' || o_orderkey || '-b", "startedAt": 1000}]}'"""
_LINE = """'{"type": "' || CASE seq WHEN 3 THEN 'start' ELSE 'result' END || '", "agentId": "' || o_orderkey || '-a", "result": "r' || seq || '"}'"""
WORKFLOW_RUNS = "SELECT CAST(o_orderkey AS VARCHAR) AS run_id, 'w' || (o_orderkey % 5) AS workflow_name, o_orderstatus AS status, o_orderkey % 9 AS agent_count, o_orderkey * 7 AS total_tokens, 3::BIGINT AS total_tool_calls, 1500::BIGINT AS duration_ms, o_orderkey AS started_at, NULL::VARCHAR AS summary, '/w.js' AS script_path, CASE WHEN o_orderkey % 4 = 0 THEN 'cc--s' || o_orderkey END AS orchestrating_session_id FROM orders WHERE o_orderkey % 7 <> 6"
WORKFLOW_PHASES = "SELECT CAST(o_orderkey AS VARCHAR) AS run_id, unnest([0, 1]) AS phase_index, unnest(['plan', 'do']) AS title, unnest(['d', NULL]) AS detail FROM orders WHERE o_orderkey % 7 <> 6"
WORKFLOW_AGENTS = """
SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderkey || '-a' AS agent_id, 'one' AS label, 'm' AS model, 'done' AS state, 1::BIGINT AS attempt, o_orderkey::BIGINT AS tokens, 2::BIGINT AS tool_calls, 5::BIGINT AS duration_ms, 1::BIGINT AS phase_index, 'do' AS phase_title, 2::BIGINT AS started_at, 'r2' AS result, CASE WHEN o_orderkey % 3 = 0 THEN 'cc--' || o_orderkey || '-a' END AS agent_session_id FROM orders WHERE o_orderkey % 7 <> 6
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_orderkey || '-b', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 1, NULL, NULL FROM orders WHERE o_orderkey % 7 <> 6
"""


def _workflows(r: Relations) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders = r.read("orders")
    manifest = F.when(F.col("o_orderkey") % 7 == 6, F.lit("{cut")).otherwise(F.expr(_MANIFEST))
    runs = orders.select(F.col("o_orderkey").cast("string").alias("run_id"), manifest.alias("manifest_json"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("orchestrating_external_id"))
    journal = orders.withColumn("seq", F.explode(F.array(F.lit(2), F.lit(1), F.lit(3)))).select(F.col("o_orderkey").cast("string").alias("run_id"), "seq", F.expr(_LINE).alias("line_json"))
    known = orders.filter("o_orderkey % 4 = 0").select(F.expr("'cc--s' || o_orderkey").alias("id")).unionByName(orders.filter("o_orderkey % 3 = 0").select(F.expr("'cc--' || o_orderkey || '-a'").alias("id")))
    return facts.workflow_facts(runs, journal, known)


def _commands(r: Relations) -> DataFrame:
    return facts.shell_commands(made_calls(r))


def _failures(r: Relations) -> DataFrame:
    shown = F.array(*(F.lit(t.replace("''", "'")) for t, _ in FAILURES))
    return made_calls(r).withColumn("output_preview", F.get(shown, (F.col("idx") % len(FAILURES)).cast("int")))


def _commit_status(r: Relations) -> DataFrame:
    calls = made_calls(r)
    sessions = calls.select(F.col("session_id").alias("id")).distinct()
    sessions = sessions.withColumn("source", F.when(F.col("id").cast("long") % 3 == 0, "cursor").otherwise("claude-code"))
    return facts.commit_status(sessions, facts.git_operations(facts.shell_commands(calls)))


EXTRACTORS = {
    "extract_tool_errors": (ERRORS, lambda r: facts.tool_errors(_failures(r))),
    "extract_user_corrections": (CORRECTIONS, _corrections),
    "extract_corrections_by_kind": (BY_KIND, lambda r: rollups.corrections_by_kind(_corrections(r))),
    "extract_workflow_runs": (WORKFLOW_RUNS, lambda r: _workflows(r)[0]),
    "extract_workflow_phases": (WORKFLOW_PHASES, lambda r: _workflows(r)[1]),
    "extract_workflow_agents": (WORKFLOW_AGENTS, lambda r: _workflows(r)[2]),
    "extract_files_touched": (FILES, lambda r: facts.files_touched(made_calls(r))),
    "extract_shell_commands": (SHELL, lambda r: _commands(r).drop("duration_ms")),
    "extract_git_operations": (GIT, lambda r: facts.git_operations(_commands(r))),
    "extract_commit_status": (COMMITS, _commit_status),
    "extract_skills_invoked": (SKILLS, lambda r: facts.skills_invoked(made_calls(r))),
    "extract_skills_hook_injected": (HOOKED, lambda r: facts.skills_hook_injected(made_hooks(r))),
    "extract_mcp_calls": (MCP, lambda r: facts.mcp_calls(made_calls(r))),
    "extract_web_fetches": (WEB, lambda r: facts.web_fetches(made_calls(r))),
    "extract_todo_events": (TODOS, lambda r: facts.todo_events(made_calls(r))),
    "extract_search_calls": (SEARCHES, lambda r: facts.search_calls(made_calls(r))),
    "extract_subagent_invocations": (DISPATCHES, lambda r: facts.subagent_dispatches(made_calls(r)).drop("stable_key", "output_id", "failed")),
}
