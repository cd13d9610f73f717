"""Lists of sessions, one session by any of its names, and its transcript as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.limits import BadArgument

LIST_COLUMNS = ("id", "source", "project_path", "git_branch", "model", "title", "agent_type", "parent_session_id", "started_at", "ended_at", "duration_s", "turn_count", "tool_call_count", "tool_error_count")
SHORTEST_ID, SCANNED, SHOWN = 4, 6, 5


class AmbiguousId(BadArgument):
    """A prefix that several sessions share."""


def in_project(path: str, column: str = "project_path") -> Column:
    """The project itself or a folder below it."""
    base = path.rstrip("/")
    return (F.col(column) == base) | F.startswith(F.col(column), F.lit(base + "/"))


def infer_project(projects: DataFrame, cwd: str) -> DataFrame:
    """One row at most: the known project that is ``cwd``, else the deepest one above it, else the shortest below."""
    here = cwd.rstrip("/")
    p = F.col("project_path")
    rank = F.when(p == here, 0).when(F.startswith(F.lit(here), F.concat(p, F.lit("/"))), 1).when(F.startswith(p, F.lit(here + "/")), 2)
    ranked = projects.select("project_path").distinct().withColumn("rank", rank).filter("rank is not null")
    return ranked.orderBy("rank", F.when(F.col("rank") == 1, -F.length(p)).otherwise(F.length(p)), "project_path").limit(1).select("project_path")


def listing(sessions: DataFrame, *, source: str | None = None, project: str | None = None, since: int | None = None, until: int | None = None, has_subagents: bool = False, root_only: bool = False, parent: str | None = None, agent_type: str | None = None, min_turns: int | None = None, where: str | None = None) -> DataFrame:
    """Sessions that satisfy all given predicates, newest first. ``project`` is a prefix in which % and _ stay
    wildcards and case is ignored; ``where`` is SQL text, a predicate of its own."""
    tests = [
        F.col("source") == source if source else None,
        F.col("project_path").ilike(f"{project}%") if project else None,
        F.col("started_at") >= since if since is not None else None,
        F.col("started_at") < until if until is not None else None,
        F.col("parent_session_id").isNull() if root_only else None,
        F.col("parent_session_id") == parent if parent else None,
        F.col("agent_type") == agent_type if agent_type else None,
        F.col("turn_count") >= min_turns if min_turns is not None else None,
        F.expr(f"({where})") if where else None,
    ]
    found = sessions.filter(reduce(lambda a, b: a & b, [t for t in tests if t is not None], F.lit(True)))
    if has_subagents:
        parents = sessions.filter("parent_session_id is not null").select(F.col("parent_session_id").alias("_p")).distinct()
        found = found.join(parents, F.col("id") == F.col("_p"), "left_semi")
    return found.orderBy(F.desc("started_at"), "id")


def derived(rows: DataFrame) -> DataFrame:
    """ISO times, a 240-character preview and the call that shows a session."""
    iso = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return rows.withColumns({"started_at_iso": iso("started_at"), "prompt_preview": F.substring("first_user_prompt", 1, 240), "reconstruct": F.concat(F.lit("session "), F.col("id"))})


def resolve(sessions: DataFrame, name: str) -> str | None:
    """The id that ``name`` means: an id itself; else what follows ``--`` in one, or an external id, if unique; else a
    unique prefix of at least four characters, of an id or of what follows ``--``. One scan ranks all three; a handful
    of rows come back."""
    suffix = F.substring_index("id", "--", -1)
    by_name = (suffix == name) | (F.col("external_id") == name)
    prefix = (F.startswith(F.col("id"), F.lit(name)) | F.startswith(suffix, F.lit(name))) if len(name) >= SHORTEST_ID else F.lit(False)
    rank = F.when(F.col("id") == name, 0).when(by_name, 1).when(prefix, 2)
    found = sessions.select("id", rank.alias("rank")).filter("rank is not null").orderBy("rank", "id").limit(SCANNED).collect()
    if not found:
        return None
    best = [r["id"] for r in found if r["rank"] == found[0]["rank"]]
    if len(best) > 1:
        raise AmbiguousId(f"{name} may be {', '.join(best[:SHOWN])}")
    return best[0]


def turns(messages: DataFrame, session_id: str, head: int | None = None, tail: int | None = None, between: tuple[int, int] | None = None) -> DataFrame:
    """A session's messages by turn: the first, the last, or those of an inclusive range of turns."""
    if sum(x is not None for x in (head, tail, between)) > 1:
        raise BadArgument("one of head, tail and a range of turns")
    own = messages.filter(F.col("session_id") == session_id)
    if between:
        own = own.filter(F.col("turn").between(*between))
    elif head is not None:
        own = own.orderBy("turn").limit(head)
    elif tail is not None:
        own = own.orderBy(F.desc("turn")).limit(tail)
    return own.orderBy("turn")


def markdown(sessions: DataFrame, messages: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, markdown): a header, the turns, and their tool calls, outputs cut at 1,000 and arguments at 120
    characters. Lines are put in order within a session by sorted arrays, in the JVM."""
    call = F.concat(F.lit("- `"), F.col("name"), F.lit("` "), F.coalesce(F.substring("args_json", 1, 120), F.lit("")), F.when(F.col("output_preview").isNotNull(), F.concat(F.lit("\n\n```\n"), F.substring("output_preview", 1, 1000), F.lit("\n```"))).otherwise(F.lit("")))
    said = messages.select("session_id", "turn", F.lit(-1).alias("idx"), F.concat(F.lit("## "), F.col("turn").cast("string"), F.lit(" · "), F.col("role"), F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("part"))
    done = calls.select("session_id", "turn", "idx", call.alias("part"))
    body = said.unionByName(done).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "idx", "part"))), lambda p: p["part"]), "\n\n").alias("body"))
    head = F.concat(F.lit("# "), F.coalesce("title", "id"), F.lit("\n\n"), F.concat_ws(" · ", "source", "model", "project_path"))
    return sessions.join(body, F.col("id") == F.col("session_id"), "left").select("id", F.concat_ws("\n\n", head, "body").alias("markdown"))


#: Headings of skill listings and the origin that they give.
ORIGINS = {"user": "user", "user skills": "user", "project": "project", "project skills": "project", "plugin": "plugin", "plugins": "plugin", "plugin skills": "plugin", "bundled": "bundled", "built-in": "bundled"}


def skill_listings(raw_events: DataFrame) -> DataFrame:
    """skills_available from raw events (session_id, seq, raw_json): one row a session and skill, from the last
    listing that names it. A heading carries its origin forward to the lines below it."""
    doc = raw_events.select("session_id", "seq", F.try_parse_json("raw_json").alias("j"))
    listed = doc.filter(F.try_variant_get("j", "$.attachment.type", "string") == "skill_listing")
    listed = listed.select("session_id", "seq", F.coalesce(F.try_variant_get("j", "$.attachment.isInitial", "boolean"), F.lit(False)).cast("int").alias("is_initial"), F.posexplode(F.split(F.try_variant_get("j", "$.attachment.content", "string"), "\n")).alias("at", "line"))
    line = F.trim(F.col("line"))
    heading = F.lower(F.trim(F.regexp_extract(line, r"^#{1,3}\s+(.+)$", 1)))
    origin = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in ORIGINS.items() for x in kv)), heading), F.lit("unknown"))
    so_far = Window.partitionBy("session_id", "seq").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = listed.withColumn("origin", F.coalesce(F.last(F.when(heading != "", origin), ignorenulls=True).over(so_far), F.lit("unknown")))
    rows = rows.select("session_id", "seq", "at", "is_initial", "origin", F.trim(F.regexp_extract(line, r"^- (.+?): ", 1)).alias("skill_name"), F.trim(F.regexp_extract(line, r"^- .+?: (.*)$", 1)).alias("description")).filter("skill_name <> ''")
    last = rows.groupBy("session_id", "skill_name").agg(F.max_by(F.struct("description", "origin", F.col("seq").alias("source_seq"), "is_initial"), F.struct("seq", "at")).alias("x"))
    return last.select("session_id", "skill_name", "x.description", "x.origin", "x.source_seq", "x.is_initial")
