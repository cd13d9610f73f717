"""Rollups and top lists over facts. All counts are exact; top lists break ties by key, so that they are stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ONE = F.lit


def _count(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def _sessions(column: str = "session_id", name: str = "sessions") -> Column:
    return F.count_distinct(column).alias(name)


def _n_where(condition: str | Column, name: str) -> Column:
    return F.count_if(F.expr(condition) if isinstance(condition, str) else condition).alias(name)


def top(df: DataFrame, metric: str, keys: list[str], k: int) -> DataFrame:
    return df.orderBy(F.desc(metric), *keys).limit(k)


def month(epoch: str = "started_at") -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM")


def sessions_by_month(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(month().alias("month"), "source").agg(_count("sessions"))


def shell_heads(commands: DataFrame) -> DataFrame:
    return commands.groupBy("cmd_head").agg(_count("runs"), _n_where("exit_code <> 0", "failures"), _sessions())


def files(touched: DataFrame, op: str | None = None) -> DataFrame:
    if op:
        return touched.filter(F.col("op") == op).groupBy("path").agg(_count("ops"), _sessions())
    return touched.groupBy("path").agg(_count("ops"), _n_where("op = 'read'", "reads"), _n_where("op in ('edit', 'write')", "writes"), _sessions())


def corrections_by_kind(corrections: DataFrame) -> DataFrame:
    return corrections.groupBy("kind").agg(_count(), _sessions(), F.sum(F.coalesce("followed_by_revert", F.lit(0))).alias("reverts"), F.avg("preceding_tool_calls").alias("avg_tools_before"))


def failed_commands(commands: DataFrame) -> DataFrame:
    return commands.filter("exit_code <> 0").select("cmd_head", "cmd_full", "session_id", "turn")


def failed_command_counts(commands: DataFrame) -> DataFrame:
    """Failed command lines by how often, each with the first place it was seen at."""
    found = commands.filter("exit_code <> 0").groupBy("cmd_full").agg(_count("failures"), F.min(F.struct("session_id", "turn", "cmd_head")).alias("first"))
    return found.select("cmd_full", "failures", F.col("first.cmd_head").alias("cmd_head"), F.col("first.session_id").alias("session_id"), F.col("first.turn").alias("turn"))


def by_keys(df: DataFrame, keys: list[str], name: str, session: str = "session_id", sessions: str = "sessions") -> DataFrame:
    return df.groupBy(*keys).agg(_count(name), _sessions(session, sessions))


def skills_usage(available: DataFrame, invoked: DataFrame, injected: DataFrame) -> DataFrame:
    """``available`` with was_used: invoked or injected in the same session under the name, a name it ends or begins
    with, or what follows its first colon. Joined on the session, so that no pair crosses sessions."""
    tail = F.when(F.instr("skill_name", ":") > 0, F.substring_index("skill_name", ":", -1))
    skills = available.select("session_id", "skill_name").distinct()
    used = invoked.select("session_id", F.col("skill_name").alias("used"), F.lit(True).alias("prefix")).unionByName(injected.select("session_id", F.col("skill_slug").alias("used"), F.lit(False).alias("prefix"))).distinct()
    name, other = F.lower("skill_name"), F.lower("used")
    after_colon = F.expr("substring(skill_name, instr(skill_name, ':') + 1)")
    fits = (F.col("used") == F.col("skill_name")) | name.endswith(F.concat(F.lit(":"), other)) | (F.col("prefix") & other.startswith(name)) | (tail.isNotNull() & (after_colon == F.col("used")))
    hits = skills.join(used, "session_id").filter(fits).select("session_id", "skill_name").distinct().withColumn("hit", F.lit(1))
    return available.join(hits, ["session_id", "skill_name"], "left").withColumn("was_used", F.coalesce("hit", F.lit(0))).drop("hit")


def skill_shelf(usage: DataFrame) -> DataFrame:
    rows = usage.groupBy("session_id").agg(_count("skills_loaded"), F.sum("was_used").alias("skills_used"))
    return rows.select("session_id", "skills_loaded", "skills_used", (F.col("skills_loaded") - F.col("skills_used")).alias("skills_unused"), F.round(100.0 * F.col("skills_used") / F.col("skills_loaded"), 1).alias("pct_used"))


def skill_dead_weight(usage: DataFrame) -> DataFrame:
    per = usage.groupBy("skill_name", "session_id").agg(F.max("was_used").alias("any"), F.min("was_used").alias("all"))
    rows = per.groupBy("skill_name").agg(_count("sessions_loaded"), F.sum("any").cast("long").alias("sessions_used"), _n_where("all = 0", "unused"))
    return rows.select("skill_name", "sessions_loaded", "sessions_used", (F.col("sessions_loaded") - F.col("sessions_used")).alias("sessions_never_used"), F.round(100.0 * F.col("unused") / F.nullif("sessions_loaded", F.lit(0)), 1).alias("pct_sessions_unused"))


def self_resolutions(found: DataFrame, sessions: DataFrame) -> DataFrame:
    return found.join(sessions.select(F.col("id").alias("session_id"), "project_path"), "session_id")


def workflow_scripts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("workflow_name").agg(_count("runs"), F.sum("agent_count").alias("agents"), F.sum("total_tokens").alias("tokens"), F.sum("total_tool_calls").alias("tool_calls"), F.sum("duration_ms").alias("duration_ms"))


def timeline(sessions: DataFrame, bucket: str) -> DataFrame:
    """Sessions and tool calls by day, week (Monday based, 00 before the first Monday) or month, and source."""
    at = F.timestamp_seconds("started_at")
    week = F.floor((F.dayofyear(at) + 6 - F.weekday(at)) / 7)
    label = {"day": F.date_format(at, "yyyy-MM-dd"), "month": F.date_format(at, "yyyy-MM"), "week": F.concat(F.date_format(at, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))}[bucket]
    return sessions.groupBy(label.alias("bucket"), "source").agg(_count("sessions"), F.sum(F.coalesce("tool_call_count", F.lit(0))).alias("tool_calls"))


def with_children(sessions: DataFrame) -> DataFrame:
    """``sessions`` with subagent_count and has_subagents from the sessions that name them as parent."""
    counts = sessions.filter("parent_session_id is not null").groupBy(F.col("parent_session_id").alias("p")).agg(_count("children"))
    joined = sessions.drop("subagent_count", "has_subagents").join(counts, F.col("id") == F.col("p"), "left")
    return joined.withColumn("subagent_count", F.coalesce("children", F.lit(0))).withColumn("has_subagents", (F.col("subagent_count") > 0).cast("int")).drop("p", "children")


def session_counters(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """Per session: turns by role, tool calls and errors, first and last user prompt (500 characters)."""
    is_user = F.col("role") == "user"
    prompt = F.when(is_user, F.struct("turn", F.substring("text", 1, 500).alias("text")))
    m = messages.groupBy("session_id").agg(
        _count("turn_count"), _n_where(is_user, "user_turn_count"), _n_where("role = 'assistant'", "assistant_turn_count"),
        F.min(prompt).alias("first"), F.max(prompt).alias("last"),
    )
    c = calls.groupBy("session_id").agg(_count("tool_call_count"), _n_where("exit_code <> 0", "tool_error_count"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return m.join(c, "session_id", "left").select("session_id", "turn_count", "user_turn_count", "assistant_turn_count", zero("tool_call_count"), zero("tool_error_count"), F.col("first.text").alias("first_user_prompt"), F.col("last.text").alias("last_user_prompt"))


def stats(sessions: DataFrame, messages: DataFrame, calls: DataFrame, touched: DataFrame) -> DataFrame:
    """Corpus totals as (metric, value) rows: one aggregate a relation."""
    parts = [
        sessions.agg(_count("sessions"), F.count_distinct("source").alias("sources"), F.count_distinct("project_path").alias("projects"), F.min("started_at").alias("first_started_at"), F.max("started_at").alias("last_started_at")),
        messages.agg(_count("messages"), _n_where("role = 'user'", "user_messages")),
        calls.agg(_count("tool_calls"), _n_where("exit_code <> 0", "tool_errors")),
        touched.agg(_count("files_touched"), F.count_distinct("path").alias("paths")),
    ]
    rows = None
    for p in parts:
        long = p.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in p.columns))).alias("m")).select("m.*")
        rows = long if rows is None else rows.unionByName(long)
    return rows


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First writer wins: one row a key, by a stated order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
