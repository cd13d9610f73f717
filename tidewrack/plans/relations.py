"""The canonical relations laid over a table folder, in Spark and, word for word, in DuckDB SQL.

The tables hold no transcripts, so sessions, messages and tool calls are deterministic views of orders, conversations
and events. Queries take a ``Relations``; the SQL side gets the same relations as common table expressions.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES = [("m0", 10.0, 20.0, 1.0, 12.5), ("m1", 3.0, 15.0, 0.3, None), ("m2", 1.0, 5.0, 0.1, 1.25)]


def _op(name: str) -> str:
    return f"CASE {name} WHEN 'click' THEN 'edit' WHEN 'purchase' THEN 'write' WHEN 'error' THEN 'delete' ELSE 'read' END"


OUTPUT = "CASE WHEN event_type = 'error' THEN CASE k % 6 WHEN 0 THEN 'ENOENT: no such file' WHEN 1 THEN 'Permission denied' WHEN 2 THEN 'request timed out' WHEN 3 THEN 'HTTP 404' WHEN 4 THEN 'File has not been read yet' ELSE 'boom' END ELSE 'ok' END"
SOURCE = "CASE o_orderkey % 5 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude-code' WHEN 2 THEN 'qwen' WHEN 3 THEN 'other' ELSE 'gemini' END"


class Relations:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    def texts(self, table: str) -> DataFrame:
        """A table of texts, which are work to take apart: one of fewer files than there are cores is dealt out to all
        of them, a large one is read as it is."""
        df, cores = self.read(table), self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if len(df.inputFiles()) < cores else df

    @cached_property
    def tool_calls(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        rows = self.read("events").withColumn("k", F.coalesce(k, F.lit(0)))
        turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
        return rows.select(
            F.col("user_id").alias("session_id"), turn.cast("long").alias("turn"), F.lit(0).alias("idx"), F.col("event_type").alias("name"), F.expr("CASE WHEN event_type = 'error' THEN 1 ELSE 0 END").alias("exit_code"),
            F.col("props").alias("args_json"), F.col("props").alias("args_hash"), F.expr(OUTPUT).alias("output_preview"), F.floor(F.col("value") * 1000).cast("long").alias("duration_ms"), "k",
        )

    @cached_property
    def files_touched(self) -> DataFrame:
        return self.tool_calls.select("session_id", "turn", F.expr(_op("name")).alias("op"), F.concat(F.lit("/f/"), F.col("k").cast("string")).alias("path")).distinct()

    @cached_property
    def shell_commands(self) -> DataFrame:
        return self.tool_calls.select("session_id", "turn", "idx", F.col("name").alias("cmd_head"), F.concat_ws(" ", "name", F.col("k").cast("string")).alias("cmd_full"), "exit_code")

    @cached_property
    def messages(self) -> DataFrame:
        tools = F.expr("CASE WHEN role = 'assistant' THEN length(text) % 7 ELSE 0 END")
        return self.read("conversations").select(F.col("conv_id").alias("session_id"), (F.col("turn") + 1).alias("turn"), "role", (F.col("conv_id") * 100 + F.col("turn") * 4).alias("ts"), "text", F.coalesce(tools, F.lit(0)).cast("long").alias("tools"))

    @cached_property
    def sessions(self) -> DataFrame:
        sums = self.read("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("input_tokens"), (F.sum("l_linenumber") * 100).cast("long").alias("output_tokens"), F.sum(F.col("l_partkey") % 50).cast("long").alias("cache_read_tokens"), F.sum(F.col("l_suppkey") % 10).cast("long").alias("cache_creation_tokens"), F.count(F.lit(1)).alias("tool_call_count"))
        joined = self.read("orders").join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        return joined.select(
            F.col("o_orderkey").alias("id"), F.expr(SOURCE).alias("source"), F.concat(F.lit("/p/"), F.col("c_mktsegment"), F.lit("/"), F.col("c_nationkey").cast("string")).alias("project_path"),
            F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("started_at"), F.concat(F.lit("m"), (F.col("o_custkey") % 7).cast("string")).alias("model"),
            "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 400 ELSE NULL END").cast("long").alias("reasoning_tokens"), "tool_call_count",
            F.expr("CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - 1 END").alias("parent_session_id"), F.col("o_orderpriority").alias("title"),
        )

    @cached_property
    def model_prices(self) -> DataFrame:
        return self.spark.createDataFrame(PRICES, "model string, input_per_mtok double, output_per_mtok double, cache_read_per_mtok double, cache_write_per_mtok double")

    @cached_property
    def web_fetches(self) -> DataFrame:
        from tidewrack.operators.facts import domain

        return self.read("pages").select((F.col("page_id") % 40).alias("session_id"), "page_id", "url", domain(F.col("url")).alias("domain"), F.expr("CASE page_id % 3 WHEN 0 THEN 'fetch' WHEN 1 THEN 'search' ELSE 'navigate' END").alias("kind"))

    @cached_property
    def skills_available(self) -> DataFrame:
        return self.tool_calls.select("session_id", F.concat(F.when(F.col("k") % 3 == 0, "pkg:").otherwise(""), F.lit("skill"), (F.col("k") % 12).cast("string")).alias("skill_name")).distinct()

    @cached_property
    def skills_invoked(self) -> DataFrame:
        return self.tool_calls.filter("name = 'purchase'").select("session_id", "turn", F.concat(F.lit("skill"), (F.col("k") % 15).cast("string")).alias("skill_name"))

    @cached_property
    def skills_hook_injected(self) -> DataFrame:
        return self.tool_calls.filter("name = 'signup'").select("session_id", "turn", F.concat(F.lit("skill"), (F.col("k") % 12).cast("string")).alias("skill_slug")).distinct()

    @cached_property
    def mcp_calls(self) -> DataFrame:
        return self.tool_calls.filter("name in ('view', 'click')").select("session_id", "turn", F.concat(F.lit("srv"), (F.col("k") % 4).cast("string")).alias("server"), F.col("name").alias("tool"))

    @cached_property
    def subagent_invocations(self) -> DataFrame:
        return self.sessions.filter("parent_session_id is not null").select(F.col("parent_session_id"), F.expr("CASE WHEN id % 10 = 0 THEN 'task' WHEN id % 15 = 0 THEN NULL ELSE source END").alias("subagent_type"), "started_at", "id")

    @cached_property
    def workflow_runs(self) -> DataFrame:
        return self.read("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("workflow_name"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 9).alias("agent_count"), (F.col("o_orderkey") % 1000 * 7).alias("total_tokens"), (F.col("o_orderkey") % 31).alias("total_tool_calls"), (F.col("o_orderkey") % 977 * 10).alias("duration_ms"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("started_at"))

    @cached_property
    def prompts(self) -> DataFrame:
        return self.texts("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("first_user_prompt"))

    @cached_property
    def corpus(self) -> DataFrame:
        return self.texts("documents").select(F.col("doc_id").alias("doc"), "text", "lang", "source")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").alias("chunk"), F.col("label").cast("long").alias("session_id"), "embedding")


CTES = {
    "tool_calls": f"SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, 0 AS idx, event_type AS name, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS exit_code, props AS args_json, props AS args_hash, {OUTPUT} AS output_preview, CAST(floor(value * 1000) AS BIGINT) AS duration_ms, k FROM (SELECT *, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events)",
    "files_touched": f"SELECT DISTINCT session_id, turn, {_op('name')} AS op, '/f/' || k AS path FROM tool_calls",
    "shell_commands": "SELECT session_id, turn, idx, name AS cmd_head, name || ' ' || k AS cmd_full, exit_code FROM tool_calls",
    "messages": "SELECT conv_id AS session_id, turn + 1 AS turn, role, conv_id * 100 + turn * 4 AS ts, text, coalesce(CASE WHEN role = 'assistant' THEN length(text) % 7 ELSE 0 END, 0)::BIGINT AS tools FROM conversations",
    "sessions": f"SELECT o_orderkey AS id, {SOURCE} AS source, '/p/' || c_mktsegment || '/' || c_nationkey AS project_path, CAST(epoch(o_orderdate) AS BIGINT) AS started_at, 'm' || (o_custkey % 7) AS model, input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 400 END AS reasoning_tokens, tool_call_count, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - 1 END AS parent_session_id, o_orderpriority AS title FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS input_tokens, CAST(sum(l_linenumber) * 100 AS BIGINT) AS output_tokens, CAST(sum(l_partkey % 50) AS BIGINT) AS cache_read_tokens, CAST(sum(l_suppkey % 10) AS BIGINT) AS cache_creation_tokens, count(*) AS tool_call_count FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey",
    "model_prices": "SELECT * FROM (VALUES ('m0', 10.0::DOUBLE, 20.0::DOUBLE, 1.0::DOUBLE, 12.5::DOUBLE), ('m1', 3.0, 15.0, 0.3, NULL), ('m2', 1.0, 5.0, 0.1, 1.25)) AS p(model, input_per_mtok, output_per_mtok, cache_read_per_mtok, cache_write_per_mtok)",
    "web_fetches": "SELECT page_id % 40 AS session_id, page_id, url, lower(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1), '')) AS domain, CASE page_id % 3 WHEN 0 THEN 'fetch' WHEN 1 THEN 'search' ELSE 'navigate' END AS kind FROM pages",
    "skills_available": "SELECT DISTINCT session_id, CASE WHEN k % 3 = 0 THEN 'pkg:' ELSE '' END || 'skill' || (k % 12) AS skill_name FROM tool_calls",
    "skills_invoked": "SELECT session_id, turn, 'skill' || (k % 15) AS skill_name FROM tool_calls WHERE name = 'purchase'",
    "skills_hook_injected": "SELECT DISTINCT session_id, turn, 'skill' || (k % 12) AS skill_slug FROM tool_calls WHERE name = 'signup'",
    "mcp_calls": "SELECT session_id, turn, 'srv' || (k % 4) AS server, name AS tool FROM tool_calls WHERE name IN ('view', 'click')",
    "subagent_invocations": "SELECT parent_session_id, CASE WHEN id % 10 = 0 THEN 'task' WHEN id % 15 = 0 THEN NULL ELSE source END AS subagent_type, started_at, id FROM sessions WHERE parent_session_id IS NOT NULL",
    "workflow_runs": "SELECT o_orderkey AS run_id, o_orderpriority AS workflow_name, o_orderstatus AS status, o_orderkey % 9 AS agent_count, o_orderkey % 1000 * 7 AS total_tokens, o_orderkey % 31 AS total_tool_calls, o_orderkey % 977 * 10 AS duration_ms, CAST(epoch(o_orderdate) AS BIGINT) AS started_at FROM orders",
    "prompts": "SELECT doc_id AS id, text AS first_user_prompt FROM documents",
    "corpus": "SELECT doc_id AS doc, text, lang, source FROM documents",
    "vectors": "SELECT vec_id AS chunk, label::BIGINT AS session_id, embedding FROM embeddings",
    "skills_usage": "SELECT av.session_id, av.skill_name, CASE WHEN EXISTS (SELECT 1 FROM skills_invoked si WHERE si.session_id = av.session_id AND (si.skill_name = av.skill_name OR av.skill_name ILIKE '%:' || si.skill_name OR si.skill_name ILIKE av.skill_name || '%' OR (instr(av.skill_name, ':') > 0 AND substr(av.skill_name, instr(av.skill_name, ':') + 1) = si.skill_name))) THEN 1 WHEN EXISTS (SELECT 1 FROM skills_hook_injected hi WHERE hi.session_id = av.session_id AND (hi.skill_slug = av.skill_name OR av.skill_name ILIKE '%:' || hi.skill_slug OR (instr(av.skill_name, ':') > 0 AND substr(av.skill_name, instr(av.skill_name, ':') + 1) = hi.skill_slug))) THEN 1 ELSE 0 END AS was_used FROM skills_available av",
}


def with_relations(sql: str) -> str:
    """``sql`` with the relations that it names, and those that these need, as common table expressions in order."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(CTES[name])
                if name not in needed:
                    needed.append(name)

    need(sql)
    body = sql.strip()
    heads = ",\n".join(f"{n} AS ({CTES[n]})" for n in needed)
    if not heads:
        return body
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body):
        return f"WITH {m[1] or ''}{heads},\n{body[m.end() :]}"
    return f"WITH {heads}\n{body}"
