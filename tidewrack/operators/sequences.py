"""What happens one after the other within a session: window functions partitioned by session, ordered by (turn, idx)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ARROW = " → "


def _calls() -> Window:
    return Window.partitionBy("session_id").orderBy("turn", "idx")


def tool_ngrams(calls: DataFrame, sizes: tuple[int, ...] = (2, 3, 4), least: int = 3) -> DataFrame:
    """n, sequence, count, sessions and an example (the first by session, turn, idx) of every run of n tools that
    occurs ``least`` times. One window computes all sizes; counting combines ahead of its shuffle."""
    ahead = [F.col("name")] + [F.lead("name", k).over(_calls()) for k in range(1, max(sizes))]
    rows = calls.select("session_id", "turn", "idx", *(a.alias(f"n{k}") for k, a in enumerate(ahead)))
    grams = F.array(*(F.when(F.col(f"n{n - 1}").isNotNull(), F.struct(F.lit(n).alias("n"), F.concat_ws(ARROW, *(f"n{k}" for k in range(n))).alias("sequence"))) for n in sizes))
    rows = rows.select("session_id", "turn", "idx", F.explode(F.filter(grams, lambda g: g.isNotNull())).alias("g")).select("g.n", "g.sequence", "session_id", "turn", "idx")
    # Once by session, once over all: distinct sessions are counted without holding them together.
    inner = rows.groupBy("n", "sequence", "session_id").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("turn", "idx")).alias("first"))
    outer = inner.groupBy("n", "sequence").agg(F.sum("c").alias("count"), F.count(F.lit(1)).alias("sessions"), F.min(F.struct("session_id", "first")).alias("x"))
    return outer.filter(F.col("count") >= least).select("n", "sequence", "count", "sessions", F.col("x.session_id").alias("example_session_id"), F.col("x.first.turn").alias("example_turn"))


def retries(commands: DataFrame, within: int = 3) -> DataFrame:
    """Failed commands that the session runs again within so many turns."""
    again = F.lead("turn").over(Window.partitionBy("session_id", "cmd_full").orderBy("turn", "idx"))
    rows = commands.withColumn("next_turn", again).filter("exit_code <> 0").filter(F.col("next_turn") - F.col("turn") <= within)
    return rows.select("session_id", "turn", F.lit("retry_same_cmd").alias("type"), F.substring("cmd_full", 1, 300).alias("context"))


def error_loops(calls: DataFrame, least: int = 3) -> DataFrame:
    """Runs of consecutive failures of one tool: session_id, name, start_turn, end_turn, length."""
    failed = F.coalesce(F.col("exit_code") != 0, F.lit(False))
    rows = calls.withColumn("failed", failed).withColumn("at", F.row_number().over(_calls()))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("session_id", "name", "failed").orderBy("turn", "idx"))).filter("failed")
    runs = rows.groupBy("session_id", "name", (F.col("at") - F.col("nth")).alias("island")).agg(F.min("turn").alias("start_turn"), F.max("turn").alias("end_turn"), F.count(F.lit(1)).alias("length"))
    return runs.filter(F.col("length") >= least).drop("island")


def long_chains(messages: DataFrame, least: int = 10) -> DataFrame:
    """Stretches between user messages with so many tool calls: session_id, start_turn (0 before the first user
    message), tool_calls. Calls on user messages do not count."""
    so_far = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_user = F.col("role") == "user"
    rows = messages.withColumn("stretch", F.sum(F.when(is_user, 1).otherwise(0)).over(so_far))
    runs = rows.groupBy("session_id", "stretch").agg(F.coalesce(F.max(F.when(is_user, F.col("turn"))), F.lit(0)).alias("start_turn"), F.sum(F.when(is_user, 0).otherwise(F.col("tools"))).alias("tool_calls"))
    return runs.filter(F.col("tool_calls") >= least).drop("stretch")


def repeated_reads(files: DataFrame, least: int = 4) -> DataFrame:
    reads = files.filter("op = 'read'").select("session_id", "path", "turn").distinct().groupBy("session_id", "path")
    return reads.agg(F.count(F.lit(1)).alias("reads"), F.min("turn").alias("turn")).filter(F.col("reads") >= least)


def friction_events(calls: DataFrame, commands: DataFrame, files: DataFrame, messages: DataFrame) -> DataFrame:
    """All kinds of friction as (session_id, turn, idx, type, context); idx counts within a session."""
    parts = [
        retries(commands),
        repeated_reads(files).select("session_id", "turn", F.lit("repeated_read").alias("type"), F.col("path").alias("context")),
        error_loops(calls).select("session_id", F.col("start_turn").alias("turn"), F.lit("tool_error_loop").alias("type"), F.concat_ws(" x", "name", "length").alias("context")),
        long_chains(messages).select("session_id", F.col("start_turn").alias("turn"), F.lit("long_unproductive_chain").alias("type"), F.concat(F.col("tool_calls").cast("string"), F.lit(" tool calls")).alias("context")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("session_id").orderBy("type", "turn", "context")) - 1)


def self_resolutions(calls: DataFrame, messages: DataFrame) -> DataFrame:
    """Calls that failed and later passed with the same arguments, no user message in between: session_id, args_hash,
    fail_turn, ok_turn, gap_turns, the earliest of each over all valid pairs.

    A user message between the two splits a session into stretches, and a pair is valid when both lie in one; so
    pairs are met as aggregates of (session, stretch, args) and no row is joined with another."""
    marks = messages.filter("role = 'user'").select("session_id", "turn", F.lit(-1).alias("idx"), F.lit(1).alias("mark"))
    rows = calls.select("session_id", "turn", "idx", F.lit(0).alias("mark"), "args_hash", F.coalesce("exit_code", F.lit(None)).alias("exit_code"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    turn_users = F.max("mark").over(Window.partitionBy("session_id", "turn"))
    stretch = F.sum("mark").over(Window.partitionBy("session_id").orderBy("turn", "idx").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = both.withColumn("user_turn", turn_users).withColumn("stretch", stretch).filter("mark = 0 and user_turn = 0 and args_hash is not null")
    key = ["session_id", "args_hash", "stretch"]
    rows = rows.withColumn("failed_before", F.min(F.when(F.col("exit_code") != 0, F.col("turn"))).over(Window.partitionBy(*key).orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)))
    pairs = rows.filter("exit_code = 0 and failed_before is not null").groupBy("session_id", "args_hash").agg(F.min("failed_before").alias("fail_turn"), F.min("turn").alias("ok_turn"))
    return pairs.withColumn("gap_turns", F.col("ok_turn") - F.col("fail_turn"))


#: Turns of a block: a span of turns meets the rows of the blocks that it touches, not those of a whole session.
BLOCK = 64


def resolution_context(pairs: DataFrame, calls: DataFrame, messages: DataFrame) -> DataFrame:
    """``pairs`` with the calls and assistant texts strictly between failure and success, as JSON."""
    key = ["session_id", "args_hash", "fail_turn"]
    blocks = F.sequence(F.floor((F.col("fail_turn") + 1) / BLOCK), F.floor(F.greatest(F.col("ok_turn") - 1, F.col("fail_turn") + 1) / BLOCK))
    spans = pairs.select(*key, "ok_turn", F.explode(blocks).alias("block"))

    def between(rows: DataFrame, *columns: str) -> DataFrame:
        placed = rows.select("session_id", F.floor(F.col("turn") / BLOCK).alias("block"), F.col("turn").alias("at"), *columns)
        return spans.join(placed, ["session_id", "block"]).filter("at > fail_turn and at < ok_turn").groupBy(*key)

    called = between(calls, "idx", "name").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("at").alias("turn"), "idx", "name")))).alias("resolution_tool_calls_json"))
    said = between(messages.filter("role = 'assistant'"), "text").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda t: t["text"])).alias("resolution_texts_json"))
    return pairs.join(called, key, "left").join(said, key, "left")


def previous_assistant(messages: DataFrame) -> DataFrame:
    """For each user turn the nearest assistant turn before it."""
    before = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("role") == "assistant", F.col("turn")), ignorenulls=True).over(before)
    return messages.withColumn("preceding_turn", last).filter("role = 'user'").select("session_id", "turn", "preceding_turn")
