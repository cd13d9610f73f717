"""Vector and hybrid retrieval over embedded chunks, and the chunks themselves."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions import patterns as P
from tidewrack.functions.vectors import cosine

CHARS_PER_TOKEN, TARGET, MOST = 4, 1000, 1500
#: Slices of a unit of cosine in which sessions are ranked on their own.
SLICES = 2048


def message_text(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """(session_id, turn, role, text): a message and one line for each of its tool calls."""
    line = F.concat_ws(" ", F.lit("tool:"), "name", F.substring("command", 1, 300), F.concat(F.lit("exit="), F.col("exit_code").cast("string")), F.when(F.col("command").isNull(), F.substring("args_json", 1, 200)))
    lines = calls.groupBy("session_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x["line"]), "\n").alias("tools"))
    joined = messages.join(lines, ["session_id", "turn"], "left")
    return joined.select("session_id", "turn", "role", F.concat_ws("\n", F.concat_ws(": ", "role", "text"), "tools").alias("text"))


def split_long(text: str, budget: int) -> list[str]:
    """A text in pieces of at most ``budget`` characters, cut at line ends where lines fit."""
    pieces, now = [], ""
    for line in text.split("\n"):
        parts = [line[i : i + budget] for i in range(0, len(line), budget)] or [""]
        for part in parts:
            joined = f"{now}\n{part}" if now else part
            if len(joined) > budget:
                pieces.append(now)
                now = part
            else:
                now = joined
    return [p for p in [*pieces, now] if p]


def pack(texts: DataFrame, target: int = TARGET, most: int = MOST) -> DataFrame:
    """Greedy packing of a session's messages, in order, into chunks: (session_id, chunk, start_turn, end_turn, roles,
    tokens, text). A chunk is closed when it has reached ``target`` tokens or the next piece would take it beyond
    ``most``. What has been packed decides what follows, so a session is folded in order, one after the other."""
    schema = "session_id long, chunk int, start_turn long, end_turn long, roles string, tokens long, text string"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, held, size, number = None, [], 0, 0

        def close() -> dict | None:
            nonlocal held, size, number
            if not held:
                return None
            out = {"session_id": session, "chunk": number, "start_turn": held[0][0], "end_turn": held[-1][0], "roles": ",".join(sorted({r for _, r, _ in held})), "tokens": size, "text": "\n\n".join(t for _, _, t in held)}
            held, size, number = [], 0, number + 1
            return out

        for pdf in batches:
            rows = []
            for s, turn, role, text in pdf[["session_id", "turn", "role", "text"]].itertuples(index=False):
                if s != session:
                    rows.append(close())
                    session, number = s, 0
                for piece in split_long(text or "", most * CHARS_PER_TOKEN):
                    n = -(-len(piece) // CHARS_PER_TOKEN)
                    if held and (size >= target or size + n > most):
                        rows.append(close())
                    held.append((turn, role, piece))
                    size += n
            yield pd.DataFrame([r for r in rows if r], columns=[c.split()[0] for c in schema.split(", ")])
        yield pd.DataFrame([r for r in [close()] if r], columns=[c.split()[0] for c in schema.split(", ")])

    # Sorted partitions instead of groups: a session of any length streams through in bounded memory.
    rows = texts.select("session_id", "turn", "role", "text").repartition("session_id").sortWithinPartitions("session_id", "turn")
    return rows.mapInPandas(fold, schema)


def finalize(chunks: DataFrame) -> DataFrame:
    """Chunks redacted, long encoded runs replaced, named by content; those empty or with secrets left out are gone."""
    from tidewrack.functions.text import redact, redaction_counts

    secrets = F.lit(0)
    for c in redaction_counts(F.col("text")).values():
        secrets = secrets + c
    text = F.trim(F.regexp_replace(F.regexp_replace(redact(F.col("text")), r"[A-Za-z0-9+/=]{200,}", "[ENCODED]"), r"\n{3,}", "\n\n"))
    rows = chunks.withColumn("secrets", secrets).withColumn("clean", text).filter("secrets = 0 and clean <> ''")
    return rows.select("session_id", "chunk", "start_turn", "end_turn", "roles", "tokens", F.col("clean").alias("text"), F.sha2("clean", 256).alias("chunk_id"), F.substring("clean", 1, 240).alias("preview"))


def nearest(chunks: DataFrame, query: list[float], k: int, vector: str = "embedding", keys: tuple[str, ...] = ("chunk",)) -> DataFrame:
    """The k chunks of greatest cosine, by an exact scan: a projection and a top-k that combines ahead of its exchange."""
    return scored(chunks, query, vector).orderBy(F.desc("score"), *keys).limit(k)


def scored(chunks: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    """All chunks with their cosine as score."""
    return chunks.withColumn("score", cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in query))))


def query_terms(query: str) -> list[str]:
    """The distinct words of a query of two characters or more, in lower case."""
    return [w for w in dict.fromkeys(re.findall(r"[\w-]+", query.lower())) if len(w) >= 2]


def quality(title: Column, shown: Column) -> Column:
    """0.35 for what looks like a continuation prompt, else 1."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(shown, F.lit(""))))
    found = F.startswith(text, F.lit(P.CONTINUATION_TITLE))
    for phrase in P.CONTINUATIONS:
        found = found | F.contains(text, F.lit(phrase))
    return F.when(found, 0.35).otherwise(1.0)


def adjusted(score: Column, kind: Column, title: Column, shown: Column, query: str) -> Column:
    """Tool summaries count less unless the query is about tools, continuation prompts less still."""
    about_tools = re.search(rf"\b(?:{'|'.join(P.TOOL_QUERY_WORDS)})\b", query, re.I | re.A)
    score = score if about_tools else F.when(kind == "tool_summary", score * 0.65).otherwise(score)
    return score * quality(title, shown)


def covered(text: Column, terms: list[str]) -> Column:
    """Which of the terms a text holds, as an array of booleans."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array(*(F.contains(low, F.lit(t)) for t in terms)) if terms else F.array().cast("array<boolean>")


def best_per_session(scored: DataFrame, cover: Column | None = None, by: str = "session_id", score: str = "score", key: str = "chunk") -> DataFrame:
    """A session's best chunk, taking them in the order of the key: a later one replaces the best so far if its score
    is greater by more than 0.02, or within 0.02 of it and its text covers more of the query's terms. Text passed over
    counts for the best one's coverage, as long as it has fewer than three snippets. One session's chunks meet in a
    task; ``cover`` is made by ``covered``."""
    cover = F.array().cast("array<boolean>") if cover is None else cover
    entry = F.struct(F.col(key).alias("key"), F.col(score).cast("double").alias("score"), cover.alias("cover"))
    listed = scored.groupBy(by).agg(F.array_sort(F.collect_list(entry)).alias("all"))
    covers = lambda x: F.size(F.filter(x["cover"], lambda t: t))

    def fold(best: Column, c: Column) -> Column:
        better = (c["score"] > best["score"] + 0.02) | ((c["score"] >= best["score"] - 0.02) & (covers(c) > covers(best)))
        both = F.when(best["shown"] < 3, F.zip_with(best["cover"], c["cover"], lambda x, y: x | y)).otherwise(best["cover"])
        passed = F.struct(best["key"].alias("key"), best["score"].alias("score"), both.alias("cover"), F.least(best["shown"] + 1, F.lit(3)).alias("shown"))
        return F.when(better, F.struct(c["key"].alias("key"), c["score"].alias("score"), c["cover"].alias("cover"), F.lit(1).alias("shown"))).otherwise(passed)

    first = F.struct(F.col("all")[0]["key"].alias("key"), F.col("all")[0]["score"].alias("score"), F.col("all")[0]["cover"].alias("cover"), F.lit(1).alias("shown"))
    best = listed.withColumn("best", F.aggregate(F.slice("all", F.lit(2), F.size("all")), first, fold))
    return best.select(by, F.col("best.key").alias(key), F.col("best.score").alias(score))


def ranked(semantic: DataFrame, key: str = "session_id") -> DataFrame:
    """``semantic`` (key, score) with semantic_rank, from 0, by score from the greatest and key.

    Equal slices of the scores are numbered on their own and moved up by the counts of the slices ahead, so a list of
    any length is ranked without meeting in one task."""
    rows = semantic.select(key, "score").withColumn("_slice", F.coalesce(F.floor((1 - F.col("score")) * SLICES), F.lit(1 << 40)))
    ahead = rows.groupBy("_slice").count().select(F.col("_slice").alias("_at"), (F.sum("count").over(Window.orderBy("_slice")) - F.col("count")).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy("_slice").orderBy(F.desc("score"), key)) - 1
    return rows.withColumn("_own", own).join(F.broadcast(ahead), F.col("_slice") == F.col("_at")).select(key, "score", (F.col("_own") + F.col("_ahead")).cast("int").alias("semantic_rank"))


def hybrid(lexical: DataFrame, semantic: DataFrame, key: str = "session_id") -> DataFrame:
    """Fusion of two ranked lists (key, score): 0.6 / (lexical rank + 1) + 0.4 * max(0, cosine) / (semantic
    rank + 1), ranks from 0, times the quality of the lexical row, or else of the semantic one, where they have a column
    of that name. The lexical list is a pool, so ranking it in one task is bounded; the semantic one may
    hold every session."""
    of = lambda df: F.col("quality") if "quality" in df.columns else F.lit(None).cast("double")
    a = lexical.select(F.col(key).alias("a_key"), of(lexical).alias("a_quality"), (F.row_number().over(Window.orderBy("score", key)) - 1).alias("lexical_rank"))
    b = ranked(semantic, key).select(F.col(key).alias("b_key"), F.col("score").alias("cosine"), "semantic_rank")
    if "quality" in semantic.columns:
        b = b.join(semantic.select(F.col(key).alias("b_key"), F.col("quality").alias("b_quality")), "b_key")
    else:
        b = b.withColumn("b_quality", F.lit(None).cast("double"))
    both = a.join(b, F.col("a_key") == F.col("b_key"), "full_outer")
    fused = F.coalesce(0.6 / (F.col("lexical_rank") + 1), F.lit(0.0)) + F.coalesce(0.4 * F.greatest(F.lit(0.0), F.col("cosine")) / (F.col("semantic_rank") + 1), F.lit(0.0))
    return both.select(F.coalesce("a_key", "b_key").alias(key), "lexical_rank", "semantic_rank", (fused * F.coalesce("a_quality", "b_quality", F.lit(1.0))).alias("score"))


def pending(chunks: DataFrame, embedded: DataFrame, model_id: str) -> DataFrame:
    """Chunks that a model has not embedded."""
    return chunks.join(embedded.filter(F.col("model_id") == model_id).select("chunk_id"), "chunk_id", "left_anti")


def without_injected(chunks: DataFrame, messages: DataFrame) -> DataFrame:
    """Chunks (session_id, chunk, start_turn, end_turn) whose turns hold no injected message: a chunk's turns meet the
    injected ones by equality. A chunk of unknown turns stays."""
    from tidewrack.functions.text import is_noise

    noisy = messages.filter(is_noise(F.col("text"), blanks_only=True)).select("session_id", "turn").distinct()
    turns = chunks.filter("start_turn <= end_turn").select("session_id", "chunk", F.explode(F.sequence("start_turn", "end_turn")).alias("turn"))
    return chunks.join(turns.join(noisy, ["session_id", "turn"]).select("session_id", "chunk").distinct(), ["session_id", "chunk"], "left_anti")
