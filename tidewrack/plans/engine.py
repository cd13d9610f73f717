"""The command surface: one object over a corpus folder or a dict of relations, answers as result envelopes."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions.limits import BadArgument, instant, limit
from tidewrack.functions.patterns import INJECTED_PREFIXES as INJECTED
from tidewrack.functions.text import is_noise
from tidewrack.functions.vectors import embed_terms
from tidewrack.operators import costs, embedding, lineage, retrieval, rollups, search, sequences, sessions, upkeep
from tidewrack.plans import sqlgate
from tidewrack.plans.contract import Envelope, NotFound, page, shape

VERSION = "0.2"


def rows(df: DataFrame) -> list[dict]:
    """Rows for an answer; callers have put a limit on the plan."""
    return [r.asDict(recursive=True) for r in df.collect()]


class Engine:
    """Commands over relations: sessions, messages, tool_calls and, where there, facts by their names."""

    def __init__(self, spark: SparkSession, relations: dict[str, DataFrame], register: bool = True):
        self.spark, self.r = spark, relations
        if register:
            for name, df in relations.items():
                df.createOrReplaceTempView(name)

    def run(self, command: str, action: Callable[[], Any], warnings: list[str] | None = None) -> Envelope:
        try:
            return Envelope(command, action(), warnings=[*(warnings or []), *self.stale()])
        except BadArgument as bad:
            return Envelope(command, status="error", errors=[str(bad)], problems=[shape(bad)])

    def stale(self) -> list[str]:
        if "dirty" not in self.r:
            return []
        n = self.r["dirty"].count()
        return [f"EXTRACTION_PENDING: {n} sessions"] if n else []

    # Lists -------------------------------------------------------------------------------------------------------
    def sessions(self, n: object = None, since: str | None = None, until: str | None = None, **tests: Any) -> Envelope:
        def found() -> list[dict]:
            if tests.get("where"):
                tests["where"] = sqlgate.predicate(self.spark, tests["where"])
            matching = sessions.listing(self.r["sessions"], since=since and instant(since), until=until and instant(until, until=True), **tests)
            totals.append(matching.count())
            return rows(matching.limit(limit("sessions", n)))

        totals: list[int] = []
        answer = self.run("sessions", found)
        answer.pagination = page(len(answer.data), totals[0]) if answer.status == "ok" else None
        return answer

    def session(self, name: str, head: int | None = None, tail: int | None = None, between: tuple[int, int] | None = None, show_context: bool = False) -> Envelope:
        """A session's messages and calls; with ``show_context`` the whole outputs of its calls, from where they are
        kept apart."""

        def find() -> dict:
            found = sessions.resolve(self.r["sessions"], name)
            if found is None:
                raise NotFound(f"no session {name}")
            said = sessions.turns(self.r["messages"], found, head, tail, between)
            calls = self.r["tool_calls"].filter(F.col("session_id") == found).join(said.select("turn"), "turn", "left_semi")
            if show_context:
                calls = calls.join(self.r["tool_outputs"].filter(F.col("session_id") == found).select("turn", "idx", "output"), ["turn", "idx"], "left")
            calls = calls.orderBy("turn", "idx")
            return {"session": rows(self.r["sessions"].filter(F.col("id") == found))[0], "messages": rows(said), "tool_calls": rows(calls)}

        return self.run("session", find)

    def timeline(self, bucket: str = "day", n: object = None) -> Envelope:
        if bucket not in ("day", "week", "month"):
            return Envelope("timeline", status="error", errors=["bucket is day, week or month"])
        return self.run("timeline", lambda: rows(rollups.timeline(self.r["sessions"], bucket).orderBy(F.desc("bucket"), "source").limit(limit("timeline", n))))

    def _dated(self, facts: DataFrame, since: str | None, until: str | None, key: str = "session_id") -> DataFrame:
        """Facts of sessions that began in a span; all facts where none is given."""
        if not since and not until:
            return facts
        at = F.col("started_at")
        own = self.r["sessions"].filter((at >= instant(since) if since else F.lit(True)) & (at < instant(until, until=True) if until else F.lit(True)))
        return facts.join(own.select(F.col("id").alias(key)), key, "left_semi")

    def top(self, what: str, n: object = None, since: str | None = None, until: str | None = None, **options: Any) -> Envelope:
        """The most frequent of something. Every list can be narrowed to sessions of a span where its facts have one;
        the other options are those of the command line of each list."""
        r, opt = self.r, options.get

        def of_sessions(facts: DataFrame, *columns: str) -> DataFrame:
            return facts.join(r["sessions"].select(F.col("id").alias("session_id"), *columns), "session_id")

        def prefixed(facts: DataFrame, column: str, option: str) -> DataFrame:
            return facts.filter(F.col(column).ilike(f"{opt(option)}%")) if opt(option) else facts

        def corrections() -> DataFrame:
            by = opt("by", "kind")
            if by not in ("kind", "project", "source"):
                raise BadArgument("by is kind, project or source")
            if by == "kind":
                return rollups.corrections_by_kind(r["user_corrections"]).orderBy(F.desc("n"), "kind").limit(k)
            column = {"project": "project_path", "source": "source"}[by]
            return rollups.top(rollups.by_keys(of_sessions(r["user_corrections"], column), [column], "n"), "n", [column], k)

        def commands() -> DataFrame:
            own = r["shell_commands"].filter(F.col("cmd_head") == opt("head")) if opt("head") else r["shell_commands"]
            return rollups.top(rollups.failed_command_counts(own), "failures", ["cmd_full"], k) if opt("failed") else rollups.top(rollups.shell_heads(own), "runs", ["cmd_head"], k)

        def grams() -> DataFrame:
            size = int(opt("n_gram", 3))
            if size not in (2, 3, 4):
                raise BadArgument("sequences have 2, 3 or 4 steps")
            calls = of_sessions(r["tool_calls"], "project_path").filter(F.col("project_path").ilike(f"%{opt('project')}%")).drop("project_path") if opt("project") else r["tool_calls"]
            return rollups.top(sequences.tool_ngrams(calls, (size,), int(opt("min_count", 3))), "count", ["sequence"], k)

        def resolutions() -> DataFrame:
            found = sequences.self_resolutions(r["tool_calls"], r["messages"])
            found = found.filter(F.col("gap_turns") >= int(opt("min_gap", 0)))
            if opt("tool"):
                own = r["tool_calls"].filter(F.col("name") == opt("tool")).select("session_id", "args_hash").distinct()
                found = found.join(own, ["session_id", "args_hash"], "left_semi")
            found = rollups.top(rollups.self_resolutions(found, r["sessions"]), "gap_turns", ["session_id", "args_hash"], k)
            return sequences.resolution_context(found, r["tool_calls"], r["messages"]).orderBy(F.desc("gap_turns"), "session_id", "args_hash") if opt("show_context") else found

        def subagents() -> DataFrame:
            own = self._dated(r["subagent_invocations"], since, until, "parent_session_id")
            return rollups.top(own.groupBy("subagent_type").agg(F.count(F.lit(1)).alias("dispatches"), F.count_distinct("parent_session_id").alias("sessions")), "dispatches", ["subagent_type"], k)

        plans: dict[str, Callable[[], DataFrame]] = {
            "files": lambda: rollups.top(rollups.files(r["files_touched"], opt("op")), "ops", ["path"], k),
            "commands": commands,
            "sequences": grams,
            "skills": lambda: rollups.top(rollups.by_keys(self._dated(r["skills_invoked"], since, until), ["skill_name"], "invocations"), "invocations", ["skill_name"], k),
            "mcp": lambda: rollups.top(rollups.by_keys(prefixed(r["mcp_calls"], "server", "server"), ["server", "tool"], "calls"), "calls", ["server", "tool"], k),
            "web": lambda: rollups.top(rollups.by_keys(prefixed(r["web_fetches"], "domain", "domain"), ["domain", "kind"], "hits"), "hits", ["domain", "kind"], k),
            "errors": lambda: rollups.top(rollups.by_keys(r["tool_errors"].filter(F.col("tool_name") == opt("tool")) if opt("tool") else r["tool_errors"], ["tool_name", "error_category"], "n"), "n", ["tool_name", "error_category"], k),
            "tokens": lambda: rollups.top(costs.tokens_by(r["sessions"], r["model_prices"], opt("by", "model"), check=True), "volume", ["key"], k),
            "corrections": corrections,
            "prompts": lambda: rollups.top(r["prompt_templates"], "count", ["hash"], k),
            "subagents": subagents,
            "self-resolutions": resolutions,
        }
        if what not in plans:
            return Envelope("top", status="error", errors=[f"top knows {', '.join(plans)}"])
        k = limit("top_mcp" if what == "mcp" else "top_sequences" if what == "sequences" else "top", n)
        answer = self.run(f"top {what}", lambda: rows(plans[what]()))
        if what == "tokens" and answer.status == "ok":
            answer.warnings += costs.warnings(r["sessions"], r["model_prices"])
        return answer

    def stats(self) -> Envelope:
        """Totals of every relation there is, sessions by source, the span of time and the ten busiest projects."""

        def found() -> dict:
            own = self.r["sessions"]
            known = ("sessions", "messages", "tool_calls", "shell_commands", "user_corrections", "tool_errors")
            totals = {name: self.r[name].count() for name in known if name in self.r}
            if "files_touched" in self.r:
                events, paths = self.r["files_touched"].agg(F.count(F.lit(1)), F.count_distinct("path")).first()
                totals |= {"file_touch_events": events, "files_touched": paths}
            first, last = own.agg(F.min("started_at"), F.max("started_at")).first()
            sources = own.groupBy("source").agg(F.count(F.lit(1)).alias("sessions"), F.sum("turn_count").alias("turns"), F.sum("tool_call_count").alias("tool_calls")).orderBy("source")
            projects = own.filter("project_path is not null").groupBy("project_path").agg(F.count(F.lit(1)).alias("sessions"))
            return {"totals": totals, "by_source": rows(sources), "date_range": {"earliest": first, "latest": last}, "top_projects": rows(rollups.top(projects, "sessions", ["project_path"], 10))}

        return self.run("stats", found)

    def workflows(self, n: object = None, sort: str = "recent", name: str | None = None, status: str | None = None) -> Envelope:
        """Workflow runs with the project of the session that led them, by one of the known orders."""
        orders = {"recent": "started_at", "tokens": "total_tokens", "agents": "agent_count", "duration": "duration_ms", "tools": "total_tool_calls"}
        if sort not in orders:
            return Envelope("workflows", status="error", errors=[f"sort is one of {', '.join(orders)}"])

        def found() -> list[dict]:
            runs = self._runs()
            for column, value in (("workflow_name", name), ("status", status)):
                runs = runs.filter(F.col(column) == value) if value else runs
            return rows(runs.orderBy(F.desc_nulls_last(orders[sort]), "run_id").limit(limit("top", n)))

        return self.run("workflows", found)

    def _runs(self) -> DataFrame:
        own = self.r["sessions"].select(F.col("id").alias("s_id"), "project_path")
        return self.r["workflow_runs"].join(own, F.col("orchestrating_session_id") == F.col("s_id"), "left").drop("s_id")

    def workflow(self, run_id: str) -> Envelope:
        """One run with its phases and agents, results cut to 2,000 characters."""

        def found() -> dict:
            run = rows(self._runs().filter(F.col("run_id") == run_id).limit(1))
            if not run:
                raise NotFound(f"no workflow run {run_id}")
            agents = self.r["workflow_agents"].filter(F.col("run_id") == run_id).withColumns({"result_bytes": F.coalesce(F.octet_length("result"), F.lit(0)), "result": F.substring("result", 1, 2000)})
            phases = self.r["workflow_run_phases"].filter(F.col("run_id") == run_id).orderBy("phase_index")
            return {"run": run[0], "phases": rows(phases), "agents": rows(agents.orderBy("phase_index", "started_at", "agent_id"))}

        return self.run("workflow", found)

    def query(self, sql: str, n: object = None) -> Envelope:
        def ask() -> dict:
            answer = sqlgate.query(self.spark, sql, n)
            return {"rows": rows(answer.rows), "row_count": answer.row_count, "truncated": answer.truncated}

        return self.run("query", ask)

    def schema(self, table: str | None = None) -> Envelope:
        if table is None:
            return self.run("schema", lambda: sorted(self.r))
        if table not in self.r:
            return Envelope("schema", status="error", errors=[f"no table {table}; {', '.join(sqlgate.closest(table, sorted(self.r)))}"])
        return self.run("schema", lambda: [{"name": f.name, "type": f.dataType.simpleString()} for f in self.r[table].schema.fields])

    # Search ------------------------------------------------------------------------------------------------------
    def _texts(self, source: str | None = None, project: str | None = None, role: str | None = None, since: str | None = None, until: str | None = None, root_only: bool = False, include_injected: bool = True) -> DataFrame:
        own = self.r["messages"].join(self.r["sessions"].select(F.col("id").alias("session_id"), "source", "project_path", "started_at", "title", "parent_session_id"), "session_id")
        tests = (
            F.col("source") == source if source else None, sessions.in_project(project) if project else None, F.col("role") == role if role else None,
            F.col("started_at") >= instant(since) if since else None, F.col("started_at") < instant(until, until=True) if until else None,
            F.col("parent_session_id").isNull() if root_only else None, None if include_injected else ~is_noise(F.col("text"), blanks_only=True),
        )
        for test in tests:
            own = own.filter(test) if test is not None else own
        return own.withColumn("doc", F.struct("session_id", "turn"))

    def fts(self, text: str, n: object = None, **scope: Any) -> Envelope:
        """Messages that match a boolean query, best first; a query that cannot be parsed is tried once more with its
        odd words in quotes."""

        def ask(q: str) -> list[dict]:
            own = self._texts(**scope)
            index = search.TextIndex.of(own)
            terms = search._terms(q)
            hits = index.bm25(terms).join(index.match(q), "doc", "left_semi").orderBy("score", "doc").limit(limit("fts", n))
            found = hits.join(own.select("doc", "text"), "doc").orderBy("score", "doc").collect()
            return [{"session_id": r["doc"]["session_id"], "turn": r["doc"]["turn"], "score": r["score"], "snippet": search.snippet(r["text"] or "", terms)} for r in found]

        try:
            return self.run("fts", lambda: ask(text))
        except search.BadQuery:
            return self.run("fts", lambda: ask(search.sanitize(text)), ["QUERY_SANITIZED"])

    def similar(self, text: str, mode: str = "auto", n: object = None, exclude: list[str] | None = None, **scope: Any) -> Envelope:
        """Sessions like a text: lexical, by embedding, or both fused. Auto takes both if there are embeddings and
        something is excluded within a project, else words alone, and says why. Families of excluded sessions and, unless
        asked for, what a runtime injected are left out. Words have a pool of messages, of which a session shows its
        first three; by embedding every chunk is scored and every session has its best. A list whose first three
        cover fewer than two of four or more query words is withheld."""
        k = limit("similar", n)
        pool = max(20 * k, 50)
        usable = "chunks" in self.r
        reasons = []
        if mode == "auto":
            reasons = [] if exclude else ["missing_current_session_exclusion"]
            reasons += [] if scope.get("project") else ["missing_project_scope"]
            reasons = reasons or ([] if usable else ["missing_embedding_index"])
        chosen = mode if mode != "auto" else "fts" if reasons else "hybrid"
        if chosen not in ("fts", "embedding", "hybrid"):
            return Envelope("similar", status="error", errors=["mode is auto, fts, embedding or hybrid"])
        if chosen != "fts" and not usable:
            return Envelope("similar", status="error", errors=["there are no embedded chunks"])
        warnings: list[str] = []

        def ask() -> dict:
            hidden = not scope.get("include_injected", False)
            own = self._texts(**{**scope, "include_injected": not hidden})
            if exclude:
                own = own.join(self._family(exclude), "session_id", "left_anti")
            terms = retrieval.query_terms(text)
            found = self._lexical(own, search._terms(text), pool, hidden)
            if chosen != "fts":
                near = self._semantic(own, text, terms, hidden)
                if chosen == "embedding":
                    found = {r["session_id"]: r.asDict() | {"embedding_score": r["score"]} for r in near.orderBy(F.desc("score"), "session_id").limit(k).collect()}
                else:
                    found = self._fused(found, near, k)
            listed = list(found.values())[:k]
            shown = [" ".join([r.get("title") or "", *(s["snippet"] for s in r["snippets"])]).lower() for r in listed[:3]]
            low = len(terms) >= 4 and bool(listed) and max(sum(t in s for t in terms) for s in shown) < 2
            if low:
                warnings.append("low_confidence_matches")
            return {"mode": {"requested": mode, "selected": chosen, "fallback_reasons": reasons}, "low_confidence": low, "sessions": [] if low else listed}

        answer = self.run("similar", ask)
        answer.warnings += warnings
        return answer

    def _family(self, seeds: list[str]) -> DataFrame:
        """(session_id) of sessions connected with ``seeds`` by parent links or by dispatches."""
        own = self.r["sessions"]
        links = own.select(F.col("parent_session_id").alias("parent"), F.col("id").alias("child"))
        if "subagent_invocations" in self.r and "child_session_id" in self.r["subagent_invocations"].columns:
            links = links.unionByName(self.r["subagent_invocations"].select(F.col("parent_session_id").alias("parent"), F.col("child_session_id").alias("child")))
        gone = lineage.family(self.spark.createDataFrame([(e,) for e in seeds], f"id {own.schema['id'].dataType.simpleString()}"), links)
        return gone.select(F.col("id").alias("session_id"))

    def _lexical(self, own: DataFrame, terms: list[str], pool: int, hidden: bool) -> dict[Any, dict]:
        """Sessions of the pool of best messages, best first, each with its best score and first three snippets."""
        best = search.TextIndex.of(own).bm25(terms).orderBy("score", "doc").limit(pool)
        hits = best.join(own.select("doc", "role", "title", "text"), "doc").orderBy("score", "doc").collect()  # ``pool`` rows
        found: dict[Any, dict] = {}
        for h in hits:
            title = None if hidden and h["title"] and h["title"].lstrip().startswith(INJECTED) else h["title"]
            row = found.setdefault(h["doc"]["session_id"], {"session_id": h["doc"]["session_id"], "title": title, "score": h["score"], "fts_score": h["score"], "matched_turns": 0, "snippets": []})
            row["matched_turns"] += 1
            if len(row["snippets"]) < 3:
                row["snippets"].append({"turn": h["doc"]["turn"], "role": h["role"], "snippet": search.snippet(h["text"] or "", terms)})
        return found

    def _semantic(self, own: DataFrame, text: str, terms: list[str], hidden: bool) -> DataFrame:
        """(session_id, title, chunk, score, quality, snippets): the best chunk of each session."""
        chunks = self.r["chunks"]
        for name, kind in (("preview", "string"), ("kind", "string"), ("start_turn", "long"), ("end_turn", "long")):
            chunks = chunks if name in chunks.columns else chunks.withColumn(name, F.lit(None).cast(kind))
        chunks = retrieval.without_injected(chunks, self.r["messages"]) if hidden else chunks
        chunks = chunks.join(own.select("session_id", "title").distinct(), "session_id")
        scored = retrieval.scored(chunks, embed_terms(search._terms(text)))
        scored = scored.withColumn("score", retrieval.adjusted(F.col("score"), F.col("kind"), F.col("title"), F.col("preview"), text))
        best = retrieval.best_per_session(scored, retrieval.covered(F.concat_ws(" ", "title", "preview"), terms))
        shown = F.array(F.struct(F.col("start_turn").alias("turn"), F.lit("chunk").alias("role"), F.coalesce("preview", F.lit("")).alias("snippet")))
        return best.join(scored.select("session_id", "chunk", "title", shown.alias("snippets"), retrieval.quality(F.col("title"), F.col("preview")).alias("quality")), ["session_id", "chunk"])

    def _fused(self, lexical: dict[Any, dict], near: DataFrame, k: int) -> dict[Any, dict]:
        kind = self.r["sessions"].schema["id"].dataType.simpleString()
        listed = [(r["session_id"], float(r["score"]), r.get("title"), " ".join(s["snippet"] for s in r["snippets"])) for r in lexical.values()]
        words = self.spark.createDataFrame(listed, f"session_id {kind}, score double, title string, shown string")
        words = words.withColumn("quality", retrieval.quality(F.col("title"), F.col("shown")))
        top = retrieval.hybrid(words, near).orderBy(F.desc("score"), "session_id").limit(k)
        details = near.select("session_id", "title", "snippets", F.col("score").alias("embedding_score"))
        out = {}
        for r in top.join(details, "session_id", "left").orderBy(F.desc("score"), "session_id").collect():  # ``k`` rows
            row = dict(lexical.get(r["session_id"], {"session_id": r["session_id"], "title": r["title"], "snippets": [s.asDict() for s in r["snippets"] or []]}))
            out[r["session_id"]] = row | {c: r[c] for c in ("score", "embedding_score", "lexical_rank", "semantic_rank")}
        return out

    def embed(self, provider: str = "hash", n: int = 100, dry_run: bool = False) -> Envelope:
        """Embed the next pending chunks; the receipt."""

        def act() -> dict:
            made, receipt = embedding.embed_pending(self.r["chunk_texts"], self.r["embeddings"], provider, n, dry_run)
            if not dry_run:
                self.r["embeddings"] = self.r["embeddings"].unionByName(made)
            return receipt

        answer = self.run("embed", act)
        answer.status = "partial" if answer.status == "ok" and answer.data["status"] == "partial" else answer.status
        return answer

    def prices(self, feed: DataFrame | None = None, n: object = None) -> Envelope:
        """The price of every model of the corpus, taken anew from a feed where one is given; nulls where it knows none."""

        def found() -> list[dict]:
            if feed is not None:
                self.r["model_prices"] = costs.resolve_prices(self.r["sessions"].select("model"), feed)
            return rows(self.r["model_prices"].orderBy("model").limit(limit("top", n)))

        return self.run("prices", found)

    def version(self) -> Envelope:
        """What runs, and for whom: a terminal, a build, or an agent."""
        context = "ci" if os.environ.get("CI") else "tty" if os.isatty(1) else "agent"
        return self.run("version", lambda: {"engine": VERSION, "spark": self.spark.version, "relations": len(self.r), "context": context})

    # Upkeep ------------------------------------------------------------------------------------------------------
    def purge(self, projects: list[str], dry_run: bool = True) -> Envelope:
        """Drop sessions outside of the given projects; says what would go unless told to do it."""
        keep = F.exists(F.array(*map(F.lit, projects)), lambda p: F.contains(F.col("project_path"), p))

        def act() -> dict:
            counts = {r["keep"]: r["count"] for r in upkeep.purge_plan(self.r["sessions"], keep).groupBy("keep").count().collect()}
            if not dry_run:
                self.r = upkeep.purge(self.r, keep)
            return {"kept": counts.get(True, 0), "purged": counts.get(False, 0), "dry_run": dry_run}

        return self.run("purge", act)

    def backup(self, folder: str) -> Envelope:
        """A copy of all relations with a manifest of their rows; refused where the copies do not count the same."""

        def act() -> dict:
            manifest = {}
            for name, df in self.r.items():
                df.write.parquet(f"{folder.rstrip('/')}/{name}")
                manifest[name] = self.spark.read.parquet(f"{folder.rstrip('/')}/{name}").count()
                if manifest[name] != df.count():
                    raise BadArgument(f"{name} changed while it was copied")
            self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{folder.rstrip('/')}/manifest")
            return manifest

        return self.run("backup", act)
