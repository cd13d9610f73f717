"""Session lineage: families over parent links, and the sessions that dispatches started."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.operators.working import stored


def family(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """All sessions connected with ``seeds`` (id) over ``links`` (parent, child), either way. Unknown seeds stay.

    The frontier is joined with the links each round and what has been seen is taken off it, until nothing is left;
    a round costs one join with the frontier, and cycles end it."""
    both = stored(links.select(F.col("parent").alias("a"), F.col("child").alias("b")).unionByName(links.select(F.col("child").alias("a"), F.col("parent").alias("b"))).filter("a is not null and b is not null").distinct())
    seen = frontier = stored(seeds.select("id").distinct())
    while frontier.limit(1).count():
        frontier = stored(frontier.join(both, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti"))
        seen = stored(seen.unionByName(frontier))
    return seen


def assign_children(dispatches: DataFrame, children: DataFrame) -> DataFrame:
    """``dispatches`` (session_id, turn, idx, output_id, stable_key, failed) with child_id.

    Calls of a parent claim its children (by start, unknown last, and id), each child once, in three rounds over the
    calls in order: first the child whose id or external id the call's output names; then the first free one whose
    agent type is the call's stable key, or ends with it as a path, or the other way round; then the first free one.
    Failed calls claim nothing, and guardians only by name. Each claim depends on those before it, so the calls and
    children of one parent meet in one task."""

    def key_of(value: str | None) -> str:
        return (value or "").strip().strip("/")

    def claims(calls: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        calls = calls.sort_values(["turn", "idx"])
        own = own.sort_values(["started_at", "id"], na_position="last")
        free = list(own[["id", "external_id", "agent_type", "source"]].astype(object).where(own.notna(), None).itertuples(index=False))
        todo = list(calls[["turn", "idx", "output_id", "stable_key", "failed"]].astype(object).where(calls.notna(), None).itertuples(index=False))
        claimed: dict[tuple, str] = {}

        def fits(call: tuple, child: tuple) -> bool:
            a, b = key_of(child.agent_type), key_of(call.stable_key)
            return bool(child.agent_type) and (a == b or a.endswith(f"/{b}") or b.endswith(f"/{a}"))

        guardian = lambda c: c.source == "codex" and c.agent_type == "guardian"
        rounds = (
            (lambda call: bool(call.output_id), lambda call, c: call.output_id in (c.id, c.external_id)),
            (lambda call: bool(call.stable_key), lambda call, c: not guardian(c) and fits(call, c)),
            (lambda call: True, lambda call, c: not guardian(c)),
        )
        for asks, takes in rounds:
            for call in todo:
                if call.failed or (call.turn, call.idx) in claimed or not asks(call):
                    continue
                if (child := next((c for c in free if takes(call, c)), None)) is not None:
                    claimed[call.turn, call.idx] = child.id
                    free.remove(child)
        made = [(calls["session_id"].iloc[0], turn, idx, child) for (turn, idx), child in claimed.items()] if len(calls) else []
        return pd.DataFrame(made, columns=["session_id", "turn", "idx", "child_id"])

    for name in ("stable_key",):
        dispatches = dispatches if name in dispatches.columns else dispatches.withColumn(name, F.lit(None).cast("string"))
    for name in ("agent_type", "source"):
        children = children if name in children.columns else children.withColumn(name, F.lit(None).cast("string"))
    asked = dispatches.select("session_id", "turn", "idx", "output_id", "stable_key", "failed")
    own = children.filter("parent_session_id is not null").select(F.col("parent_session_id").alias("session_id"), "id", "external_id", "agent_type", "source", "started_at")
    kinds = {f.name: f.dataType.simpleString() for f in dispatches.schema}
    found = asked.groupBy("session_id").cogroup(own.groupBy("session_id")).applyInPandas(claims, f"session_id {kinds['session_id']}, turn {kinds['turn']}, idx {kinds['idx']}, child_id string")
    return dispatches.join(found, ["session_id", "turn", "idx"], "left")
