"""Token costs by model, project, session, day or source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import accounting as A

GROUPS = ("model", "project", "session", "day", "source")


class MalformedCounters(ValueError):
    """Token counters that cannot be."""


def priced(sessions: DataFrame, prices: DataFrame) -> DataFrame:
    """``sessions`` with price columns by exact model name. Prices are a dimension; the planner may broadcast them."""
    return sessions.join(prices.withColumnRenamed("model", "p_model"), F.col("model") == F.col("p_model"), "left").drop("p_model")


def tokens_by(sessions: DataFrame, prices: DataFrame, by: str, check: bool = False) -> DataFrame:
    """The key, sessions, tokens, cost_usd (a lower bound where incomplete > 0) and volume, the rank of the list."""
    if by not in GROUPS:
        raise ValueError(f"by one of {', '.join(GROUPS)}")
    if check and sessions.filter(A.malformed()).limit(1).count():
        raise MalformedCounters("token counters must be whole, not negative and below 2^53")
    key = {"model": F.col("model"), "project": F.col("project_path"), "session": F.col("id"), "source": F.col("source"), "day": F.date_format(F.timestamp_seconds("started_at"), "yyyy-MM-dd")}[by]
    rows = priced(sessions, prices).filter(key.isNotNull()).select(
        key.alias("key"), "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens",
        A.billable_input().alias("bi"), A.billable_output().alias("bo"), A.cost_micro().alias("cost"), A.incomplete().alias("incomplete"), A.volume().alias("volume"),
    )
    total = lambda c, name: F.sum(F.coalesce(c, F.lit(0))).alias(name)
    return rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("sessions"), total("input_tokens", "input_tokens"), total("output_tokens", "output_tokens"), total("cache_read_tokens", "cache_read_tokens"),
        total("cache_creation_tokens", "cache_creation_tokens"), F.sum("bi").alias("billable_input"), F.sum("bo").alias("billable_output"),
        F.round(F.sum("cost") / 1e6, 4).alias("cost_usd"), F.count_if("incomplete").alias("incomplete"), F.sum("volume").alias("volume"),
    )


def resolve_prices(models: DataFrame, feed: DataFrame) -> DataFrame:
    """One row a corpus model: per-million prices of the feed entry (key and per-token costs) with its exact name, or
    else its name without a date; nulls where there is none."""
    wanted = models.filter("model is not null and model <> '' and model <> '<synthetic>'").select("model").distinct()
    cost = {"input_per_mtok": "input_cost_per_token", "output_per_mtok": "output_cost_per_token", "cache_read_per_mtok": "cache_read_input_token_cost", "cache_write_per_mtok": "cache_creation_input_token_cost"}
    entry = feed.select("key", F.struct("key", *((F.col(c) * 1e6).alias(n) for n, c in cost.items())).alias("e"))
    exact = entry.select(F.col("key").alias("k1"), F.col("e").alias("e1"))
    plain = entry.select(F.col("key").alias("k2"), F.col("e").alias("e2"))
    found = wanted.join(exact, F.col("model") == F.col("k1"), "left").join(plain, A.base_model(F.col("model")) == F.col("k2"), "left")
    e = F.coalesce("e1", "e2")
    return found.select("model", *(e[n].alias(n) for n in cost), e["key"].alias("matched_key"))


def warnings(sessions: DataFrame, prices: DataFrame) -> list[str]:
    """What a reader of costs must know: no prices at all, or sessions with tokens that nothing prices."""
    if not prices.limit(1).count():
        return ["NO_PRICES_LOADED"]
    n = priced(sessions, prices).filter(A.incomplete()).count()
    return [f"INCOMPLETE_PRICING: {n} sessions, costs are a lower bound"] if n else []
