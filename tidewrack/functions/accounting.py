"""Token accounting: what a session's counters mean, by source, and what they cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack.functions import patterns as P

COUNTERS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "reasoning_tokens")


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _source(names: tuple[str, ...]) -> Column:
    return F.coalesce(F.col("source").isin(*names), F.lit(False))


CACHE = lambda: _n("cache_read_tokens") + _n("cache_creation_tokens")


def ambiguous_input() -> Column:
    return ~_source(P.INPUT_INCLUDES_CACHE) & ~_source(P.INPUT_BESIDE_CACHE) & (CACHE() > 0)


def ambiguous_reasoning() -> Column:
    return ~_source(("codex",)) & ~_source(P.REASONING_BESIDE_OUTPUT) & (_n("reasoning_tokens") > 0)


def billable_input() -> Column:
    """Input that is priced as input: less the cache where input includes it, none where that is not known."""
    return F.when(_source(P.INPUT_INCLUDES_CACHE), F.greatest(_n("input_tokens") - CACHE(), F.lit(0))).when(ambiguous_input(), F.lit(0)).otherwise(_n("input_tokens"))


def billable_output() -> Column:
    most, both = F.greatest(_n("output_tokens"), _n("reasoning_tokens")), _n("output_tokens") + _n("reasoning_tokens")
    return F.when(_source(("codex",)), most).when(_source(P.REASONING_BESIDE_OUTPUT), both).otherwise(_n("output_tokens"))


def cost_micro() -> Column:
    """Cost in millionths of a dollar; an unknown price adds nothing."""
    priced = ((billable_input(), "input_per_mtok"), (billable_output(), "output_per_mtok"), (_n("cache_read_tokens"), "cache_read_per_mtok"), (_n("cache_creation_tokens"), "cache_write_per_mtok"))
    total = F.lit(0.0)
    for tokens, price in priced:
        total = total + tokens * F.coalesce(F.col(price), F.lit(0.0))
    return total


def incomplete() -> Column:
    """Whether the cost is a lower bound: something billable has no price, or counters can be read in two ways."""
    priced = ((billable_input(), "input_per_mtok"), (billable_output(), "output_per_mtok"), (_n("cache_read_tokens"), "cache_read_per_mtok"), (_n("cache_creation_tokens"), "cache_write_per_mtok"))
    out = ambiguous_input() | ambiguous_reasoning()
    for tokens, price in priced:
        out = out | ((tokens > 0) & F.col(price).isNull())
    return out


def volume() -> Column:
    """All tokens that went through: the rank of a group."""
    most, both = F.greatest(_n("output_tokens"), _n("reasoning_tokens")), _n("output_tokens") + _n("reasoning_tokens")
    into = F.when(_source(P.INPUT_BESIDE_CACHE), _n("input_tokens") + CACHE()).otherwise(F.greatest(_n("input_tokens"), CACHE()))
    return into + F.when(_source(P.REASONING_BESIDE_OUTPUT), both).otherwise(most)


def malformed() -> Column:
    """Counters that cannot be: negative, or beyond what a double holds exactly."""
    out = F.lit(False)
    for c in COUNTERS:
        out = out | F.coalesce((F.col(c) < 0) | (F.col(c) > 9007199254740991), F.lit(False))
    return out


def base_model(model: Column) -> Column:
    """A model name without its date: -YYYYMMDD or -YYYY-MM-DD."""
    return F.regexp_replace(model, r"-(?:[0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2})$", "")
