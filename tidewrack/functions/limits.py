"""Driver-side arguments: dates, limits, patterns of ids."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

#: Default and largest limits by command.
LIMITS = {"top": (20, 1000), "top_mcp": (30, 1000), "top_sequences": (30, 1000), "sessions": (50, 10000), "workflows": (50, 10000), "timeline": (200, 10000), "embed": (100, 10000), "fts": (20, 500), "similar": (10, 100), "query": (500, 10000)}

_UNITS = {"w": 7 * 86400, "d": 86400, "h": 3600, "m": 60, "s": 1}


class BadArgument(ValueError):
    """An argument that cannot be understood."""


def limit(command: str, asked: object = None) -> int:
    """The limit to use: one that is no positive number or beyond the largest gives the default, not the largest."""
    default, most = LIMITS[command]
    try:
        n = int(str(asked))
    except ValueError:
        return default
    return n if 0 < n <= most else default


def instant(text: str, until: bool = False, now: datetime | None = None) -> int:
    """Epoch seconds of ``7d``-like offsets, a bare date (UTC midnight; the next one for ``until``) or an ISO time."""
    text = text.strip()
    if m := re.fullmatch(r"(\d+)([wdhms])", text):
        return int(((now or datetime.now(timezone.utc)) - timedelta(seconds=int(m[1]) * _UNITS[m[2]])).timestamp())
    try:
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
            day = datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=timezone.utc)
            return int((day + timedelta(days=1) if until else day).timestamp())
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError as bad:
        raise BadArgument(f"not a date: {text}") from bad
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp())
