"""What commands answer: one line of JSON, and failures with a code, a category and an exit code."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field
from typing import Any

from tidewrack.functions.limits import BadArgument

# Exit codes, and categories by the thousands of a code.
EXIT = {"success": 0, "partial": 1, "user": 2, "system": 3, "transient": 4}
CATEGORIES = {1: "user", 2: "system", 3: "transient"}


class Failure(BadArgument):
    """A failure that a caller can act on. Codes from 1000 are the user's, from 2000 the system's, from 3000 pass."""

    code = 1001

    def __init__(self, message: str, code: int | None = None):
        super().__init__(message)
        self.code = code or self.code


class NotFound(Failure):
    """What was asked for by name is not there."""

    code = 1002


class Locked(Failure):
    """Someone else is writing."""

    code = 3001


def category(code: int) -> str:
    return CATEGORIES.get(code // 1000, "system")


def shape(problem: Exception) -> dict:
    """An error as data. What is no ``Failure`` and no bad argument is the system's."""
    code = problem.code if isinstance(problem, Failure) else 1001 if isinstance(problem, BadArgument) else 2999
    return {"code": code, "category": category(code), "message": str(problem)}


@dataclass
class Envelope:
    command: str
    data: Any = None
    status: str = "ok"
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    trace_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    problems: list[dict] = field(default_factory=list)
    pagination: dict | None = None
    began: float = field(default_factory=time.monotonic)

    @property
    def exit_code(self) -> int:
        if self.status in ("ok", "partial"):
            return EXIT["success" if self.status == "ok" else "partial"]
        return EXIT[self.problems[0]["category"] if self.problems else "user"]

    def line(self) -> str:
        """One line of JSON."""
        out = {"version": 1, "status": self.status, "command": self.command, "data": self.data, "traceId": self.trace_id}
        out |= {k: v for k in ("warnings", "pagination") if (v := getattr(self, k))}
        out |= {"errors": self.problems or self.errors} if self.errors else {}
        return json.dumps(out | {"_meta": {"duration_ms": int(1000 * (time.monotonic() - self.began))}}, ensure_ascii=False, default=str)


def page(n: int, total: int, offset: int = 0) -> dict:
    """Where a page of ``n`` rows lies in all of them."""
    return {"limit": n, "offset": offset, "total": total, "has_more": offset + n < total}
