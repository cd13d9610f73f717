"""When to look at which files, and when to act on what was found: recency bands, debounce, liveness."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values, in seconds: a file changed within the first is looked at again after the second.
BANDS = ((86_400, 2), (7 * 86_400, 300))
COLD_EVERY = 3600
FOLDERS_EVERY = 60
#: Quiet time and longest wait ahead of an import, and of an extraction.
IMPORT, EXTRACT = (2.0, 20.0), (60.0, 900.0)
#: A process that has not said anything for so long is taken for stalled.
STALLED_AFTER = 3600


def interval(age: Column) -> Column:
    """How often a file of this age is looked at: hot, cool, cold."""
    every = F.lit(COLD_EVERY)
    for limit, seconds in reversed(BANDS):
        every = F.when(age < limit, seconds).otherwise(every)
    return every


def due(known: DataFrame, now: float) -> DataFrame:
    """Of ``known`` files (path, mtime and checked_at in seconds) those whose band says to look again; a file that has
    never been looked at is due. Frozen files cost nothing until their hour comes."""
    again = F.col("checked_at").isNull() | (F.lit(now) - F.col("checked_at") >= interval(F.lit(now) - F.col("mtime")))
    return known.filter(again)


def new_folders(listing: DataFrame, known: DataFrame) -> DataFrame:
    """(folder) of files in ``listing`` (path) where no ``known`` file is: a folder that has come up since."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return listing.select(folder.alias("folder")).distinct().join(known.select(folder.alias("folder")).distinct(), "folder", "left_anti")


@dataclass
class Debounce:
    """Acts once changes have been quiet for ``settle`` seconds, or ``ceiling`` seconds after the first of them."""

    settle: float
    ceiling: float
    first: float | None = None
    last: float | None = None

    def changed(self, now: float) -> None:
        self.first = now if self.first is None else self.first
        self.last = now

    def ready(self, now: float) -> bool:
        return self.first is not None and (now - self.last >= self.settle or now - self.first >= self.ceiling)

    def done(self) -> None:
        self.first = self.last = None


def stalled(last_beat: float | None, now: float) -> str | None:
    """A warning for readers where ingest has said nothing for an hour, or never."""
    if last_beat is None:
        return "DAEMON_NOT_RUNNING: no heartbeat"
    silent = int(now - last_beat)
    return f"DAEMON_NOT_RUNNING: no heartbeat for {silent} s" if silent > STALLED_AFTER else None
