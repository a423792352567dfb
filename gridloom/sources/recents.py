"""Recently opened paths: newest first, each once, kept as JSON."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import column

MOST = 10


class Recents:
    """A small list on the driver; ``exists`` tells whether a path is still there."""

    def __init__(self, store: str | None = None, most: int = MOST, exists: Callable[[str], bool] = os.path.exists) -> None:
        self.store, self.most, self._exists = store, most, exists
        self.paths = self._load()

    def _load(self) -> list[str]:
        try:
            with open(self.store or "", encoding="utf-8") as f:
                said = json.load(f)
        except (OSError, ValueError):
            return []
        if not isinstance(said, list):
            return []
        return [p for p in said if isinstance(p, str) and self._exists(p)][: self.most]

    def _keep(self) -> None:
        if self.store:
            with open(f"{self.store}.tmp", "w", encoding="utf-8") as f:
                json.dump(self.paths, f)
            os.replace(f"{self.store}.tmp", self.store)

    def add(self, path: str) -> None:
        self.paths = [path, *(p for p in self.paths if p != path)][: self.most]
        self._keep()

    def remove(self, path: str) -> None:
        self.paths = [p for p in self.paths if p != path]
        self._keep()

    def clear(self) -> None:
        self.paths = []
        self._keep()

    def path_at(self, index: int) -> str:
        """The path at ``index``; one that is gone leaves the list and raises FileNotFoundError."""
        path = self.paths[index]
        if not self._exists(path):
            self.remove(path)
            raise FileNotFoundError(path)
        return path


def most_recent(events: DataFrame, item: str, newest: list[str], most: int = MOST) -> DataFrame:
    """The latest event of each ``item``, the ``most`` latest of those, newest first: the same list, from a log of any size.

    ``newest`` are the columns that tell which event is later.  Each item's
    latest is combined before the shuffle, so an item of many events does no
    harm; the list itself is a top-k.
    """
    latest = events.groupBy(column(item)).agg(F.max_by(F.struct(*[column(c) for c in events.columns]), F.struct(*[column(c) for c in newest])).alias("_latest"))
    return latest.select("_latest.*").orderBy(*[column(c).desc() for c in newest]).limit(most)
