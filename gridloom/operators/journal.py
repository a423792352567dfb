"""A journal of unsaved edits beside their target, so that a driver that dies loses none.

Every edit is a small file of its own, written under another name and moved,
so a reader sees whole entries only.  Entries are replayed in order when the
source is opened again; many of them are brought together into one, and a save
that is done removes them all.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import SparkSession

from .edits import EditLog

#: Entries that are brought together into one.
COMPACT = 64


class JournalError(RuntimeError):
    """A journal belongs to other data than those that are there."""


class Journal:
    """The entries of ``path``; ``rows`` is how many rows the data have that they are edits of."""

    def __init__(self, spark: SparkSession, path: str, rows: int) -> None:
        self._spark, self._rows = spark, rows
        make = spark._jvm.org.apache.hadoop.fs.Path
        target = make(path)
        self._folder = make(f"{target.getParent().toString()}/.{target.getName()}.edits")
        self._fs = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self._entries = self._listed()

    def _listed(self) -> list[int]:
        if not self._fs.exists(self._folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _at(self, name: str):
        return self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder.toString()}/{name}")

    def _write(self, number: int, cells: Iterable[tuple[int, str, str | None]]) -> None:
        draft, at = self._at(f"{number:012d}.draft"), self._at(f"{number:012d}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"rows": self._rows, "cells": list(cells)}).encode()))
        out.close()
        if not self._fs.rename(draft, at):
            raise JournalError(f"{at.toString()} cannot be written")

    def append(self, row: int, name: str, value: str | None) -> None:
        """Store one edit; it is there when this returns."""
        self._write((self._entries[-1] if self._entries else 0) + 1, [(row, name, value)])
        self._entries.append((self._entries[-1] if self._entries else 0) + 1)
        if len(self._entries) > COMPACT:
            self._compact()

    def _cells(self, number: int) -> list:
        opened = self._fs.open(self._at(f"{number:012d}.json"))
        try:
            said = json.loads(bytes(opened.readAllBytes()).decode())
        finally:
            opened.close()
        if said["rows"] != self._rows:
            raise JournalError(f"edits of {said['rows']:,} rows, but there are {self._rows:,}; delete {self._folder.toString()} to drop them")
        return said["cells"]

    def _compact(self) -> None:
        """One entry for all: written after the last one, so a crash in between replays the same edits twice at most."""
        last: dict[tuple[int, str], str | None] = {}
        for number in self._entries:
            for row, name, value in self._cells(number):
                last[row, name] = value
        number = self._entries[-1] + 1
        self._write(number, [(row, name, value) for (row, name), value in last.items()])
        for old in self._entries:
            self._fs.delete(self._at(f"{old:012d}.json"), False)
        self._entries = [number]

    def replay(self, log: EditLog) -> int:
        """Bring the stored edits into ``log``; they were checked when they were made.  Returns how many entries there are."""
        for number in self._entries:
            for row, name, value in self._cells(number):
                log.cells.setdefault(row, {})[name] = value
        log.unsaved = log.unsaved or bool(self._entries)
        return len(self._entries)

    def clear(self) -> None:
        self._fs.delete(self._folder, True)
        self._entries = []
