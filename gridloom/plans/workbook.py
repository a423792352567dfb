"""A workbook: one Parquet source, an edit log and a view, compiled to one lazy plan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.names import column, fresh_name
from ..operators import export, sink
from ..operators.edits import EditLog, overlay
from ..operators.journal import Journal
from ..operators.predicates import FilterError
from ..operators.selection import in_words, selected
from ..sources.files import Source
from ..sources.parquet import FileInfo, file_info
from ..sources.recents import Recents
from ..sources.scratch import scratch
from .view import ViewState


class UnsavedError(RuntimeError):
    """Edits would be lost."""


@dataclass(frozen=True)
class _Held:
    """What a search has found: its files, and a bitmap of row numbers, 64 in a word."""

    state: ViewState
    files: list[Row]
    words: DataFrame


class Workbook:
    """``Workbook.open(spark, path)``, then explore, edit, save and close."""

    def __init__(self, spark: SparkSession, recents: Recents | None = None, journal: bool = False) -> None:
        self.spark, self.recents, self._journaled = spark, recents, journal
        self.path: str | None = None
        self.message = "Ready"

    @property
    def message(self) -> str:
        """What was done last; after a load, what was opened."""
        if self._message is None:
            info = self.info()
            self._message = f"Loaded {info.name} - {info.rows:,} rows, {len(info.columns)} columns"
        return self._message

    @message.setter
    def message(self, said: str | None) -> None:
        self._message = said

    @classmethod
    def open(cls, spark: SparkSession, path: str, recents: Recents | None = None, journal: bool = False) -> Workbook:
        """Open ``path``.  With ``journal``, edits are stored as they are made, and those of a session that died are there again."""
        book = cls(spark, recents, journal)
        book.load(path)
        return book

    def load(self, path: str, discard: bool = False) -> None:
        """Open ``path`` in this workbook, with a fresh view; nothing changes if that fails."""
        if self.dirty and not discard:
            raise UnsavedError("save the edits, or load with discard=True")
        if self.dirty and self.journal:
            self.journal.clear()
        self._bind(path)
        self.message = None
        if self.recents:
            self.recents.add(path)

    def load_recent(self, index: int, discard: bool = False) -> None:
        if self.recents is None:
            raise LookupError("this workbook keeps no recent files")
        self.load(self.recents.path_at(index), discard)

    def _bind(self, path: str) -> None:
        sink.recover(self.spark, path)
        source = Source(self.spark, path)
        log, journal = EditLog(source.numbered.schema, source.row_number), None
        if self._journaled:
            journal = Journal(self.spark, path, source.files.rows)
            journal.replay(log)
        self.source, self.row_number, self.path = source, source.row_number, path
        self.log, self.journal = log, journal
        self.state = ViewState(self.row_number)
        self._info: FileInfo | None = None
        self._held: _Held | None = None

    @property
    def dirty(self) -> bool:
        return self.path is not None and self.log.unsaved

    @property
    def title(self) -> str:
        return ("*" if self.dirty else "") + self.info().name

    @property
    def columns(self) -> list[str]:
        return list(self.source.plain.columns)

    def info(self) -> FileInfo:
        """Name, all rows and columns of the source; filters do not change it."""
        if self._info is None:
            self._info = file_info(self.source.plain, self.path, self.source.files.rows if self.source.several else None)
        return self._info

    def data(self) -> DataFrame:
        """All rows in the state of the edits, with their numbers."""
        return overlay(self.source.numbered, self.log)

    def _rows(self, state: ViewState) -> DataFrame:
        """Rows that the view of ``state`` is among: all, or those of a page in stored order, or those that were held."""
        if self._held and state.narrows(self._held.state):
            if not self._held.files:
                return self.source.numbered.where("false")
            rows = self.source.some_files(self._held.files)
            rows = self.source.files.numbered(rows, self.row_number, self._held.files)
            return overlay(in_words(rows, self.row_number, self._held.words), self.log)
        if state.key is None and not state.filtered and state.size is not None:
            return overlay(self.source.some_rows(state.offset + 1, state.offset + state.size), self.log)
        return self.data()

    def view(self) -> DataFrame:
        """The rows and columns of the current view.  A filter text that cannot be read shows all rows, and says so in ``message``."""
        return self._shown(True)

    def _shown(self, arranged: bool) -> DataFrame:
        try:
            shown = self.state.apply(self._rows(self.state), arranged)
            self.message = self.state.status()
        except FilterError as e:
            state = self.state.clear_filters()
            shown = state.apply(self._rows(state), arranged)
            self.message = f"Filter error: {e}"
        return shown

    def filter(self, name: str, text: str) -> Workbook:
        self.state = self.state.filter(name, text)
        return self

    def search(self, text: str) -> Workbook:
        self.state = self.state.search(text)
        return self

    def hold(self) -> int:
        """Keep what the filters and the search find now, and return how many rows that is.

        As long as later texts only get longer, views read the files with
        such rows alone, and of these the rows found.  What is kept is a
        written bitmap, 16 bytes for 64 rows with a match; an edit or another
        search ends its use.
        """
        files = self.source.files
        path = fresh_name([*self.columns, self.row_number], "_path")
        held = self._held if self._held and self.state.narrows(self._held.state) else None
        some = held.files if held else files.within(1, files.rows)
        if not some:
            self._held = _Held(self.state.page(0, None).reset_sort(), [], self.spark.createDataFrame([], "word long, bits long"))
            self.message = "0 rows found"
            return 0
        rows = files.numbered(self.source.some_files(some), self.row_number, some, [F.col("_metadata.file_path").alias(path)])
        if held:
            rows = in_words(rows, self.row_number, held.words)
        plain = self.state.page(0, None).reset_sort()
        found = self._matching(rows, path, plain)
        number = column(self.row_number)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(63).cast("int"))
        to = scratch(self.spark, "found")
        found.groupBy(column(path).alias("path"), F.shiftright(number, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).write.parquet(to)
        words = self.spark.read.schema("path string, word long, bits long").parquet(to)
        with_rows = {r.path for r in words.select("path").distinct().collect()}  # files, at most
        self._held = _Held(plain, [f for f in some if f.path in with_rows], words.select("word", "bits"))
        n = words.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))).first()[0]
        self.message = f"{n:,} rows found"
        return n

    def _matching(self, rows: DataFrame, path: str, state: ViewState) -> DataFrame:
        """``rows`` that the filters and the search of ``state`` find, with their ``path``, which is not searched."""
        edited = overlay(rows, self.log)
        kept = F.struct(column(path), column(self.row_number)).alias(path)
        shown = edited.select(kept, *[column(c) for c in self.columns])
        searched = ViewState(path, state.filters, state.text, literal=state.literal, collation=state.collation)
        return searched.apply(shown).select(f"`{path}`.*")

    def collate(self, collation: str | None) -> Workbook:
        self.state = self.state.collate(collation)
        return self

    def toggle_sort(self, name: str) -> Workbook:
        self.state = self.state.toggle_sort(name)
        self.message = self.state.sort_status()
        return self

    def page(self, offset: int, size: int | None) -> Workbook:
        self.state = self.state.page(offset, size)
        return self

    def hide(self, *names: str) -> Workbook:
        self.state = self.state.hide(*names)
        return self

    def show(self, *names: str) -> Workbook:
        self.state = self.state.show(*names)
        return self

    def move(self, name: str, to: int) -> Workbook:
        self.state = self.state.move(name, to, self.columns)
        return self

    def edit(self, row: int, name: str, value: object) -> None:
        """Note one edit; a row that the source does not have is refused."""
        self.log.rows = self.info().rows
        self.log.record(self.spark, row, name, value)
        self._held = None
        if self.journal:
            self.journal.append(row, name, self.log.cells[row][name])

    def save(self, timestamp_precision: str | None = None) -> int:
        """Write all rows, whatever the view shows, over the source; files without an edit stay as they are."""
        return self._save(self.path, timestamp_precision, None)

    def save_as(self, path: str, timestamp_precision: str | None = None, layout: str | None = None) -> int:
        """Write all rows to ``path`` and go on from there; on failure the workbook stays where it was."""
        return self._save(path, timestamp_precision, layout)

    def _save(self, path: str, timestamp_precision: str | None, layout: str | None) -> int:
        n = sink.save_source(self.source, self.log, path, timestamp_precision, layout)
        if self.journal:
            self.journal.clear()
        state, renamed = self.state, path != self.path
        self._bind(path)
        self.state = state if state.row_number == self.row_number else ViewState(self.row_number)
        if renamed and self.recents:
            self.recents.add(path)
        self.message = f"Saved {n:,} rows"
        return n

    def close(self, save: bool | None = None) -> None:
        """Let go of the source; with edits, ``save`` must say whether to keep them."""
        if self.dirty:
            if save is None:
                raise UnsavedError("close with save=True or save=False")
            if save:
                self.save()
            elif self.journal:
                self.journal.clear()
        self.path = None

    def copy_cell(self, row: int, name: str, header: bool = False) -> str:
        said = export.cell(overlay(self.source.some_rows(row, row), self.log), self.row_number, row, name, header)
        self.message = "Copied 1 cell"
        return said

    def _picked(self, rows: Iterable[int]) -> DataFrame:
        """The rows of the view with the given numbers; without a page, only files that hold them are read."""
        if self.state.size is not None or self.state.offset or (self._held and self.state.narrows(self._held.state)):
            return selected(self._shown(False), self.row_number, rows)
        some = overlay(selected(self.source.holding(rows), self.row_number, rows), self.log)
        try:
            shown = self.state.apply(some, False)
        except FilterError:
            shown = self.state.clear_filters().apply(some, False)
        return shown if self.state.key is not None else shown.orderBy(column(self.row_number))

    def copy_cells(self, rows: Iterable[int], names: Sequence[str], delimiter: str = "\t", headers: bool = False, newline: str = "\n") -> export.Export:
        rows = _numbers(rows)
        out = self._picked(rows)
        self.message = f"Copied {out.count() * len(set(names)):,} cells"
        return export.cells(out, self.row_number, None, self._displayed(names), delimiter, headers, newline)

    def _displayed(self, names: Iterable[str]) -> list[str]:
        """``names``, each once, in the order in which they are displayed."""
        wanted = set(names)
        shown = [n for n in [self.row_number, *self.state.arranged(self.columns)] if n in wanted]
        return [*shown, *(n for n in dict.fromkeys(names) if n not in shown)]

    def copy_rows(self, rows: Iterable[int], headers: bool = False, visible: Sequence[str] | None = None) -> export.Export:
        """Whole rows: their number, then the columns on show as they are displayed, or those of ``visible``."""
        rows = _numbers(rows)
        out = self._picked(rows)
        self.message = f"Copied {out.count():,} rows"
        return export.rows(out, self.row_number, None, self.state.visible(self.columns) if visible is None else visible, headers)

    def copy_columns(self, names: Sequence[str], headers: bool = False) -> export.Export:
        """The named columns of every row of the current view, in its order."""
        out = self._shown(False)
        self.message = f"Copied {len(set(names)):,} columns ({out.count():,} rows)"
        return export.columns(out, self._displayed(names), headers)


def _numbers(rows: Iterable[int]):
    """Row numbers as what selections take without a copy: an array, or a range."""
    return rows if isinstance(rows, range | np.ndarray) else np.fromiter(rows, np.int64)
