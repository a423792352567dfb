"""The state of a view, and the plan that it stands for."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..functions.names import column
from ..operators.ordering import page, sorted_page
from ..operators.predicates import FilterError, matching, parse


@dataclass(frozen=True)
class ViewState:
    """Filters, search, one sort key, a page, and the columns on show; every method returns a new state."""

    row_number: str = "row_number"
    filters: tuple[tuple[str, str], ...] = ()
    text: str = ""
    key: str | None = None
    directions: tuple[tuple[str, bool], ...] = ()
    offset: int = 0
    size: int | None = None
    literal: bool = False
    collation: str | None = None
    hidden: frozenset[str] = frozenset()
    order: tuple[str, ...] = ()

    def filter(self, name: str, text: str) -> ViewState:
        """Look for ``text`` in column ``name``; blank text takes the filter away."""
        kept = tuple((n, t) for n, t in self.filters if n != name)
        return replace(self, filters=(*kept, (name, text)) if text.strip() else kept)

    def search(self, text: str) -> ViewState:
        return replace(self, text=text)

    def clear_filters(self) -> ViewState:
        return replace(self, filters=(), text="")

    def collate(self, collation: str | None) -> ViewState:
        """Compare texts by one of Spark's collations in filters, search and sort; None folds cases only."""
        return replace(self, collation=collation)

    def toggle_sort(self, name: str) -> ViewState:
        """Sort by ``name``: ascending, unless that was its own last direction."""
        if name == self.row_number:
            raise ValueError("rows cannot be sorted by their number; reset_sort restores stored order")
        up = not dict(self.directions).get(name, False)
        return replace(self, key=name, directions=(*((n, d) for n, d in self.directions if n != name), (name, up)))

    def reset_sort(self) -> ViewState:
        return replace(self, key=None)

    def page(self, offset: int, size: int | None) -> ViewState:
        return replace(self, offset=offset, size=size)

    def hide(self, *names: str) -> ViewState:
        """Take columns off show; they are still filtered, searched and sorted by."""
        return replace(self, hidden=self.hidden | set(names) - {self.row_number})

    def show(self, *names: str) -> ViewState:
        """Bring columns back, all hidden ones if none is named."""
        return replace(self, hidden=self.hidden - set(names) if names else frozenset())

    def move(self, name: str, to: int, columns: Sequence[str]) -> ViewState:
        """Display ``name`` as the ``to``-th of ``columns``, counted from 0; the row number stays first."""
        names = self.arranged(columns)
        if name not in names:
            raise ValueError(f"no column {name!r}")
        names.remove(name)
        names.insert(to, name)
        return replace(self, order=tuple(names))

    def arranged(self, columns: Sequence[str]) -> list[str]:
        """``columns`` without the row number, hidden ones too, in the order of display; those that no move named keep their place after the others."""
        own = [c for c in columns if c != self.row_number]
        moved = [c for c in self.order if c in own]
        return [*moved, *(c for c in own if c not in moved)]

    def visible(self, columns: Sequence[str]) -> list[str]:
        """The columns on show, in the order of display."""
        return [c for c in self.arranged(columns) if c not in self.hidden]

    @property
    def ascending(self) -> bool:
        return dict(self.directions).get(self.key or "", True)

    def status(self) -> str:
        said = []
        if self.filters:
            said.append(f"{len(self.filters)} column(s)")
        if self.text.strip():
            said.append("global search")
        return f"Filtered by {' + '.join(said)}" if said else "Ready"

    def sort_status(self) -> str:
        return f"Sorted by {self.key} ({'ascending' if self.ascending else 'descending'})" if self.key is not None else "Ready"

    def narrows(self, old: ViewState) -> bool:
        """Whether every row of this view is surely one of ``old``'s: the same searches, or ones for longer texts around theirs."""
        if (self.literal, self.collation, self.row_number) != (old.literal, None, old.row_number) or old.collation:
            return False
        mine = dict(self.filters)

        def within(longer: str, shorter: str) -> bool:
            longer, shorter = longer.strip(), shorter.strip()
            if not shorter or not longer:
                return not shorter
            try:
                a, b = (longer, shorter) if self.literal else (parse(longer), parse(shorter))
            except FilterError:
                return False
            return b is None or (a is not None and b.lower() in a.lower())

        return all(within(mine.get(n, ""), t) for n, t in old.filters) and within(self.text, old.text)

    @property
    def filtered(self) -> bool:
        return bool(self.filters or self.text.strip())

    def apply(self, df: DataFrame, arranged: bool = True) -> DataFrame:
        """The plan of this view over ``df``, which has the row number.  Without a sort or page, rows come as scanned."""
        out = matching(df, self.filters, self.text, [c for c in df.columns if c != self.row_number], self.literal, self.collation)
        if self.key is not None:
            out = sorted_page(out, self.key, self.ascending, self.row_number, self.offset, self.size, self.collation)
        elif self.offset or self.size is not None:
            if self.filtered:
                out = sorted_page(out, self.row_number, True, self.row_number, self.offset, self.size)
            else:  # rows are numbered without a gap, so the page is known by its numbers
                number = column(self.row_number)
                some = out.where(number > self.offset)
                out = some.orderBy(number) if self.size is None else page(some.where(number <= self.offset + self.size).orderBy(number), 0, self.size)
        if arranged and (self.hidden or self.order):
            out = out.select(*[column(c) for c in out.columns if c == self.row_number], *[column(c) for c in self.visible(out.columns)])
        return out
