"""Text filters: one column, all columns, and their composition."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from ..functions.names import column
from ..functions.text import cell_text


class FilterError(ValueError):
    """A filter text with a wildcard inside, or an open bracket."""


def parse(text: str) -> str | None:
    """What a filter text looks for: a literal to be contained, or None for any value.

    Runs of * and % at the ends stand for anything, which containment implies;
    between other characters they are an error.  [x] is the character x.
    """
    out: list[tuple[str, bool]] = []  # character, is it a wildcard
    at = 0
    while at < len(text):
        c = text[at]
        if c == "[":
            if text[at + 2 : at + 3] != "]":
                raise FilterError(f"bracket without end, or around several characters: {text!r}")
            out.append((text[at + 1], False))
            at += 3
        else:
            out.append((c, c in "*%"))
            at += 1
    while out and out[0][1]:
        out.pop(0)
    while out and out[-1][1]:
        out.pop()
    if any(wild for _, wild in out):
        raise FilterError(f"wildcard inside the text: {text!r}")
    return "".join(c for c, _ in out) or None


def contains(name: str, text: str, literal: bool = False, kind: DataType | None = None, collation: str | None = None) -> Column | None:
    """Whether the text of column ``name``, of type ``kind``, holds ``text`` in any case, or as ``collation`` compares; null for null; no predicate for blank text."""
    text = text.strip()
    if not text:
        return None
    wanted = text if literal else parse(text)
    shown = cell_text(column(name), kind)
    if wanted is None:
        return shown.isNotNull()
    if collation and (kind is None or isinstance(kind, StringType)):  # texts of other types have no accents or cases to fold
        return F.contains(F.collate(shown, collation), F.collate(F.lit(wanted), collation))
    return F.contains(F.lower(shown), F.lower(F.lit(wanted)))


def anywhere(names: Iterable[str], text: str, literal: bool = False, kinds: Mapping[str, DataType] | None = None, collation: str | None = None) -> Column | None:
    """Whether any of the columns holds ``text``."""
    each = [p for p in (contains(n, text, literal, (kinds or {}).get(n), collation) for n in names) if p is not None]
    return reduce(or_, each) if each else None


def matching(df: DataFrame, filters: Iterable[tuple[str, str]] = (), search: str = "", searched: Iterable[str] | None = None, literal: bool = False, collation: str | None = None) -> DataFrame:
    """Rows that meet every column filter and hold ``search`` in one of the ``searched`` columns (default: all).

    Without ``collation`` cases are folded by ``lower``; with one of Spark's
    (UNICODE_CI, UNICODE_CI_AI, ...) texts are compared as it says.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = [contains(n, t, literal, kinds.get(n), collation) for n, t in filters]
    parts.append(anywhere(df.columns if searched is None else searched, search, literal, kinds, collation))
    found = [p for p in parts if p is not None]
    return df.where(reduce(and_, found)) if found else df
