"""Cells, rows and columns as delimited lines."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import column
from ..functions.text import delimited, export_text
from ..sources.local import local_table
from .selection import selected


def lines(df: DataFrame, names: Sequence[str] | None = None, delimiter: str = "\t") -> DataFrame:
    """One column, line: the named columns (default: all, each once) of each row, in the row order of ``df``."""
    names = list(dict.fromkeys(df.columns if names is None else names))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(F.concat_ws(delimiter, *[delimited(export_text(column(n), kinds.get(n)), delimiter) for n in names]).alias("line"))


#: Characters that an export gathers on the driver, at most.
MOST_TEXT = 64 << 20


@dataclass(frozen=True)
class Export:
    """Lines, and a header line if one was asked for."""

    body: DataFrame
    header: str | None = None
    newline: str = "\n"

    def lines(self) -> DataFrame:
        """The header line, if any, and the body's."""
        if self.header is None:
            return self.body
        return local_table(self.body.sparkSession, [("line", pa.string())], [(self.header,)]).unionByName(self.body)

    def text(self, most: int = MOST_TEXT) -> str:
        """All of it as one text, each line ended; for what a person copies, as it is gathered on the driver.  What has more than ``most`` characters raises: ``write`` has no bound."""
        size = self.body.agg(F.coalesce(F.sum(F.char_length("line") + len(self.newline)), F.lit(0))).first()[0]
        if size > most:
            raise ValueError(f"{size:,} characters are too many to copy; write them to files with write()")
        said = [r.line for r in self.body.collect()]
        return "".join(line + self.newline for line in [*([] if self.header is None else [self.header]), *said])

    def write(self, path: str) -> None:
        """Text files at ``path``, written in parallel; the header, if any, is a file that sorts first."""
        self.body.write.mode("errorifexists").option("lineSep", self.newline).text(path)
        if self.header is not None:
            spark = self.body.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/header.txt")
            out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
            out.write(bytearray((self.header + self.newline).encode()))
            out.close()


def cell(df: DataFrame, row_number: str, row: int, name: str, header: bool = False, newline: str = "\n") -> str:
    """One cell as it is, never quoted; with ``header``, its name on a line before it."""
    found = df.where(column(row_number) == row).select(export_text(column(name), df.schema[name].dataType)).first()
    if found is None:
        raise LookupError(f"no row {row}")
    return f"{name}{newline}{found[0]}" if header else found[0]


def _header(names: Sequence[str], delimiter: str, row_number: str | None = None) -> str:
    said = ["#" if n == row_number else n for n in names]
    if delimiter == ",":
        said = ['"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\n') else s for s in said]
    return delimiter.join(said)


def cells(df: DataFrame, row_number: str, rows: Iterable[int] | None, names: Sequence[str], delimiter: str = "\t", headers: bool = False, newline: str = "\n") -> Export:
    """The named columns of the given rows, or of all rows of ``df``."""
    names = list(dict.fromkeys(names))
    picked = df if rows is None else selected(df, row_number, rows)
    return Export(lines(picked, names, delimiter), _header(names, delimiter, row_number) if headers else None, newline)


def rows(df: DataFrame, row_number: str, picked: Iterable[int] | None, visible: Sequence[str] | None = None, headers: bool = False, newline: str = "\n") -> Export:
    """Whole rows, tab-separated, with their row number first."""
    names = [row_number, *(n for n in (df.columns if visible is None else visible) if n != row_number)]
    return cells(df, row_number, picked, names, "\t", headers, newline)


def columns(df: DataFrame, names: Sequence[str], headers: bool = False, newline: str = "\n") -> Export:
    """The named columns of every row of ``df``, tab-separated."""
    names = list(dict.fromkeys(names))
    return Export(lines(df, names), _header(names, "\t") if headers else None, newline)
