"""Cell edits as a log laid over an unchanging source."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import column, fresh_name
from ..sources.local import local_table

#: Edits are sent to every executor up to this many characters, each row counting 64 beside its own; beyond it they are joined by shuffle.
BROADCAST_CHARS = 16 << 20


#: Bits of the integer types.
_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def _plainly_fits(text: str, kind: str) -> bool:
    """Whether ``text`` is an ordinary value of the type; what is not may still be one in Spark's eyes."""
    if kind in _BITS:
        return re.fullmatch(r"[+-]?[0-9]{1,19}", text) is not None and -(1 << _BITS[kind] - 1) <= int(text) < 1 << _BITS[kind] - 1
    if kind in ("double", "float"):
        return re.fullmatch(r"[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?", text) is not None
    return kind == "string" or (kind == "boolean" and text in ("true", "false"))


class EditError(ValueError):
    """An edit of an unknown column or the row number, or of a value that its type does not take."""


@dataclass
class EditLog:
    """Edits by row and column, the last one of a cell counts; values are text, or None for null."""

    schema: T.StructType
    row_number: str
    cells: dict[int, dict[str, str | None]] = field(default_factory=dict)
    unsaved: bool = False
    rows: int | None = None  # rows of the source, if they are known

    def record(self, spark: SparkSession, row: int, name: str, value: object) -> None:
        """Check and note one edit.  A value that its column's type does not take is refused, never stored as null."""
        if name == self.row_number:
            raise EditError("row numbers are read-only")
        kind = next((f.dataType for f in self.schema.fields if f.name == name), None)
        if kind is None:
            raise EditError(f"no column {name!r}")
        if row < 1 or (self.rows is not None and row > self.rows):
            raise EditError(f"no row {row}")
        self.cells.setdefault(row, {})[name] = None if value is None else self._checked(spark, name, kind, value)
        self.unsaved = True

    @staticmethod
    def _checked(spark: SparkSession, name: str, kind: T.DataType, value: object) -> str:
        if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
            raise EditError(f"{name!r} is nested; its cells can only be set to null")
        text = ("true" if value else "false") if isinstance(value, bool) else str(value)
        if _plainly_fits(text, kind.simpleString()):
            return text
        # constants fold on the driver: no job runs
        if spark.sql(f"SELECT try_cast(:v AS {kind.simpleString()}) IS NULL", args={"v": text}).first()[0]:
            raise EditError(f"{text!r} is no {kind.simpleString()} for {name!r}")
        return text

    def size(self) -> int:
        return sum(64 + sum(len(n) + len(v or "") for n, v in cells.items()) for cells in self.cells.values())

    def __len__(self) -> int:
        return sum(map(len, self.cells.values()))


def overlay(df: DataFrame, log: EditLog) -> DataFrame:
    """``df`` (with the log's row numbers) as the edits make it; columns without an edit are passed on as they are."""
    if not log.cells:
        return df
    edited = {c for cells in log.cells.values() for c in cells}
    at, said = fresh_name(df.columns, "_row"), fresh_name(df.columns, "_said")
    rows = local_table(df.sparkSession, [(at, pa.int64()), (said, pa.map_(pa.string(), pa.string()))], [(row, list(cells.items())) for row, cells in log.cells.items()])
    if log.size() <= BROADCAST_CHARS:
        rows = F.broadcast(rows)
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def cell(name: str):
        if name not in edited:
            return column(name)
        new = F.lit(None).cast(kinds[name]) if isinstance(kinds[name], T.ArrayType | T.MapType | T.StructType) else F.col(said)[name].cast(kinds[name])
        return F.when(F.map_contains_key(said, F.lit(name)), new).otherwise(column(name)).alias(name)

    joined = df.join(rows, column(log.row_number) == F.col(at), "left")
    return joined.select(*[cell(c) for c in df.columns])
