"""Text of cells, for search and for export."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType


def cell_text(value: Column, kind: DataType | None = None) -> Column:
    """A cell as text, null for null; independent of locale.  Floating-point numbers, if ``kind`` says so, are written out without an exponent."""
    text = value.cast("string")
    return _without_exponent(text) if isinstance(kind, DoubleType | FloatType) else text


def _without_exponent(text: Column) -> Column:
    """Text of a number, d.ddEx, as plain digits: the same digits, with the point moved by x places."""
    parts = F.substring_index(text, "E", 1)
    digits = F.regexp_replace(F.replace(F.replace(parts, F.lit("-"), F.lit("")), F.lit("."), F.lit("")), "(?<=.)0$", "")  # a single zero after the point is none
    power = F.substring_index(text, "E", -1).cast("int")
    large = F.when(F.length(digits) <= power + 1, F.concat(F.rpad(digits, power + 1, F.lit("0")), F.lit(".0"))).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    sign = F.when(F.startswith(text, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    return F.when(F.contains(text, F.lit("E")), F.concat(sign, F.when(power >= 0, large).otherwise(small))).otherwise(text)


def export_text(value: Column, kind: DataType | None = None) -> Column:
    """A cell as text, empty for null."""
    return F.coalesce(cell_text(value, kind), F.lit(""))


def delimited(value: Column, delimiter: str) -> Column:
    """Text as a field: between commas, one that holds a comma, a quote or a line feed is quoted; between other delimiters none is."""
    if delimiter != ",":
        return value
    return F.when(value.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def whole_seconds(ts: Column, kind: str = "timestamp_ntz") -> Column:
    """A timestamp without its part below the second, of the same type."""
    return F.date_trunc("second", ts).cast(kind)
