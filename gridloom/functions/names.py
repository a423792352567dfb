"""Names of columns and types: quoting, display names, display classes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.local import local_table

# Display names of the plain types.
_DISPLAY = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "smallint": "SMALLINT",
    "tinyint": "TINYINT",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP WITH TIME ZONE",
    "date": "DATE",
    "binary": "BLOB",
}

# A type belongs to the first class of which its lower-case name holds a word.
_CLASSES = (("numeric", ("int", "double", "float")), ("text", ("string", "varchar")), ("temporal", ("date", "timestamp")), ("boolean", ("bool",)))


def quoted(name: str) -> str:
    """``name`` as one column, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def fresh_name(taken: list[str], wanted: str) -> str:
    """``wanted``, or it with as many underscores before it as make it differ from ``taken`` in any case."""
    used = {t.lower() for t in taken}
    while wanted.lower() in used:
        wanted = "_" + wanted
    return wanted


def type_name(kind: T.DataType) -> str:
    """Display name of a type; nested types show their parts."""
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    if isinstance(kind, T.ArrayType):
        return f"{type_name(kind.elementType)}[]"
    if isinstance(kind, T.MapType):
        return f"MAP({type_name(kind.keyType)}, {type_name(kind.valueType)})"
    if isinstance(kind, T.StructType):
        return f"STRUCT({', '.join(f'{f.name} {type_name(f.dataType)}' for f in kind.fields)})"
    if isinstance(kind, T.DayTimeIntervalType | T.YearMonthIntervalType):
        return "INTERVAL"
    return _DISPLAY.get(kind.simpleString(), kind.simpleString().upper())


def type_class(name: str | Column) -> str | Column:
    """Display class of a type name: numeric, text, temporal, boolean or other."""
    if isinstance(name, str):
        return next((c for c, words in _CLASSES if any(w in name.lower() for w in words)), "other")
    out = None
    for label, words in _CLASSES:
        test = F.lower(name).rlike("|".join(words))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise("other")


def describe(df: DataFrame) -> DataFrame:
    """(column_name, column_type, nullable) for each column of ``df``; only the schema is looked at."""
    rows = [(f.name, type_name(f.dataType), f.nullable) for f in df.schema.fields]
    return local_table(df.sparkSession, [("column_name", pa.string()), ("column_type", pa.string()), ("nullable", pa.bool_())], rows)
