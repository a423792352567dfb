"""One-key sorts with a stable tie-break, and pages of any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import column

#: Rows that a page may have before and in it to be cut from a top-k; deeper ones are found by counting first.
DEEP = 20_000
#: Rows that are drawn to part the sort key, and the parts that are counted.
DRAWN, PARTS = 4096, 128
# Keys of these types can be sent back to Spark as constants; any other is paged as a top-k.
_CONSTANT = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def sort_key(df: DataFrame, name: str, collation: str | None = None) -> Column:
    """What rows are sorted by for ``name``: strings in any case, or as ``collation`` has them."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return column(name)
    return F.collate(column(name), collation) if collation else F.lower(column(name))


def sorted_by(df: DataFrame, name: str, ascending: bool, tie: str, collation: str | None = None) -> DataFrame:
    """Rows by ``name``, strings in any case; nulls count as smallest, ties go by ``tie``."""
    key = sort_key(df, name, collation)
    return df.orderBy(key.asc_nulls_first() if ascending else key.desc_nulls_last(), column(tie).asc())


def page(df: DataFrame, offset: int = 0, size: int | None = None) -> DataFrame:
    """``size`` rows after the first ``offset``: with an order before it, a top-k."""
    if offset < 0 or (size is not None and size < 0):
        raise ValueError("a page starts at 0 or later and has no negative size")
    df = df.offset(offset) if offset else df
    return df if size is None else df.limit(size)


def sorted_page(df: DataFrame, name: str, ascending: bool, tie: str, offset: int = 0, size: int | None = None, collation: str | None = None, deep: int = DEEP) -> DataFrame:
    """A page of ``sorted_by``, for which neither the driver nor any task holds the rows before it.

    A deep page is found by distributed selection: some rows are drawn by a
    hash, they part the key, one pass counts the rows of each part, and the
    part that the page starts in is parted again until few rows are left to
    skip.  Each pass reads the key and the row number alone.
    """
    if size is not None and offset + size > deep and not collation and isinstance(df.schema[name].dataType, _CONSTANT):
        df, offset = _from_part(df, sort_key(df, name), ascending, tie, offset, deep)
    return page(sorted_by(df, name, ascending, tie, collation), offset, size)


def _ordered(key: Column, kind: T.DataType) -> Column:
    """``key`` as a value that orders alike and survives the way to the driver and back."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(key)
    if isinstance(kind, T.TimestampNTZType):
        return key - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return key


def _part_of(place: Column, marks: list[Column]) -> Column:
    """How many of the ascending ``marks`` are at most ``place``: by halves, as each row is compared with a few of them only."""
    steps = [1 << k for k in range(len(marks).bit_length() - 1, -1, -1)]
    held = F.array(*marks)
    longer = lambda n, step: F.when(F.get(held, n + step - 1) <= place, n + step).otherwise(n)  # noqa: E731  # beyond the last mark there is null
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), longer)


def _from_part(df: DataFrame, key: Column, ascending: bool, tie: str, offset: int, deep: int) -> tuple[DataFrame, int]:
    """(the rows from the start of a part on, how many of them are to be skipped), for the page that starts at ``offset``."""
    kind = df.select(key.alias("k")).schema["k"].dataType
    number = column(tie).cast("long")
    # one struct orders rows by key and then by number; nulls are smallest in it.  Descending, numbers count down.
    place = F.struct(_ordered(key, kind).alias("k"), (number if ascending else -number).alias("t"))
    shape = df.select(place.alias("p")).schema["p"].dataType

    def constant(p) -> Column:
        return F.struct(*[F.lit(bytes(v) if isinstance(v, bytearray) else v).cast(f.dataType).alias(f.name) for v, f in zip(p, shape.fields, strict=True)])

    bound: Column | None = None  # the page lies beyond it
    left = df
    while offset > deep:
        places = left.select(place.alias("p"))
        drawn = [r.p for r in places.orderBy(F.xxhash64("p.t"), "p.t").limit(DRAWN).orderBy("p").collect()]
        if len(drawn) < DRAWN:
            break
        marks = [constant(drawn[k * DRAWN // PARTS]) for k in range(1, PARTS)]
        part = _part_of(F.col("p"), marks)
        counts = {r.part: r.n for r in places.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
        order = range(PARTS) if ascending else range(PARTS - 1, -1, -1)
        skipped = 0
        for at in order:
            if skipped + counts.get(at, 0) > offset:
                break
            skipped += counts.get(at, 0)
        else:
            return df.where("false"), 0  # beyond the last row
        lost = at == order[0]
        if not lost:
            bound = place >= marks[at - 1] if ascending else place < marks[at]
            offset -= skipped
        # what is counted next ends with the part; what is returned goes on
        end = at < PARTS - 1 if ascending else at > 0
        inside = ((place < marks[at]) if ascending else (place >= marks[at - 1])) if end else None
        conditions = [c for c in (None if lost else bound, inside) if c is not None]
        if not conditions:
            break  # all rows in one part
        for c in conditions:
            left = left.where(c)
    return (df if bound is None else df.where(bound)), offset
