"""Selections of rows by number: few as runs in a predicate, many as a relation of runs."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import column, fresh_name

#: Runs that make a predicate; more are joined.
FEW = 16
#: Row numbers under one join key of runs, as a power of two, and bytes of a relation that is sent to every executor, a row counting ROW.
SPAN_BITS, BROADCAST_BYTES, ROW = 12, 256 << 20, 64
#: Rows of a relation that travel as one.
PACKED = 1024


def runs(rows: Iterable[int]) -> np.ndarray:
    """(first, last) of each run of consecutive numbers among ``rows``, ascending."""
    if isinstance(rows, range) and rows.step == 1:
        return np.array([[rows.start, rows.stop - 1]] if rows else [], np.int64).reshape(-1, 2)
    numbers = np.unique(rows if isinstance(rows, np.ndarray) else np.fromiter(rows, np.int64)).astype(np.int64)
    new = np.flatnonzero(np.diff(numbers, prepend=numbers[:1] - 2) != 1)
    return np.stack([numbers[new], numbers[np.append(new[1:], len(numbers)) - 1]], axis=1) if len(numbers) else np.zeros((0, 2), np.int64)


def _cut(some: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(span, low, high): the runs, cut where a span of 2 ** ``bits`` row numbers ends."""
    first, last = some[:, 0] >> bits, some[:, 1] >> bits
    n = last - first + 1
    at = np.repeat(np.arange(len(some)), n)
    span = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return span, np.maximum(some[at, 0], span << bits), np.minimum(some[at, 1], ((span + 1) << bits) - 1)


def _words(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bits): the numbers of the runs as a bitmap, 64 in a word."""
    span, low, high = _cut(some, 6)
    low, high = (low & 63).astype(np.uint64), (high & 63).astype(np.uint64)
    ones = np.uint64(2**64 - 1)
    bits = (ones << low) & (ones >> (np.uint64(63) - high))
    new = np.flatnonzero(np.diff(span, prepend=span[:1] - 1))
    return span[new], np.bitwise_or.reduceat(bits, new).view(np.int64)


def _relation(df: DataFrame, **columns: np.ndarray) -> DataFrame:
    """Long columns as a table next to ``df``; many rows travel as one, so a million of them are planned at once."""
    n = len(next(iter(columns.values())))
    ends = np.append(np.arange(0, n, PACKED), n).astype(np.int32)
    packed = pa.table({name: pa.ListArray.from_arrays(pa.array(ends), pa.array(values)) for name, values in columns.items()})
    table = df.sparkSession.createDataFrame(packed).select(F.inline(F.arrays_zip(*[F.col(c) for c in columns])))
    return F.broadcast(table) if n * ROW <= BROADCAST_BYTES else table


def in_words(df: DataFrame, row_number: str, words: DataFrame) -> DataFrame:
    """The rows of ``df`` whose number is set in the bitmap ``words`` (word, bits)."""
    number = column(row_number)
    at, bits = fresh_name(df.columns, "_word"), fresh_name(df.columns, "_bits")
    set_there = F.call_function("shiftright", F.col(bits), number.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    joined = df.join(words.select(F.col("word").alias(at), F.col("bits").alias(bits)), (F.shiftright(number, 6) == F.col(at)) & set_there)
    return joined.select(*[column(c) for c in df.columns])


def selected(df: DataFrame, row_number: str, rows: Iterable[int], few: int = FEW) -> DataFrame:
    """The rows of ``df`` with the given numbers.

    Up to ``few`` runs become ranges in the filter.  More become a relation
    that is joined, so the plan stays small: a bitmap, or runs by the span of
    numbers they are in, whichever has fewer rows.  It is broadcast up to
    BROADCAST_BYTES, and joined by shuffle beyond.
    """
    some, number = runs(rows), column(row_number)
    if not len(some):
        return df.where("false")
    if len(some) <= few:
        return df.where(reduce(or_, [number == int(a) if a == b else number.between(int(a), int(b)) for a, b in some]))
    if ((some[:, 1] >> 6) - (some[:, 0] >> 6)).sum() <= ((some[:, 1] >> SPAN_BITS) - (some[:, 0] >> SPAN_BITS)).sum() + len(some):
        word, bits = _words(some)
        return in_words(df, row_number, _relation(df, word=word, bits=bits))
    span, low, high = _cut(some, SPAN_BITS)
    names = [fresh_name(df.columns, n) for n in ("_span", "_low", "_high")]
    table = _relation(df, span=span, low=low, high=high).toDF(*names)
    at, first, last = map(F.col, names)
    return df.join(table, (F.shiftright(number, SPAN_BITS) == at) & number.between(first, last)).select(*[column(c) for c in df.columns])
