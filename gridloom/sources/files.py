"""The files of a source: how many rows each has, and which file a row is in.

The counts come from the footers, once, in parallel, and are kept as a written
table of one row a file.  The driver holds eight bytes a file, enough to tell
which files a page, a selection or an edit touches; then only those are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import cached_property
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import column, fresh_name
from .local import local_table
from .parquet import ROW_NUMBER, literal_path, scan
from .scratch import scratch

#: Starts of files are sent to every executor up to this many bytes, a file counting STARTS; beyond it they are joined by shuffle.
BROADCAST_BYTES, STARTS = 1 << 30, 64
#: Bytes of files that a page may lie in before only the splits that hold it are read.
PAGE_BYTES = 256 << 20


class FileTable:
    """Path, rows and first row of every file with rows, in path order; ``starts`` are the rows before each, and before the end."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        known = self.table(spark).select("ordinal", "before", "n").orderBy("ordinal").toArrow()  # numbers only
        before, n = known["before"].to_numpy(), known["n"].to_numpy()
        self.starts = np.append(before, before[-1] + n[-1] if len(n) else 0)

    @classmethod
    def of(cls, plain: DataFrame) -> FileTable:
        """Count the rows of each file of a fresh scan."""
        spark = plain.sparkSession
        counts = plain.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"), F.max("_metadata.file_size").alias("bytes"))
        order = Window.orderBy("path")  # one row a file
        placed = counts.select((F.row_number().over(order) - 1).cast("long").alias("ordinal"), "path", "n", "bytes", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        folder = scratch(spark, "files")
        placed.write.parquet(folder)
        return cls(spark, folder)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("ordinal long, path string, n long, bytes long, before long").parquet(literal_path(self.folder))

    def __len__(self) -> int:
        return len(self.starts) - 1

    @property
    def rows(self) -> int:
        return int(self.starts[-1])

    @cached_property
    def seed(self) -> int:
        """One for which the 64-bit digests of all paths differ."""
        seed = 0
        while True:
            n, kinds = self.table(self.spark).agg(F.count("*"), F.countDistinct(_digest(F.col("path"), seed))).first()
            if n == kinds:
                return seed
            seed += 1

    def numbered(self, df: DataFrame, name: str, only: Sequence[Row] | None = None, extra: Sequence[Column] = ()) -> DataFrame:
        """``df``, a fresh scan of some of the files, with its row numbers and ``extra`` columns first.

        A digest of each file's path and its start, two longs, go to every
        executor, or for very many files to a join by shuffle; ``only`` are
        the files (of ``within`` or ``holding``) that ``df`` is of, if it is not of all.
        """
        spark = df.sparkSession
        if only is None:
            starts, n, digest = self.table(spark).select(_digest(F.col("path"), self.seed).alias("_digest"), "before"), len(self), lambda p: _digest(p, self.seed)
        else:
            starts, n, digest = local_table(spark, [("_digest", pa.string()), ("before", pa.int64())], [(r.path, r.before) for r in only]), len(only), lambda p: p
        if n * STARTS <= BROADCAST_BYTES:
            starts = F.broadcast(starts)
        own = df.select(digest(F.col("_metadata.file_path")).alias("_at"), F.col("_metadata.row_index").alias("_index"), *extra, *[column(c) for c in df.columns])
        kept = own.columns[2:]
        return own.join(starts, own["_at"] == starts["_digest"]).select((F.col("before") + F.col("_index") + 1).alias(name), *[column(c) for c in kept])

    def ordinals(self, rows: np.ndarray) -> np.ndarray:
        """The files, ascending, of row numbers counted from 1; numbers that no row has are passed over."""
        rows = rows[(rows >= 1) & (rows <= self.rows)]
        return np.unique(np.searchsorted(self.starts, rows - 1, "right") - 1)

    def within(self, first: int, last: int) -> list[Row]:
        """The files of rows ``first`` to ``last``."""
        at = self.ordinals(np.array([max(first, 1), min(last, self.rows)])) if first <= last and self.rows else np.zeros(0, np.int64)
        if first > self.rows or not len(at):
            return []
        return self.table(self.spark).where(F.col("ordinal").between(int(at[0]), int(at[-1]))).orderBy("ordinal").collect()

    def holding(self, rows: Iterable[int]) -> list[Row]:
        """The files of the given rows."""
        at = self.ordinals(np.fromiter(rows, np.int64))
        wanted = F.broadcast(local_table(self.spark, [("ordinal", pa.int64())], [(int(k),) for k in at]))  # at most one a row that was given
        return self.table(self.spark).join(wanted, "ordinal", "left_semi").orderBy("ordinal").collect()


def location(path: str) -> str:
    """Where a file is, from what its rows' metadata say, in which some characters are escaped."""
    return unquote(path)


def _digest(path: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), path)


class Source:
    """A Parquet file or folder, with its rows numbered from 1 in stored order: files by path, and each file's own order."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.plain = scan(spark, path)
        self.schema = self.plain.schema
        self.row_number = fresh_name(self.plain.columns, ROW_NUMBER)
        found = self.plain._jdf.inputFiles()
        self.several = len(found) > 1

    @cached_property
    def files(self) -> FileTable:
        return FileTable.of(self.plain)

    @cached_property
    def numbered(self) -> DataFrame:
        """All rows, lazily: a narrow projection for one file, a join with the starts of several."""
        if self.several:
            return self.files.numbered(self.plain, self.row_number)
        return self.plain.select((F.col("_metadata.row_index") + 1).alias(self.row_number), *[column(c) for c in self.plain.columns])

    def some_files(self, files: Sequence[Row], spark: SparkSession | None = None) -> DataFrame:
        """A scan of ``files`` alone, as columns of this source."""
        spark = spark or self.spark
        if not files:
            return spark.createDataFrame([], self.schema)
        reader = spark.read.schema(self.schema)
        if self.several:  # names of folders may be columns
            reader = reader.option("basePath", self.path)
        return reader.parquet(*[literal_path(location(f.path)) for f in files])

    def some_rows(self, first: int, last: int) -> DataFrame:
        """Rows ``first`` to ``last`` by number, from the files that hold them; large files are read by the splits that do."""
        files = self.files.within(first, last)
        if not files:
            return self.numbered.where("false")
        rows = self.files.numbered(self.some_files(files), self.row_number, files)
        number = column(self.row_number)
        page = rows.where(number.between(first, last))
        if sum(f.bytes for f in files) <= PAGE_BYTES:
            return page
        splits = rows.groupBy(F.spark_partition_id().alias("split")).agg(F.min(number).alias("low"), F.max(number).alias("high")).where((F.col("low") <= last) & (F.col("high") >= first))
        wanted = sorted(r.split for r in splits.collect())  # splits of this page, from the footers
        found = self.spark.sparkContext.runJob(page.rdd, list, wanted)
        if len(found) != min(last, self.files.rows) - max(first, 1) + 1:
            return page  # the files were dealt out anew in between
        return self.spark.createDataFrame(found, page.schema)

    def holding(self, rows: Iterable[int]) -> DataFrame:
        """All rows of the files that hold the given ones, numbered."""
        if not self.several:
            return self.numbered
        files = self.files.holding(rows)
        return self.files.numbered(self.some_files(files), self.row_number, files) if files else self.numbered.where("false")


def numbered(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """The numbered scan of ``path``, and its number column's name, which no stored column has in any case."""
    source = Source(spark, path)
    return source.numbered, source.row_number
