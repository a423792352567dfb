"""Parquet as a source: a lazy scan, and what is known of it."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import describe, type_class

ROW_NUMBER = "row_number"


def literal_path(path: str) -> str:
    """``path`` for Spark's readers, which take some of its characters as patterns; separators become slashes."""
    slashed = path.replace("\\", "/") if os.name == "nt" else path
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", slashed)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is stored at ``path``, in whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All columns and rows of a Parquet file or folder.  Raises FileNotFoundError if there is none."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(literal_path(path))


def row_count(df: DataFrame) -> DataFrame:
    """One row, n_rows: all rows of ``df``, from the footers where nothing else is asked."""
    return df.agg(F.count("*").alias("n_rows"))


@dataclass(frozen=True)
class FileInfo:
    """What is known of a source without reading its rows, but for their number."""

    path: str
    rows: int
    columns: list[tuple[str, str, bool]] = field(default_factory=list)

    @property
    def name(self) -> str:
        return os.path.basename(self.path.replace("\\", "/").rstrip("/"))

    def panel(self) -> list[str]:
        """Lines of a schema panel: name, rows, columns, then each column with its class and type."""
        return [self.name, f"{self.rows:,} rows", f"{len(self.columns)} columns", *(f"[{type_class(t)}] {n} ({t})" for n, t, _ in self.columns)]

    def type_of(self, name: str) -> str:
        return next((t for n, t, _ in self.columns if n == name), "unknown")


def file_info(df: DataFrame, path: str, rows: int | None = None) -> FileInfo:
    """What is known of ``df`` at ``path``; its ``rows`` are counted unless they are given."""
    return FileInfo(path, row_count(df).first()[0] if rows is None else rows, [tuple(r) for r in describe(df).collect()])
