"""Small driver-side rows as a DataFrame that needs no Python worker to be read."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def local_table(spark: SparkSession, fields: Sequence[tuple[str, pa.DataType]], rows: Iterable[Sequence]) -> DataFrame:
    """``rows`` under ``fields``: Spark takes them as Arrow, and a small table becomes part of the plan with its exact size."""
    schema = pa.schema(list(fields))
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))
