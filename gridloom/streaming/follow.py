"""A view over a folder that grows: the filters of a ViewState on a stream of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.predicates import matching
from ..plans.view import ViewState
from ..sources.parquet import literal_path, scan


def follow(spark: SparkSession, folder: str, state: ViewState, files_per_batch: int | None = None) -> DataFrame:
    """A streaming DataFrame of the rows of ``folder``'s present and future Parquet files that meet the state's filters.

    Filters are stateless, so it needs no watermark; sorts and pages have no
    meaning on a stream and are refused.
    """
    if state.key is not None or state.offset or state.size is not None:
        raise ValueError("a stream has no order to sort or page by")
    reader = spark.readStream.schema(scan(spark, folder).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(literal_path(folder))
    return matching(rows, state.filters, state.text, literal=state.literal)
