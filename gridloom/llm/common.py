"""What the operators share: session settings, narrow inputs, Arrow blocks."""

from __future__ import annotations

import os
import tempfile
import weakref
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the text contracts: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(df: DataFrame, *cols: str) -> DataFrame:
    """``cols`` and the text (null: empty); all other columns are left behind, so clashing names do no harm."""
    return df.select(*cols, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def columns_of(df: DataFrame, alias: str = "", **instead: Column) -> list[Column]:
    """All columns of ``df`` (under ``alias``, in a join) whatever their names hold, with the columns ``instead`` in place of those named."""
    own = lambda c: F.col((f"{alias}." if alias else "") + "`" + c.replace("`", "``") + "`")
    return [instead[c].alias(c) if c in instead else own(c) for c in df.columns]


def let(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Characters in a part of a text from which pieces are taken, as finding a place in a text means to count from its start.
_PART = 1024


def without(text: Column, cut: Column, mask: str) -> Column:
    """``text`` with the intervals ``cut`` replaced by ``mask``."""

    def piece(parts: Column, start: Column, stop: Column) -> Column:
        i, j = F.floor(start / _PART).cast("int"), F.floor(stop / _PART).cast("int")
        at = lambda k: F.coalesce(F.get(parts, k), F.lit(""))
        inside = F.substring(at(i), start % _PART + 1, stop - start)
        across = F.concat(F.substring(at(i), start % _PART + 1, F.lit(_PART)), F.array_join(F.slice(parts, i + 2, j - i - 1), ""), F.substring(at(j), F.lit(1), stop % _PART))
        return F.when(stop <= start, F.lit("")).when(i == j, inside).otherwise(across)

    def build(s: Column) -> Column:
        befores = F.concat(F.array(F.lit(0)), F.transform(s["cut"], lambda c: c["stop"]))
        afters = F.concat(F.transform(s["cut"], lambda c: c["start"]), F.array(s["size"]))
        return F.array_join(F.zip_with(befores, afters, lambda b, a: piece(s["parts"], b, a)), mask)

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PART}}}"), F.lit(0))
    return let(F.struct(parts.alias("parts"), cut.alias("cut"), F.char_length(text).alias("size")), build)


_SHIPPED: weakref.WeakSet = weakref.WeakSet()


#: Bytes in an Arrow batch, unless the session sets its own bound: Spark's counts rows, and texts can be long.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def with_package(df: DataFrame) -> DataFrame:
    """``df``, ready for Python workers: batches are bounded in bytes, and this package is sent to the executors, once a context."""
    if not df.sparkSession._jsparkSession.sessionState().conf().contains(_BATCH):
        df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    context = df.sparkSession.sparkContext
    if context not in _SHIPPED:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        if os.path.isdir(top):
            to = os.path.join(tempfile.mkdtemp(prefix="gridloom-package-"), "gridloom.zip")
            with zipfile.ZipFile(to, "w") as z:
                for folder, _, names in os.walk(top):
                    for n in names:
                        if n.endswith(".py"):
                            z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(top)))
            context.addPyFile(to)
        _SHIPPED.add(context)
    return df


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on the long ``key``, ``right`` having one row for each, so that a key of many left rows can be split.

    Adaptive execution splits a skewed partition only if both sides come
    straight from an exchange.  A side that was aggregated or joined by the
    key keeps its partitioning and has none; so both are joined on the key's
    complement, for which no side is partitioned yet.
    """
    mark = "_complement"
    return left.withColumn(mark, F.bitwise_not(key)).join(right.withColumn(mark, F.bitwise_not(key)).drop(key), mark, how).drop(mark)


def released() -> None:
    """Give a finished task's memory back: workers are kept for later tasks, beside other executors' processes."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps its own counsel


def shared_checkpoints(spark: SparkSession) -> str:
    """Make checkpoint() usable and return its folder: the cluster's own if it names one, else, on one machine (tests), a temporary one.

    The folder is this application's own and goes when it ends.
    """
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridloom-checkpoint-"))
    folder = context.getCheckpointDir().get()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that lost executors cost no recomputation."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(df: DataFrame) -> None:
    """Delete the files of a ``checkpointed`` table that nothing reads any more."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def map_rows(df: DataFrame, make: Callable[[], Callable[[list, list], Iterator[dict]]], schema: str) -> DataFrame:
    """Map (doc_id, text) rows block by block.

    ``make()`` runs once a task and gives a function from the ids and texts of
    a block to columns named as in ``schema``.
    """
    from .arrays import BLOCK_CHARS

    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at, held, n = 0, [], 0
            for k in range(len(ids)):
                t = texts[k].as_py()
                if held and n + len(t) > BLOCK_CHARS:
                    yield block(work, ids[at:k], held)
                    at, held, n = k, [], 0
                held.append(t)
                n += len(t)
            if held:
                yield block(work, ids[at:], held)
        released()

    def block(work, ids: list, texts: list[str]) -> pa.RecordBatch:
        out = work(ids, texts)
        return pa.RecordBatch.from_arrays([pa.array(out[n]) if not isinstance(out[n], pa.Array) else out[n] for n in names], names=names)

    return with_package(df).select("doc_id", "text").mapInArrow(run, schema)
