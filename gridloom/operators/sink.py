"""Saving Parquet without putting the old data at risk.

``save`` writes any DataFrame.  ``save_source`` writes a source with its edits:
no row is sorted or shuffled, as every task writes a stretch of one file and
the files are named in stored order.  A target of one file is written in parts
as well, whose row groups are then put behind each other.  Over the source itself only files that
have edits are written.  New files are made beside the target and moved over
it once all are there; a list of the moves is written first, so ``recover``
can finish what a crash cut short.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampNTZType, TimestampType

from ..functions.names import column
from ..functions.text import whole_seconds
from ..sources.files import Source, location
from ..sources.parquet import literal_path
from .edits import BROADCAST_CHARS, EditLog, overlay

#: Up to this many rows a new target of ``save`` becomes one file; beyond it, a folder of files in row order.
ONE_FILE_ROWS = 5_000_000
#: Up to this many bytes of a source a new target of ``save_source`` becomes one file; one file of more than MOST_FILE_BYTES is never rewritten as one.
ONE_FILE_BYTES, MOST_FILE_BYTES = 1 << 30, 16 << 30
#: Bytes of a file that one task writes anew, at most, where its target may have several files.
STRETCH_BYTES = 1 << 30
#: A source of up to this many files is written as one file by stretches; one of more, which may be tiny, by a sort.
MOST_STRETCHES = 1000
#: Files that are moved at a time.
MOVERS = 16
_MOVES, _ONE = "_moves.json", "one.parquet"


class SaveError(RuntimeError):
    """What was written is not what was to be saved; the old data are as they were."""


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _beside(target) -> str:
    return f"{str(target.getParent())}/.{target.getName()}.{uuid.uuid4().hex}"


def _stored(schema: StructType, precision: str | None) -> list[Column]:
    """The columns as they are stored."""
    if precision not in (None, "second"):
        raise ValueError("timestamp_precision is None or 'second'")
    cut = lambda f: precision and isinstance(f.dataType, TimestampType | TimestampNTZType)
    return [whole_seconds(column(f.name), f.dataType.simpleString()).alias(f.name) if cut(f) else column(f.name) for f in schema.fields]


def _written(out: DataFrame, to: str, rows: int | None = None) -> int:
    """Write ``out`` to the folder ``to`` and return its rows, counted while they are written; other than ``rows``, if given, raises."""
    seen = Observation()
    out.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(to)
    n = seen.get["n"]
    if rows is not None and n != rows:  # a task that ran twice counts twice: the files' own footers decide
        n = out.sparkSession.read.schema(out.schema).parquet(literal_path(to)).agg(F.count("*")).first()[0]
        if n != rows:
            raise SaveError(f"{n} rows were written instead of {rows}")
    return n


def _parts(fs, folder) -> list:
    """The files that tasks wrote, part-<task>-..., in the order of the tasks."""
    names = lambda p: (int(p.getName().split("-")[1]), p.getName())
    return sorted((s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), key=names)


def _one_file(spark: SparkSession, parts: Sequence, to: str):
    """One file, at ``to`` unless there is one part: the row groups of ``parts`` in their order.

    Row groups are copied as they are stored, a buffer at a time; no row is
    read, and only footers are held.  Page indexes are left out.
    """
    if not parts:
        raise SaveError("no file was written")
    if len(parts) == 1:
        return parts[0]
    hadoop, conf = spark._jvm.org.apache.parquet.hadoop, spark._jsc.hadoopConfiguration()
    files = [hadoop.util.HadoopInputFile.fromPath(p, conf) for p in parts]
    opened = hadoop.ParquetFileReader.open(files[0])
    try:
        said = opened.getFooter().getFileMetaData()
    finally:
        opened.close()
    at, _ = _path(spark, to)
    out = hadoop.ParquetFileWriter(conf, said.getSchema(), at)
    out.start()
    for f in files:
        out.appendFile(f)
    out.end(said.getKeyValueMetaData())
    return at


def save(df: DataFrame, path: str, row_number: str | None = None, timestamp_precision: str | None = None, layout: str | None = None) -> int:
    """Write any ``df`` without its row number to ``path``, in its order, and return the number of rows.

    Types stay as they are; ``timestamp_precision="second"`` truncates
    timestamps.  ``layout`` is "file" or "directory"; by default what is there
    already decides, and for a new path the number of rows.  All is written
    beside the target, counted, and only then moved over it; whatever fails
    before leaves the target alone.
    """
    spark = df.sparkSession
    target, fs = _path(spark, path)
    stored = _stored(StructType([f for f in df.schema.fields if f.name != row_number]), timestamp_precision)
    n = None
    if layout is None and fs.exists(target):
        layout = "directory" if fs.getFileStatus(target).isDirectory() else "file"
    elif layout is None:
        n = df.count()
        layout = "directory" if n > ONE_FILE_ROWS else "file"
    out = (df.orderBy(column(row_number)) if row_number else df).select(*stored)
    beside = _beside(target)
    staging, _ = _path(spark, beside)
    try:
        n = _written(out, beside, n)
        if layout == "file":
            _replace_file(spark, fs, _one_file(spark, _parts(fs, staging), f"{beside}/{_ONE}"), target)
        else:
            _replace_folder(spark, fs, staging, target)
    finally:
        fs.delete(staging, True)
    spark.catalog.refreshByPath(path)
    return n


def _pinned(spark: SparkSession, most: int) -> SparkSession:
    """A session with the settings of ``spark`` in which every task reads a stretch of one file, of up to ``most`` bytes; nobody else's settings change."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    # a file counts as much as a task may read, so no second one fits in
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        own.conf.set(name, str(most))
    return own


def edited_rows(source: Source, log: EditLog, files: Sequence[Row], spark: SparkSession, timestamp_precision: str | None = None) -> DataFrame:
    """The rows of ``files`` as the edits make them: a scan and a broadcast of the edits, so each file's order stays."""
    rows = source.files.numbered(source.some_files(files, spark), source.row_number, files)
    return overlay(rows, log).select(*_stored(source.schema, timestamp_precision))


def _stretches(source: Source, files: Sequence[Row], spark: SparkSession) -> list[Row]:
    """(split, path, block, n, before) of the stretches that tasks read, in stored order; from the footers."""
    scanned = source.some_files(files, spark)
    found = scanned.groupBy(F.spark_partition_id().alias("split"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")).agg(F.count("*").alias("n")).collect()
    before = {f.path: f.before for f in files}
    return sorted(found, key=lambda r: (before[r.path], r.block))


def _rewritten(source: Source, log: EditLog, files: Sequence[Row], staging, fs, beside: str, precision: str | None, most: int) -> list[tuple[Row, list]]:
    """Write ``files`` with their edits to ``beside``; (stretch, its new files) in stored order."""
    spark = _pinned(source.spark, most)
    stretches = _stretches(source, files, spark)
    if len({s.split for s in stretches}) < len(stretches):
        raise SaveError("a task reads several files")  # the session was not left as it was set
    _written(edited_rows(source, log, files, spark, precision), beside, sum(f.n for f in files))
    made: dict[int, list] = {}
    for part in _parts(fs, staging):
        made.setdefault(int(part.getName().split("-")[1]), []).append(part)  # part-<task>-...
    if set(made) - {s.split for s in stretches} and any(s.n for s in stretches):
        raise SaveError("files were written by tasks that read none")
    return [(s, made[s.split]) for s in stretches if s.split in made]


def save_source(source: Source, log: EditLog, path: str, timestamp_precision: str | None = None, layout: str | None = None) -> int:
    """Write ``source`` with the edits of ``log`` to ``path``, in stored order, and return the number of rows.

    Over the source itself, files without an edit stay as they are, and each
    other one is replaced by its new version.  A new path becomes one file up
    to ONE_FILE_BYTES of source, and a folder beyond; ``layout`` overrides.
    Logs beyond what is broadcast go the way of ``save``, with a sort.
    """
    spark = source.spark
    target, fs = _path(spark, path)
    there = fs.exists(target)
    kind = None if not there else "directory" if fs.getFileStatus(target).isDirectory() else "file"
    own = kind is not None and fs.makeQualified(target).equals(fs.makeQualified(_path(spark, source.path)[0])) and layout in (None, kind)
    files = source.files
    every = lambda: files.within(1, files.rows)
    if log.size() > BROADCAST_CHARS:
        return save(overlay(source.numbered, log), path, source.row_number, timestamp_precision, layout)
    touched = bool(timestamp_precision) and any(isinstance(f.dataType, TimestampType | TimestampNTZType) for f in source.schema.fields)
    if timestamp_precision not in (None, "second"):
        raise ValueError("timestamp_precision is None or 'second'")
    beside = _beside(target)
    staging, _ = _path(spark, beside)
    done = False
    try:
        if own:
            chosen = every() if touched else files.holding(log.cells)
            if chosen:
                _replace(source, log, chosen, staging, fs, beside, timestamp_precision, kind == "file")
        else:
            whole = every()
            size = sum(f.bytes for f in whole)
            layout = layout or kind or ("file" if size <= ONE_FILE_BYTES else "directory")
            _write_new(source, log, whole, size, staging, fs, beside, target, timestamp_precision, layout)
        done = True
    finally:
        if done or not fs.exists(_path(spark, f"{beside}/{_MOVES}")[0]):
            fs.delete(staging, True)  # else moves have begun, and recover() ends them
    spark.catalog.refreshByPath(path)
    return files.rows


def _write_new(source: Source, log: EditLog, whole: Sequence[Row], size: int, staging, fs, beside: str, target, precision: str | None, layout: str) -> None:
    spark = source.spark
    if layout == "file" and size > MOST_FILE_BYTES:
        raise SaveError(f"{size:,} bytes are too many for one file; save with layout='directory'")
    if not whole:
        _written(source.plain.where("false").select(*_stored(source.schema, precision)).coalesce(1), beside, 0)
        parts = _parts(fs, staging)
    elif layout == "file" and len(whole) > MOST_STRETCHES:
        rows = overlay(source.numbered, log).orderBy(column(source.row_number))
        _written(rows.select(*_stored(source.schema, precision)), beside, source.files.rows)
        parts = _parts(fs, staging)
    else:
        parts = [p for _, some in _rewritten(source, log, whole, staging, fs, beside, precision, STRETCH_BYTES) for p in some]
        if layout == "directory":
            _move(spark, [(p.toString(), f"{beside}/rows-{k:08d}.parquet") for k, p in enumerate(parts)])
    if layout == "directory":
        _replace_folder(spark, fs, staging, target)
    else:
        _replace_file(spark, fs, _one_file(spark, parts, f"{beside}/{_ONE}"), target)


def _replace(source: Source, log: EditLog, chosen: Sequence[Row], staging, fs, beside: str, precision: str | None, one: bool) -> None:
    """Write ``chosen`` anew and move the new files over them, after a list of these moves is stored."""
    large = [f for f in chosen if f.bytes > MOST_FILE_BYTES]
    if one and large:
        raise SaveError(f"{location(large[0].path)} has {large[0].bytes:,} bytes, too many to be written anew as one file; save it as a folder")
    found: dict[str, list] = {}
    for stretch, parts in _rewritten(source, log, chosen, staging, fs, beside, precision, STRETCH_BYTES):
        found.setdefault(location(stretch.path), []).extend(parts)
    made = {old: [p.toString() for p in ([_one_file(source.spark, parts, f"{beside}/{_ONE}")] if one else parts)] for old, parts in found.items()}
    # several new files take the old one's name as the beginning of theirs, and so its place in the order
    moves = [(part, old if len(parts) == 1 else f"{old}.{k:06d}.parquet") for old, parts in made.items() for k, part in enumerate(parts)]
    gone = [old for old, parts in made.items() if len(parts) > 1]
    _store(source.spark, f"{beside}/{_MOVES}", json.dumps({"moves": moves, "gone": gone}))
    try:
        _finish(source.spark, moves, gone)
    except BaseException:
        if all(fs.exists(_path(source.spark, part)[0]) for part, _ in moves):  # none was moved, so nothing has changed
            fs.delete(_path(source.spark, f"{beside}/{_MOVES}")[0], False)
        raise


def _store(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file at once: under another name, then moved."""
    at, fs = _path(spark, path)
    draft, _ = _path(spark, f"{path}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.rename(draft, at)


def _load(spark: SparkSession, at) -> str:
    opened = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(opened.readAllBytes()).decode()
    finally:
        opened.close()


def _move(spark: SparkSession, moves: Iterable[tuple[str, str]]) -> None:
    """Each file over its target, some at a time; one that is gone has been moved before."""

    def one(move: tuple[str, str]) -> None:
        part, fs = _path(spark, move[0])
        if fs.exists(part):
            _replace_file(spark, fs, part, _path(spark, move[1])[0])

    with ThreadPoolExecutor(MOVERS) as pool:
        for _ in pool.map(one, moves):
            pass


def _finish(spark: SparkSession, moves: Iterable[Sequence[str]], gone: Iterable[str]) -> None:
    _move(spark, [tuple(m) for m in moves])
    for old in gone:
        at, fs = _path(spark, old)
        fs.delete(at, False)


def recover(spark: SparkSession, path: str) -> int:
    """End the saves over ``path`` that were cut short after all was written; returns how many there were."""
    target, fs = _path(spark, path)
    parent = target.getParent()
    if parent is None or not fs.exists(parent):
        return 0
    ended = 0
    for status in fs.globStatus(_path(spark, f"{literal_path(str(parent))}/.{literal_path(target.getName())}.*/{_MOVES}")[0]) or []:
        at = status.getPath()
        said = json.loads(_load(spark, at))
        _finish(spark, said["moves"], said["gone"])
        fs.delete(at.getParent(), True)
        ended += 1
    if ended:
        spark.catalog.refreshByPath(path)
    return ended


def _replace_file(spark: SparkSession, fs, part, target) -> None:
    if fs.exists(target) and fs.getFileStatus(target).isDirectory():
        _replace_folder(spark, fs, part, target)
        return
    jvm = spark._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    kinds = spark.sparkContext._gateway.new_array(rename, 1)
    kinds[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(part), fs.makeQualified(target), kinds)


def _replace_folder(spark: SparkSession, fs, staging, target) -> None:
    """Move ``staging`` to ``target``; the old target is put aside first and back again if that fails."""
    aside, _ = _path(spark, f"{str(target.getParent())}/.{target.getName()}.old-{uuid.uuid4().hex}")
    had = fs.exists(target)
    if had and not fs.rename(target, aside):
        raise SaveError(f"{target} cannot be put aside")
    if not fs.rename(staging, target):
        if had:
            fs.rename(aside, target)
        raise SaveError(f"{staging} cannot be moved to {target}")
    if had:
        fs.delete(aside, True)
