"""Substring deduplication by content-defined chunks.

Texts are cut where a gear rolling hash is largest among its neighbours, so
cuts depend on nearby content only and an insertion moves no cut beyond its
surroundings.  Chunks are deduplicated by digest (128 bits): the first one, by
(doc_id, place), stays.  Each task first combines its own chunks, so a digest
reaches the shuffle by one row a task and document however often it occurs.
Repeated chunks that follow each other form runs.  A run is cut out of its
text if earlier documents hold at least ``min_words`` words of it; shorter
ones (greetings, license lines) stay, and so does what a text repeats of
itself alone, which is a matter of quality rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import BLOCK_CHARS, U64, mix, ragged
from .common import columns_of, released, with_package, without

#: Units (words, or pieces of words over LONG bytes) to each side among which a cut has the largest hash.
REACH = 3
LONG = 64
#: Units in a chunk, at most: where no hash stands out, as in one word said over and over, every MOST-th unit ends a chunk.
MOST = 32
#: Fewest words in whole chunks that a run shares with earlier documents to be cut out: of a passage of over 50 words, the chunks at its ends hold other words too.
MIN_WORDS = 34

_GEAR = (mix(np.arange(256, dtype=U64) + U64(0x6EA2)) & U64(0xFFFF)).astype(np.uint16)
_GEAR[0] = 0  # texts are laid out with zero bytes between them, which leave no trace in the hash
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_GAP = 16


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i - 1] << 1) + G[data[i]] in 16 bits: the hash of the 16 bytes up to i, by doubling."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint16(k))
    return h


def chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, stop, units, digest: two longs) of each chunk: code points from its first character to the next chunk's.

    White space before a text's first word belongs to no chunk; the last chunk ends with the text.
    """
    import xxhash

    parts = [t.encode() for t in texts]
    gap = b"\0" * _GAP
    joined = gap.join([b"", *parts, b""])
    data = np.frombuffer(joined, np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    begins = np.cumsum(size + _GAP) - size
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, begins, 1)
    np.subtract.at(inside, begins + size, 1)
    solid = (np.cumsum(inside[:-1]) > 0) & ~_WHITE[data]
    edge = np.diff(np.concatenate([[0], solid.astype(np.int8), [0]]))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashed = gear(data)
    long = np.flatnonzero(stops - starts > LONG)
    if len(long):  # words without end: units by the hash alone
        within = np.zeros(len(data) + 1, np.int64)
        np.add.at(within, starts[long], 1)
        np.subtract.at(within, stops[long] - 1, 1)  # never after the last byte
        last = np.flatnonzero((np.cumsum(within[:-1]) > 0) & (hashed % 16 == 0) & ((np.append(data[1:], 0) & 0xC0) != 0x80))
        starts, stops = np.sort(np.concatenate([starts, last + 1])), np.sort(np.concatenate([stops, last + 1]))
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.reshape(0, 2)
    owner = np.searchsorted(begins, starts, "right") - 1
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    ends_line = np.zeros(len(starts), bool)
    ends_line[:-1] = (lines[starts[1:]] > lines[stops[:-1]]) & (owner[1:] == owner[:-1])
    weight = (hashed[stops - 1] >> np.uint16(1)).astype(np.int32) + (ends_line.astype(np.int32) << 15)
    # each unit's weight against its neighbours' in the same text
    at = np.arange(len(starts)) + REACH * (owner + 1)
    field = np.full(len(starts) + REACH * (len(texts) + 2), -1, np.int32)
    field[at] = weight
    cut = np.ones(len(starts), bool)
    for k in range(1, REACH + 1):
        cut &= (weight > field[at - k]) & (weight >= field[at + k])
    cut[-1] = True
    cut[:-1] |= owner[1:] != owner[:-1]
    final = np.flatnonzero(cut)
    units = np.diff(final, prepend=-1)
    wide = units > MOST
    if wide.any():
        more = (units[wide] - 1) // MOST
        step = ragged(np.zeros(len(more), np.int64), more)
        final = np.sort(np.concatenate([final, np.repeat(final[wide] - units[wide], more) + MOST * (step + 1)]))
    first = np.concatenate([[0], final[:-1] + 1])
    digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, map(joined.__getitem__, map(slice, starts[first].tolist(), stops[final].tolist())))), "<i8").reshape(-1, 2)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    text = owner[first]
    start = points[starts[first]] - points[begins[text]]
    stop = np.empty_like(start)
    stop[:-1] = start[1:]
    ends = np.append(text[1:] != text[:-1], True)
    stop[ends] = (points[begins + size] - points[begins])[text[ends]]
    return text, start, stop, final - first + 1, digest


#: Chunks that a task combines at a time.
COMBINED = 1 << 18
_FIELDS = "one long, two long, doc_id long, tag long, chars int, span long, words int, source_id long, known boolean"


def _combined(one, two, doc, null, tag, chars, span) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places that stay, the place that holds the same chunk first, whether that is another document's) of some chunks: each place once."""
    order = np.argsort(one, kind="stable")
    same = one[order[1:]] == one[order[:-1]]
    twice = np.zeros(len(one), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    rest = np.flatnonzero(twice)
    rest = rest[np.lexsort((span[rest], chars[rest], tag[rest], doc[rest], ~null[rest], two[rest], one[rest]))]
    fresh, moved = np.ones(len(rest), bool), np.ones(len(rest), bool)
    fresh[1:] = (one[rest[1:]] != one[rest[:-1]]) | (two[rest[1:]] != two[rest[:-1]])
    moved[1:] = fresh[1:]
    for field in (doc, null, tag, chars, span):
        moved[1:] |= field[rest[1:]] != field[rest[:-1]]
    lead = rest[np.maximum.accumulate(np.where(fresh, np.arange(len(rest)), 0))] if len(rest) else rest
    alone = np.flatnonzero(~twice)
    stay, leads = rest[moved], lead[moved]
    elsewhere = (doc[stay] != doc[leads]) | (null[stay] != null[leads]) | (tag[stay] != tag[leads]) | (chars[stay] != chars[leads])
    return np.concatenate([alone, stay]), np.concatenate([alone, leads]), np.concatenate([np.zeros(len(alone), bool), elsewhere])


def chunk_table(docs: DataFrame) -> DataFrame:
    """The chunks of every row: digest (one, two), document (doc_id, tag and chars of its text), span (start * 2**32 + stop) and words.

    Repeats of another document in the same task are known: source_id is then
    the document of the task's first place with that chunk.
    """
    names = [f.split()[0] for f in _FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def combined() -> Iterator[pa.RecordBatch]:
            digest, doc, null, tag, chars, span, units = (np.concatenate(c) for c in zip(*held, strict=True))
            one, two = digest[:, 0].copy(), digest[:, 1].copy()
            stay, lead, known = _combined(one, two, doc, null, tag, chars, span)
            for at in range(0, len(stay), 1 << 16):
                k, f, again = stay[at : at + (1 << 16)], lead[at : at + (1 << 16)], known[at : at + (1 << 16)]
                columns = [pa.array(one[k]), pa.array(two[k]), pa.array(doc[k], mask=null[k]), pa.array(tag[k]), pa.array(chars[k]), pa.array(span[k]), pa.array(units[k]), pa.array(doc[f], mask=null[f] | ~again), pa.array(again)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        def add(ids: np.ndarray, null: np.ndarray, tags: np.ndarray, texts: list[str]) -> int:
            text, start, stop, units, digest = chunks(texts)
            size = np.array([len(t) for t in texts], np.int32)
            held.append((digest, ids[text], null[text], tags[text], size[text], start << 32 | stop, units.astype(np.int32)))
            return len(text)

        for batch in batches:
            ids, tags, texts = batch.columns
            null = np.array(ids.is_null())
            ids, tags = np.asarray(ids.fill_null(0)), np.asarray(tags)
            at, size = 0, 0
            for k in range(batch.num_rows + 1):
                more = len(texts[k].as_py()) if k < batch.num_rows else 0
                if k > at and (k == batch.num_rows or size + more > BLOCK_CHARS):
                    n += add(ids[at:k], null[at:k], tags[at:k], texts.slice(at, k - at).to_pylist())
                    at, size = k, 0
                    if n >= COMBINED:
                        yield from combined()
                        held.clear()
                        n = 0
                size += more
        if held:
            yield from combined()
        released()

    text = F.coalesce("text", F.lit(""))
    return with_package(docs).select("doc_id", F.xxhash64(text).alias("tag"), text.alias("text")).mapInArrow(run, _FIELDS)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, tag, chars, cut, source_ids) of the documents that hold repeated runs: intervals ascending, and doc_ids that hold their text before them.

    Chunks are shuffled once, by digest; those that their task knows to be
    another document's need no company there and are spread by their place.
    """
    place, document = F.struct("doc_id", "tag", "chars", "span"), F.struct("doc_id", "tag", "chars")
    spread = F.when(F.col("known"), F.xxhash64("doc_id", "tag", "span")).otherwise(0)
    table = chunk_table(docs).withColumn("spread", spread).repartition("one", "two", "spread")
    first = F.first(place).over(Window.partitionBy("one", "two", "spread").orderBy("doc_id", "tag", "chars", "span").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = table.select("doc_id", "tag", "chars", "span", "words", "known", "source_id", place.alias("place"), document.alias("document"), first.alias("first")).where("known OR NOT place <=> first")
    elsewhere = F.col("known") | ~F.col("document").eqNullSafe(F.struct("first.doc_id", "first.tag", "first.chars"))
    source = F.when(F.col("known"), F.col("source_id")).otherwise(F.col("first.doc_id"))
    start, stop = F.shiftright("span", 32).cast("int"), F.col("span").bitwiseAND(0xFFFFFFFF).cast("int")
    dups = found.select("doc_id", "tag", "chars", start.alias("start"), stop.alias("stop"), "words", elsewhere.alias("elsewhere"), source.alias("source_id"))
    # all that follows keeps this partitioning
    ours = dups.repartition("doc_id", "tag", "chars").groupBy("doc_id", "tag", "chars", "start", "stop").agg(F.max("words").alias("words"), F.max("elsewhere").alias("elsewhere"), F.min(F.when(F.col("elsewhere"), F.col("source_id"))).alias("source_id"))
    order = Window.partitionBy("doc_id", "tag", "chars").orderBy("start")
    runs = ours.withColumn("new", F.coalesce((F.lag("stop").over(order) != F.col("start")).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(order))
    shared = F.sum(F.when(F.col("elsewhere"), F.col("words")).otherwise(0))
    long = runs.groupBy("doc_id", "tag", "chars", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.collect_set("source_id").alias("sources"), shared.alias("words")).where(F.col("words") >= min_words)
    return long.groupBy("doc_id", "tag", "chars").agg(
        F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cut"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("source_ids")
    )


def _cut(docs: DataFrame, min_words: int) -> tuple[DataFrame, Column]:
    """``docs`` as ``own`` with its runs as ``runs``, and the text without them."""
    text = F.coalesce(F.col("own.text"), F.lit(""))
    same = F.col("own.doc_id").eqNullSafe(F.col("runs.doc_id")) & (F.xxhash64(text) == F.col("runs.tag")) & (F.char_length(text) == F.col("runs.chars"))
    joined = docs.alias("own").join(repeated_runs(docs, min_words).alias("runs"), same, "left")
    return joined, F.when(F.col("runs.cut").isNull(), F.col("own.text")).otherwise(without(F.col("own.text"), F.col("runs.cut"), ""))


#: Columns that ``dedup_substrings`` adds; columns of these names in its input are left behind.
ADDED = ("removed_chars", "removed", "source_ids")


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated runs cut out of ``text``, and removed_chars, removed (spans in the old text) and source_ids.

    The first document by doc_id keeps a run, and what only its own text
    repeats stays too; which of the earlier ones source_ids names depends on
    the partitions.  Null and
    empty texts stay as they are; a null doc_id sorts first; documents of one
    doc_id are told apart by their texts; rows that repeat a doc_id and its
    text are one document and stay alike; very long texts are chunked whole;
    an empty table gives none; other columns pass through, but for those called as ADDED.
    """
    own = docs.drop(*ADDED)
    joined, text = _cut(own, min_words)
    cut = F.coalesce(F.col("runs.cut"), F.array().cast("array<struct<start:int,stop:int>>"))
    chars = F.aggregate(cut, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    sources = F.coalesce(F.col("runs.source_ids"), F.array().cast("array<long>"))
    return joined.select(*columns_of(own, "own", text=text), chars.alias("removed_chars"), cut.alias("removed"), sources.alias("source_ids"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of ``docs``, under any names, with repeated runs cut out of ``text``; rows of which no word is left go, but for those that had none."""
    joined, text = _cut(docs, min_words)
    left = joined.select(*columns_of(docs, "own", text=text), F.col("runs.cut").isNotNull().alias("__cut"))
    left = left.where(~F.col("__cut") | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*columns_of(docs))
