"""Document fingerprints by locally consistent parsing.

A text is parsed level by level.  Runs of one symbol become one symbol;
deterministic coin tossing (each symbol keeps the lowest bit in which it
differs from its left neighbour, and that bit's place, again and again) leaves
a few colours; phrases start at local maxima of the colours and are named by a
hash of their symbols.  A cut depends on a few neighbours only, so equal
substrings get the same phrases but near their ends, at whatever offset they
stand.  The fingerprint samples the phrase names from level FLOOR up by
minimum hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import BLOCK_CHARS, U64, code_points, mix, span_hash
from .common import released, text_or_empty, with_package

#: Phrases from this level on (about 20 characters) are sampled; the root of a shorter text always is.
FLOOR = 3
#: Minimum hashes in a fingerprint, 16 bits each; EMPTY marks one without a phrase.
SLOTS, EMPTY = 64, 0xFFFF
#: Bytes of text in a part that is sorted and fingerprinted in one task, about.
PART_BYTES = 32 << 20
#: Ranges, at most: beyond it they grow, as a range is sorted with spills and read as a stream.
MOST_PARTS = 20_000

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _toss(colour: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing: 2 * (lowest bit that differs from the left neighbour) + that bit."""
    other = np.empty_like(colour)
    other[1:] = colour[:-1]
    other[first] = ~colour[first]
    low = colour ^ other
    low &= ~low + colour.dtype.type(1)
    bit = (colour & low) != 0
    return (np.bitwise_count(low - colour.dtype.type(1)) << np.uint8(1)) + bit.astype(np.uint8)


def _level(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level's phrase names and owners."""
    fresh = np.ones(len(names), bool)
    fresh[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    if len(at) < len(names):  # runs of one symbol
        size = np.diff(np.append(at, len(names)))
        names, owner = names[at], owner[at]
        long = size > 1
        names[long] = mix(names[long] * U64(0x9FB21C651E98DF25) + size[long].astype(U64))
    first = np.ones(len(names), bool)
    first[1:] = owner[1:] != owner[:-1]
    begins = np.flatnonzero(first)
    colour = _toss(names, begins)
    for _ in range(3):
        colour = _toss(colour, begins)
    left = np.ones(len(names), bool)
    left[1:] = colour[1:] > colour[:-1]
    right = np.ones(len(names), bool)
    right[:-1] = colour[:-1] >= colour[1:]
    right[np.append(begins[1:], len(names)) - 1] = False  # a text's last symbol starts no phrase unless it is the only one
    cut = np.flatnonzero((left & right) | first)
    ends = np.append(cut[1:], len(names))
    alone = ends - cut == 1
    named = span_hash(names, cut, ends)
    named[alone] = names[cut[alone]]
    return named, owner[cut]


def fingerprints(texts: list[str]) -> np.ndarray:
    """(len(texts), SLOTS) 16-bit minimum hashes."""
    cps, bounds = code_points(texts)
    docs = len(texts)
    least = np.full(docs * SLOTS, np.iinfo(np.uint64).max, U64)
    owner = np.repeat(np.arange(docs, dtype=np.int32), np.diff(bounds))
    names, level, before = mix(cps.astype(U64) + U64(0xA11CE)), 0, -1
    while len(names) and (level <= FLOOR or len(names) != before):
        before = len(names)
        names, owner = _level(names, owner)
        level += 1
        if level >= FLOOR:
            h = mix(names ^ U64(0x5EED))
            slot = owner * np.int64(SLOTS) + (h >> U64(58)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            ranked = slot[order]
            starts = np.flatnonzero(np.diff(ranked, prepend=-1))
            low = np.minimum.reduceat(h[order] & U64((1 << 58) - 1), starts)
            least[ranked[starts]] = np.minimum(least[ranked[starts]], low)
    out = (mix(least) % U64(EMPTY)).astype(np.uint16)
    out[least == np.iinfo(np.uint64).max] = EMPTY
    return out.reshape(docs, SLOTS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of common phrases: equal slots over slots that either fills; texts without phrases are alike."""
    filled = ((a != EMPTY) | (b != EMPTY)).sum(axis=-1)
    same = ((a == b) & (a != EMPTY)).sum(axis=-1)
    return np.where(filled == 0, 1.0, same / np.maximum(filled, 1))


def written(prints: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in prints]


def fingerprint_documents(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Fingerprints of each row of ``docs`` (doc_id, text), of its edited text, and likenesses.

    The edited text has the last floor(n_chars / 2) code points replaced by
    the first as many of the next row's, in order of doc_id (nulls first, ties
    by a hash of the text; the last row's next is the first).  Null texts
    count as empty; two empty texts have likeness 1, an empty and another one
    0 unless the other is empty too; repeated rows are each other's next; a
    single row is its own; very long texts are parsed whole; an empty table
    gives none; other columns are not read.

    Rows are dealt to ranges in that order, in which repeated rows are told
    apart by a random number: no doc_id or text is too frequent for a range.
    A range's last row meets its next, the first of the range after it, by a
    join of these rows only; so each text is shuffled once.
    """
    if docs.sparkSession.conf.get("spark.sql.exchange.reuse", "true").lower() != "true":
        raise ValueError("spark.sql.exchange.reuse must be true: all parts of this plan read one shuffle, whose ranges are drawn once")
    own = text_or_empty(with_package(docs), "doc_id")
    size = own.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = max(own.sparkSession.sparkContext.defaultParallelism, min(MOST_PARTS, -(-int(size) // part_bytes)))
    order = (F.asc_nulls_first("doc_id"), F.asc("tie"), F.asc("turn"))
    dealt = own.select("doc_id", F.xxhash64("text").alias("tie"), F.rand(17).alias("turn"), "text").repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    ends = dealt.mapInArrow(_ends, "part int, last boolean, doc_id long, text string")
    heads = ends.where("NOT last").select("part", F.col("text").alias("next"))
    # one number a range, and that of the next one with rows
    number = ends.where("last").select("part")
    after = number.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(Window.orderBy("part"))).alias("head"))
    tails = ends.where("last").select("part", "doc_id", "text").join(after, "part").join(heads.withColumnRenamed("part", "head"), "head")
    return dealt.mapInArrow(_run, SCHEMA).unionByName(tails.select("doc_id", "text", "next").mapInArrow(_pairs, SCHEMA))


_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def _measured(ids: list[int | None], texts: list[str], following: list[str], prints: np.ndarray, next_prints: np.ndarray) -> pa.RecordBatch:
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
    changed = fingerprints(edited)
    sha = [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    out = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sha, pa.string()), pa.array(written(prints), pa.string()), pa.array(written(changed), pa.string())]
    return pa.RecordBatch.from_arrays([*out, pa.array(likeness(prints, changed), pa.float64()), pa.array(likeness(prints, next_prints), pa.float64())], names=_NAMES)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a range but the last, each finished when the one after it is seen."""
    ids: list[int | None] = []
    texts: list[str] = []
    chars = 0

    def finish() -> pa.RecordBatch:
        """All held rows but the last, which stays as the next block's first."""
        prints = fingerprints(texts)
        out = _measured(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:])
        del ids[:-1], texts[:-1]
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc_id)
            texts.append(text.as_py())
            chars += len(texts[-1])
            if chars >= BLOCK_CHARS and len(ids) > 1:
                chars = len(texts[-1])
                yield finish()
    if len(ids) > 1:
        yield finish()
    released()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last row of a range, with its number."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = first or [c[0].as_py() for c in batch.columns]
            last = batch.slice(batch.num_rows - 1)
    if first:
        ids, texts = [first[0], last.column(0)[0].as_py()], [first[1], last.column(1)[0].as_py()]
        yield pa.RecordBatch.from_arrays([pa.array([first[2]] * 2, pa.int32()), pa.array([False, True]), pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["part", "last", "doc_id", "text"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come with their next."""
    for batch in batches:
        for k in range(batch.num_rows):
            text, following = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
            prints = fingerprints([text, following])
            yield _measured([batch.column(0)[k].as_py()], [text], [following], prints[:1], prints[1:])
    released()
