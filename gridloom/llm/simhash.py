"""SimHash near-duplicates by pigeonhole blocks.

Two fingerprints that differ in at most ``most`` bits agree on at least
``blocks - most`` of ``blocks`` bit blocks.  So each distinct fingerprint goes
under one key for each choice of that many blocks, fingerprints are joined on
those keys, and the join is verified by Hamming distance.  Inside a key only a
spanning forest of the close pairs is emitted, never all pairs.  A key with
more than ``bucket`` fingerprints is split by the same rule again: they agree
on the bits of the key, so the bits that it leaves free are cut into blocks.
Keys end at FREE free bits, which as many fingerprints as a bucket holds can
fill; so no task holds more than a bucket, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mix
from .common import checkpointed, map_rows, split_join, text_or_empty, with_package
from .components import components

#: Seed of the shingle hash.
SEED = 42
#: Fingerprints in a key that are compared at once, and the free bits whose values they are.
FREE = 12
BUCKET = 1 << FREE


def text_fingerprint(text: str, width: int = 4) -> int:
    """SimHash of a text: bit i is set if it is in over half of the XXH64 hashes of its ``width``-word shingles.

    Words are maximal runs without ASCII white space after lowering A-Z; fewer
    words than ``width`` form one shingle; no words give 0.
    """
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(0, min(width, len(words)) - 1)
    spans = map(slice, starts[: len(words) - k].tolist(), ends[k:].tolist())
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, spans), repeat(SEED)), np.uint64, len(words) - k)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, bits long) for each row; null texts count as empty, fingerprint 0."""

    def make():
        def work(ids, texts):
            return {"doc_id": pa.array(ids, pa.int64()), "bits": np.array([text_fingerprint(t, width) for t in texts], np.uint64).view(np.int64)}

        return work

    return map_rows(text_or_empty(docs, "doc_id"), make, "doc_id long, bits long")


def block_masks(blocks: int, most: int, mask: int = 0) -> list[int]:
    """64-bit masks, one for each choice of blocks - most blocks of the bits that ``mask`` leaves free, with ``mask``; all 64 bits if there are no more bits than blocks."""
    free = [b for b in range(64) if not mask >> b & 1]
    if len(free) <= blocks:
        return [(1 << 64) - 1]
    edges = [round(len(free) * i / blocks) for i in range(blocks + 1)]
    each = [sum(1 << b for b in free[a:z]) for a, z in zip(edges, edges[1:], strict=False)]
    return [mask | sum(c) for c in combinations(each, blocks - most)]


def blocks_for(n: int, most: int) -> int:
    """Blocks for n distinct fingerprints: the fewest whose keys keep unrelated fingerprints to a few in a key."""
    blocks = most + 2
    while blocks < 2 * most + 4 and n > 4 * 2 ** (64 * (blocks - most) // blocks):
        blocks += 1
    return blocks


def forest(bits: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of distinct ``bits`` (uint64) at distance ``most`` or less, found breadth first."""
    left, right, rest = [], [], bits
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= most
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), x))
                right.append(found)
                queue.extend(found)
                rest = rest[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def runs_of(rows: Iterator[pa.RecordBatch], key: int) -> Iterator[np.ndarray]:
    """Rows sorted by their first ``key`` columns, all long, as arrays that end where a key does."""
    held: list[np.ndarray] = []
    for batch in rows:
        now = np.stack([c.to_numpy() for c in batch.columns], axis=1)
        if not len(now):
            continue
        if held and (held[-1][-1, :key] != now[0, :key]).any():
            yield np.concatenate(held)
            held = []
        same = (now[:, :key] == now[-1, :key]).all(axis=1)
        cut = 0 if same.all() else len(now) - int(np.argmin(same[::-1]))
        if cut:
            yield np.concatenate([*held, now[:cut]])
            held = []
        held.append(now[cut:])
    if held:
        yield np.concatenate(held)


def _keyed(rows: DataFrame, blocks: int, most: int) -> DataFrame:
    """(bits, mask, key) for each mask that splits ``rows`` (bits, mask) further; key: a hash of mask and the bits it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            bits, masks = (c.to_numpy().view(np.uint64) for c in batch.columns)
            for m in np.unique(masks).tolist():
                if m not in known:
                    known[m] = np.array(block_masks(blocks, most, m), np.uint64)
                own, new = bits[masks == m], known[m]
                step = max(1, (1 << 18) // len(new))
                for at in range(0, len(own), step):
                    some = np.repeat(own[at : at + step], len(new))
                    to = np.tile(new, len(some) // len(new))
                    key = mix(mix(to) + (some & to))
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (some, to, key)], names=["bits", "mask", "key"])

    return with_package(rows).select("bits", "mask").mapInArrow(run, "bits long, mask long, key long")


def _forests(keyed: DataFrame, most: int) -> DataFrame:
    """(a, b) edges of a spanning forest of the close pairs of each key of ``keyed`` (bits, key)."""

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(rows) + 1, bool)
        new[1:-1] = rows[1:, 0] != rows[:-1, 0]
        at = np.flatnonzero(new)
        size, bits = np.diff(at), rows[:, 1].copy().view(np.uint64)
        two = at[:-1][size == 2]
        near = two[np.bitwise_count(bits[two] ^ bits[two + 1]) <= most]
        left, right = [bits[near]], [bits[near + 1]]
        for s, n in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            a, b = forest(bits[s : s + n], most)
            left.append(a)
            right.append(b)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.uint64).view(np.int64)) for x in (left, right)], names=["a", "b"])

    return keyed.select("key", "bits").repartition("key").sortWithinPartitions("key", "bits").mapInArrow(lambda batches: map(edges, runs_of(batches, 1)), "a long, b long")


def links(distinct: DataFrame, most: int = 4, blocks: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """(a, b) edges whose components are those of all pairs of ``distinct`` (bits) within ``most`` bits."""
    blocks, found = blocks or blocks_for(distinct.count(), most), None
    rows = distinct.select("bits", F.lit(0).cast("long").alias("mask"))
    while True:
        keyed = _keyed(rows, blocks, most)
        # keys are counted, with the counts combined before the shuffle, and joined so that a key of many rows can be split
        counts = checkpointed(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
        shared = split_join(keyed, counts, "key")
        last = F.bit_count("mask") >= 64 - FREE
        edges = _forests(shared.where((F.col("n") <= bucket) | last), most)
        found = edges if found is None else found.unionByName(edges)
        if counts.where(F.col("n") > bucket).isEmpty():
            return found
        rows = checkpointed(shared.where((F.col("n") > bucket) & ~last).select("bits", "mask"))
        blocks = most + 2


def near_duplicates(docs: DataFrame, width: int = 4, most: int = 4, blocks: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text).

    fingerprint is 16 lowercase hex digits; component_id the smallest doc_id
    reachable over fingerprints that differ in at most ``most`` bits.  Null
    and empty texts have fingerprint zero and link like any other; a null
    doc_id is kept and takes part, but is no component_id unless all of its
    component's are null; repeated rows are kept; very long texts count by all
    of their shingles; an empty table gives none; other columns are not read.
    """
    all_bits = checkpointed(fingerprints(docs, width))
    distinct = checkpointed(all_bits.groupBy("bits").agg(F.min("doc_id").alias("first_id")))
    labels = components(links(distinct.select("bits"), most, blocks))
    linked = distinct.join(labels.withColumnRenamed("node", "bits"), "bits")
    least = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of = distinct.join(split_join(linked, least, "label").select("bits", "component_id"), "bits", "left").select("bits", F.coalesce("component_id", "first_id").alias("component_id"))
    return split_join(all_bits, of, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
