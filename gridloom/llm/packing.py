"""Sum-of-squares online packing of token sequences into windows.

Documents stream through each task.  A document's ids (closed by a separator)
first fill whole windows; the rest is placed by the sum-of-squares rule: into
the fill level for which the sum over levels of (number of windows at that
level) squared becomes least, opening a new window when that is least.  The
levels are one array, so a placement is one vector expression.

When a task ends, or ``most_open`` windows are open (sizes that never fit
together), the emptiest open windows are taken apart and their pieces placed
again by the same rule, but into open windows only; a piece that fits none is
cut to fill the fullest one.  So at most one window a task keeps padding, a
task holds at most ``most_open`` windows of ids, and windows keep what the
rule put into them, but for the few that are taken apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, text_or_empty, with_package

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
Piece = tuple[int | None, int, int, np.ndarray]  # doc_id, start, doc_tokens, ids


class SumOfSquares:
    """Windows of ``size`` ids, filled online; ``full`` are finished windows (lists of pieces)."""

    def __init__(self, size: int = 1024, most_open: int = 8192) -> None:
        self.size, self.most_open = size, most_open
        self.levels = np.zeros(size + 1, np.int64)  # windows at each fill level; the full ones do not count
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0
        self.full: list[list[Piece]] = []
        self.moved = 0  # ids placed again

    def level_for(self, n: int, new: bool = True) -> int:
        """The level that a piece of n < size ids goes to; 0 is a new window, or none if that is not allowed.  Ties: the fullest."""
        fits = self.levels[1 : self.size - n + 1]
        change = 2 * (self.levels[1 + n : self.size + 1] - fits) + 2
        change[-1] -= 1  # a window that gets full leaves the sum
        change = np.where(fits > 0, change, np.iinfo(np.int64).max)
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return best + 1 if fits[best] and (not new or change[best] <= 2 * self.levels[n] + 1) else 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, cut = len(ids), len(ids) - len(ids) % self.size
        for start in range(0, cut, self.size):
            self.full.append([(doc_id, start, total, ids[start : start + self.size])])
        if cut < total:
            self._place((doc_id, cut, total, ids[cut:].copy()))

    def _place(self, piece: Piece) -> None:
        self._put(piece, self.level_for(len(piece[3])))
        if self.n_open > self.most_open:
            self._settle(self.most_open // 2)

    def _put(self, piece: Piece, level: int) -> None:
        """Into a window of ``level``, or a new one for 0."""
        window = self._take(level) if level else []
        window.append(piece)
        if level + len(piece[3]) == self.size:
            self.full.append(window)
            return
        level += len(piece[3])
        self.open.setdefault(level, []).append(window)
        self.levels[level] += 1
        self.n_open += 1

    def _take(self, level: int) -> list[Piece]:
        self.levels[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _settle(self, most: int) -> None:
        """Take the emptiest windows apart until at most ``most`` are open."""
        while self.n_open > most:
            for doc_id, start, total, ids in self._take(int(np.argmax(self.levels > 0))):
                self.moved += len(ids)
                while len(ids):
                    level = self.level_for(len(ids), new=False)
                    if not level and self.n_open:  # it fits none: cut it to fill the fullest
                        level = int(np.flatnonzero(self.levels)[-1])
                        if self.size - level > len(ids):
                            level = 0
                    room = self.size - level if level else self.size
                    self._put((doc_id, start, total, ids[:room]), level)
                    start, ids = start + min(room, len(ids)), ids[room:]

    def finish(self) -> None:
        """Settle what is open; at most one window then is not full."""
        self._settle(1)
        self.full += [w for ws in self.open.values() for w in ws]
        self.open, self.n_open = {}, 0
        self.levels[:] = 0


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, separator: int = 0) -> DataFrame:
    """Pieces of all documents in windows (``sequence_id``) of at most ``size`` ids; ``ids`` are little-endian unsigned 32-bit.

    Every id of a document, and the separator after it, lies in exactly one
    piece; offsets in a window are gapless from 0.  Null and empty texts are
    the separator alone; repeated rows and null doc_ids are packed as they
    come; very long texts are cut into as many pieces as they need; an empty
    table gives none; other columns are not read.  A sequence_id holds the
    task's partition, so a task that runs again gives the same rows as long
    as its input partition is the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .arrays import BLOCK_CHARS
        from .byte_bpe import byte_bpe

        bpe, packer = byte_bpe(tokenizer), SumOfSquares(size)
        sequence = TaskContext.get().partitionId() << 36

        def rows() -> pa.RecordBatch:
            nonlocal sequence
            cols: list[list] = [[] for _ in range(7)]
            for window in packer.full:
                offset = 0
                for doc_id, start, total, ids in window:
                    for c, v in zip(cols, (doc_id, start, len(ids), total, sequence, offset, ids.astype("<u4").tobytes()), strict=True):
                        c.append(v)
                    offset += len(ids)
                sequence += 1
            packer.full = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 6 else pa.int64()) for k, c in enumerate(cols)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        def block(ids: list, texts: list[str]) -> pa.RecordBatch:
            flat, n = bpe.encode(texts)
            at = 0
            for doc_id, k in zip(ids, n.tolist(), strict=True):
                packer.add(doc_id, np.append(flat[at : at + k], np.int32(separator)))
                at += k
            return rows()

        for batch in batches:
            held_ids, held, chars = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held_ids.append(doc_id)
                held.append(text.as_py())
                chars += len(held[-1])
                if chars >= BLOCK_CHARS:
                    yield block(held_ids, held)
                    held_ids, held, chars = [], [], 0
            if held:
                yield block(held_ids, held)
        packer.finish()
        yield rows()
        released()

    return text_or_empty(with_package(docs), "doc_id").mapInArrow(run, SCHEMA)


def digests(packed: DataFrame) -> DataFrame:
    """``pack``'s rows with the CRC32 of each piece's ids in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
