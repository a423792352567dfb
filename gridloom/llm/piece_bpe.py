"""SentencePiece BPE encoding and decoding over numpy blocks.

Follows the sentencepiece model format: the text is normalised (a space mark
before it, a space mark for each space), cut before each run of space marks,
and each distinct segment is merged once in vectorised rounds: the segmented
minimum of the pair ranks, the leftmost such pair of every word at once,
compaction, until no pair remains.  Characters outside the vocabulary become
byte pieces.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .arrays import PairTable, WordStore, code_points, merge_rounds, offsets, ragged, utf8_length

MARK = "▁"


class PieceBPE:
    def __init__(self, path: str, most_words: int = 500_000) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, trained = model.normalizer_spec, model.trainer_spec
        kinds = np.array([p.type for p in model.pieces])
        if trained.model_type != 2 or not trained.byte_fallback or len(norm.precompiled_charsmap) or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or trained.treat_whitespace_as_suffix or len(model.denormalizer_spec.precompiled_charsmap) or not set(kinds.tolist()) <= {1, 2, 3, 6}:
            raise ValueError(f"{path}: a BPE model with byte fallback, identity normalisation and a space before the text is needed")
        names = [p.piece for p in model.pieces]
        normal = {n: i for i, n in enumerate(names) if kinds[i] == 1}
        if any(MARK in n.lstrip(MARK) or (n.startswith(MARK * 2) and n.strip(MARK)) for n in normal):
            raise ValueError(f"{path}: a piece spans words")
        self.bos, self.eos, self.unk = names.index("<s>"), names.index("</s>"), int(np.flatnonzero(kinds == 2)[0])
        self.byte_ids = np.zeros(256, np.int64)
        for i in np.flatnonzero(kinds == 6):
            self.byte_ids[int(names[i][1:-1], 16)] = i
        _, rank = np.unique([-model.pieces[i].score for i in range(len(names))], return_inverse=True)
        splits = [(normal[n[:k]], normal[n[k:]], rank[i], i) for n, i in normal.items() for k in range(1, len(n)) if n[:k] in normal and n[k:] in normal]
        self.pairs = PairTable(*(np.array(c, np.int64) for c in zip(*splits, strict=True)))
        self.single = np.full(0x110000, -1, np.int32)
        for n, i in normal.items():
            if len(n) == 1:
                self.single[ord(n)] = i
        surface = [n.replace(MARK, " ").encode() if kinds[i] == 1 else bytes([int(n[1:-1], 16)]) if kinds[i] == 6 else " ⁇ ".encode() if kinds[i] == 2 else b"" for i, n in enumerate(names)]
        self.kinds, self.surface_length = kinds, np.array([len(s) for s in surface], np.int64)
        self.surface, self.surface_start = np.frombuffer(b"".join(surface), np.uint8), offsets(self.surface_length)
        self.store = WordStore(most_words)

    def _merge_new(self, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = ends - starts
        flat = cps[ragged(starts, lengths)].astype(np.int64)
        sym = self.single[flat].astype(np.int64)
        sym = np.where(sym < 0, -flat - 1, sym)  # unknown: never merges
        sym, count = merge_rounds(sym, lengths, self.pairs, every=False)
        if (sym >= 0).all():
            return sym, count
        lost = np.where(sym < 0, -sym - 1, 0)
        size = np.where(sym < 0, utf8_length(lost), 1)
        out = np.repeat(sym, size)
        data = np.frombuffer(lost[sym < 0].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        out[np.repeat(sym < 0, size)] = self.byte_ids[data]
        return out, np.diff(offsets(size)[offsets(count)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with its begin and end id, and their number in each text."""
        cps, bounds = code_points([MARK + t if t else t for t in texts])
        cps = np.where(cps == 0x20, ord(MARK), cps).astype(np.uint32)
        mark = cps == ord(MARK)
        start = np.zeros(len(cps) + 1, bool)
        start[1:-1] = mark[1:] & ~mark[:-1]
        start[bounds] = True
        starts = np.flatnonzero(start[: len(cps)])
        ends = np.append(starts[1:], len(cps))
        count = np.diff(np.searchsorted(starts, bounds))
        slot = self.store.rows(cps, starts, ends, lambda first: self._merge_new(cps, starts[first], ends[first]))
        size = np.diff(self.store.start)[slot] if len(slot) else np.zeros(0, np.int64)
        lengths = np.diff(offsets(size)[offsets(count)])
        at = offsets(lengths + 2)
        ids = np.empty(at[-1], np.int32)
        ids[at[:-1]], ids[at[1:] - 1] = self.bos, self.eos
        if len(slot):
            ids[ragged(at[:-1] + 1, lengths)] = self.store.ids[ragged(self.store.start[slot], size)]
        return ids, lengths + 2

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """UTF-8 text of each row of ids: pieces end to end without the space that encoding put first; bytes that form no character give U+FFFD each."""
        size = self.surface_length[ids]
        data = self.surface[ragged(self.surface_start[ids], size)]
        at = offsets(size)[offsets(lengths)]
        first = offsets(lengths)[:-1]
        out = []
        for i in range(len(lengths)):
            row = ids[first[i] : first[i] + lengths[i]]
            said = row[self.kinds[row] != 3]
            text = data[at[i] : at[i + 1]].tobytes()
            if len(said) and self.kinds[said[0]] == 1 and text[:1] == b" ":
                text = text[1:]
            inner = self.kinds[row[1:-1]] == 3
            try:
                text.decode()
            except UnicodeDecodeError:
                inner = True
            out.append(self._decode_runs(row, text[:0]) if np.any(inner) else text)
        return out

    def _decode_runs(self, row: np.ndarray, done: bytes) -> bytes:
        """The same for ids that no text has: byte pieces are read run by run, and other ids end a run."""
        first, run = True, b""
        for i in [*row.tolist(), -1]:
            if i >= 0 and self.kinds[i] == 6:
                run += self.surface[self.surface_start[i] : self.surface_start[i] + 1].tobytes()
                first = False
                continue
            done, run = done + _each_bad_byte(run), b""
            if i >= 0 and self.kinds[i] != 3:
                piece = self.surface[self.surface_start[i] : self.surface_start[i + 1]].tobytes()
                done += piece[1:] if first and piece[:1] == b" " and self.kinds[i] == 1 else piece
                first = False
        return done


def _each_bad_byte(data: bytes) -> bytes:
    out, i = [], 0
    while i < len(data):
        for k in (1, 2, 3, 4):
            try:
                out.append(data[i : i + k].decode())
                i += k
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out).encode()


@lru_cache(2)
def piece_bpe(path: str) -> PieceBPE:
    """One model a worker and file."""
    return PieceBPE(path)
