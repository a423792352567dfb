"""Byte-level BPE over numpy blocks, from a tokenizers JSON file.

Texts are cut into pre-tokens by class boundaries of their code points (the
pattern of byte-level pre-tokenisers), each distinct pre-token is merged once
by ``arrays.merge_rounds`` and remembered, and a text's ids are gathered from
there.  Texts that hold an added special token or a code point that this
Python's Unicode tables do not assign go to the tokenizers library itself, so
results are always the library's.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import cached_property, lru_cache

import numpy as np

from .arrays import PairTable, WordStore, code_points, merge_rounds, offsets, ragged, utf8_length

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
#: White space as the pattern's \s has it.
_WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        cat = unicodedata.category(chr(c))
        out[c] = UNKNOWN if cat == "Cn" else kind.get(cat[0], OTHER)
    out[_WHITE] = SPACE
    return out


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


def pretoken_starts(cps: np.ndarray, bounds: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, for texts given by code points, bounds and classes."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    begins = np.zeros(n + 1, bool)
    begins[bounds] = True  # the end counts as one too
    white = kinds == SPACE
    blank = cps == 0x20
    before_white = np.zeros(n, bool)
    before_white[1:] = white[:-1]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    changes = np.ones(n, bool)
    changes[1:] = kinds[1:] != kinds[:-1]
    follows_word = np.zeros(n, bool)  # the next character of the same text is no white space
    follows_word[:-1] = ~white[1:]
    follows_word &= ~begins[1:]
    start = np.where(white, ~before_white | follows_word, changes & ~after_blank)
    start |= begins[:n]
    # contractions: a quote that begins a pre-token takes s, t, m, d, re, ve or ll with it
    quote = np.flatnonzero((cps == 0x27) & start)
    if len(quote):
        padded = np.concatenate([cps, [0, 0]])
        one, two = padded[quote + 1], padded[quote + 2]
        end = bounds[np.searchsorted(bounds, quote, "right")]
        short = np.isin(one, [ord(c) for c in "stmd"]) & (quote + 1 < end)
        long = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        long &= quote + 2 < end
        took = np.where(short, 2, np.where(long, 3, 0))
        for k in (1, 2):
            start[quote[took > k] + k] = False
        stops = (quote + took)[(took > 0) & (quote + took < end)]
        letters = stops[kinds[stops] == LETTER]
        start[letters] = True
    return np.flatnonzero(start)


class ByteBPE:
    """encode(texts) gives (ids of all texts end to end, tokens in each text)."""

    def __init__(self, path: str, most_words: int = 500_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError(f"{path}: a byte-level BPE without normalizer and prefix space is needed")
        self.path = path
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, merged = (np.array([vocab[x] for x in side], np.int64) for side in ([m[0] for m in merges], [m[1] for m in merges], ["".join(m) for m in merges]))
        self.pairs = PairTable(left, right, np.arange(len(merges)), merged)
        self.byte_ids = np.array([vocab[s] for s in byte_symbols()], np.int64)
        self.store = WordStore(most_words)

    @cached_property
    def library(self):
        """The tokenizers library's own tokenizer, loaded when a text needs it."""
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def _merge_new(self, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = ends - starts
        flat = cps[ragged(starts, lengths)]
        data = np.frombuffer(flat.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        size = np.add.reduceat(utf8_length(flat), np.cumsum(lengths) - lengths) if len(flat) else lengths
        return merge_rounds(self.byte_ids[data], size, self.pairs, every=True)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot in the store of each pre-token, pre-tokens in each text, texts that need the library)."""
        cps, bounds = code_points(texts)
        kinds = classes()[cps]
        odd = np.zeros(len(texts), bool)
        if (kinds == UNKNOWN).any():
            odd[np.searchsorted(bounds, np.flatnonzero(kinds == UNKNOWN), "right") - 1] = True
        for s in self.special:
            odd |= np.array([s in t for t in texts], bool)
        starts = pretoken_starts(cps, bounds, kinds)
        ends = np.append(starts[1:], len(cps))
        count = np.diff(np.searchsorted(starts, bounds))
        return self.store.rows(cps, starts, ends, lambda first: self._merge_new(cps, starts[first], ends[first])), count, odd

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens in each text."""
        slot, count, odd = self.words(texts)
        size = np.diff(self.store.start)[slot] if len(slot) else np.zeros(0, np.int64)
        at = offsets(size)[offsets(count)]
        out = np.diff(at)
        for i in np.flatnonzero(odd):
            out[i] = len(self.library.encode(texts[i], add_special_tokens=False).ids)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        slot, count, odd = self.words(texts)
        size = np.diff(self.store.start)[slot] if len(slot) else np.zeros(0, np.int64)
        ids = self.store.ids[ragged(self.store.start[slot], size)] if len(slot) else np.zeros(0, np.int32)
        lengths = np.diff(offsets(size)[offsets(count)])
        if odd.any():
            start, parts = offsets(lengths), []
            for i in range(len(texts)):
                parts.append(np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.int32) if odd[i] else ids[start[i] : start[i + 1]])
            ids, lengths = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, lengths


@lru_cache(2)
def byte_bpe(path: str) -> ByteBPE:
    """One tokenizer a worker and file."""
    return ByteBPE(path)
