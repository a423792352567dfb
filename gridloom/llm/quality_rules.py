"""Quality rules by repetition coverage.

Word and n-gram hashes are rolled over whole blocks of texts in numpy, for
several n-gram lengths at once; a position is covered if it lies in an n-gram
that its text holds twice or more.  Rules on the share of word characters so
covered, and on characters in repeated lines, give the verdict.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import U64, mix, number_spans
from .common import map_rows, text_or_empty

#: n-gram length to the largest share, in percent, of word characters inside n-grams found twice or more.
NGRAM_PERCENT = {5: 30, 6: 28, 7: 26, 8: 24, 9: 22, 10: 20}
#: Largest share, in percent, of word characters in lines that equal an earlier line.
LINE_PERCENT = 30
#: Largest number of symbols for each 100 words.
SYMBOL_PERCENT = 40
WINDOW = 8
SYMBOLS = b"[#*$%&|<>]"[1:-1]

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "dup_line_chars long, " + ", ".join(f"dup_{n}gram_chars long" for n in NGRAM_PERCENT)
)

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _repeated(at: np.ndarray, keys: np.ndarray, word: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """True for each n-gram, by its place ``at`` and hash, that its text holds twice or more; equal hashes are compared word by word."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    pair = np.flatnonzero(same)
    a, b = at[order[pair]], at[order[pair + 1]]
    equal = owner[a] == owner[b]
    for k in range(n):
        equal &= word[a + k] == word[b + k]
    out = np.zeros(len(at), bool)
    if not equal.all():  # two grams share a hash: compare them all
        _, key = np.unique(np.stack([owner[at], *(word[at + k] for k in range(n))], axis=1), axis=0, return_inverse=True)
        out[:] = np.bincount(key.ravel())[key.ravel()] > 1
        return out
    out[order[pair]] = True
    out[order[pair + 1]] = True
    return out


def _covered(hits: np.ndarray, n: int, words: int) -> np.ndarray:
    """True for each word in a window of n that starts at a hit."""
    depth = np.zeros(words + 1, np.int64)
    np.add.at(depth, hits, 1)
    np.subtract.at(depth, np.minimum(hits + n, words), 1)
    return np.cumsum(depth[:words]) > 0


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The counts of each text, over all texts of a block at once."""
    parts = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)  # a line end after each text
    docs = len(texts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    white = _WHITE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white])))
    starts, stops = edge[::2], edge[1::2]  # each word's bytes
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    size = points[stops] - points[starts]
    owner = np.searchsorted(begins, starts, "right") - 1
    count = lambda where, weights=None: np.bincount(where, weights, docs).astype(np.int64)
    out = {"n_words": count(owner), "word_chars": count(owner, size)}
    symbol = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    out["n_symbols"] = symbol[ends] - symbol[begins]

    # lines: those with a word that equal an earlier one of their text
    line_end = np.flatnonzero(data == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    words_before = np.searchsorted(starts, line_start)
    words_after = np.searchsorted(starts, line_end)
    real = words_after > words_before
    line_start, line_end, words_before, words_after = line_start[real], line_end[real], words_before[real], words_after[real]
    line_owner = np.searchsorted(begins, line_start, "right") - 1
    salt = mix(np.arange(docs, dtype=U64) + U64(0x51ED))
    key = number_spans(data, line_start, line_end)[0] * np.int64(docs) + line_owner
    later = np.ones(len(key), bool)
    later[np.unique(key, return_index=True)[1]] = False
    out["n_dup_lines"] = count(line_owner[later])
    total = np.concatenate([[0], np.cumsum(size)])
    out["dup_line_chars"] = count(line_owner[later], (total[words_after] - total[words_before])[later])

    # n-grams: H(n + 1, i) = H(n, i) * base + hash(word[i + n]), kept inside each text
    word = number_spans(data, starts, stops)[0]
    n_all = len(word)
    left = np.zeros(docs + 1, np.int64)
    np.cumsum(out["n_words"], out=left[1:])
    room = left[owner + 1] - np.arange(n_all)  # words from here to the text's end
    hashed, base = mix(word.astype(U64) + U64(1)), U64(0xD6E8FEB86659FD93)
    rolled = hashed.copy()
    for n in range(2, max(NGRAM_PERCENT) + 1):
        if n_all >= n:
            rolled[: n_all - n + 1] = rolled[: n_all - n + 1] * base + hashed[n - 1 :]
        if n in NGRAM_PERCENT or n == WINDOW:
            at = np.flatnonzero(room >= n)
            at = at[_repeated(at, mix(rolled[at]) ^ salt[owner[at]], word, owner, n)]
            inside = _covered(at, n, n_all)
            out[f"dup_{n}gram_chars"] = count(owner[inside], size[inside])
            if n == WINDOW:
                out["n_repeat_words"] = count(owner[inside])
    words, chars = out["n_words"], out["word_chars"]
    out["base_failed"] = (words < 20) | (100 * out["n_repeat_words"] > 30 * words)
    fine = (100 * out["dup_line_chars"] <= LINE_PERCENT * chars) & (100 * out["n_symbols"] <= SYMBOL_PERCENT * words)
    for n, most in NGRAM_PERCENT.items():
        fine &= 100 * out[f"dup_{n}gram_chars"] <= most * chars
    out["kept"] = fine & ~out["base_failed"]
    return out


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts and verdict for each row of ``docs`` (doc_id, text), in one narrow pass.

    Null and empty texts have no words, so base_failed is true and kept false;
    a null doc_id is kept; repeated rows are measured each; very long texts are
    measured whole, a block of their own; an empty table gives none; other
    columns are not read.
    """

    def make():
        return lambda ids, texts: {"doc_id": pa.array(ids, pa.int64()), **measure(texts)}

    return map_rows(text_or_empty(docs, "doc_id"), make, SCHEMA)


def _oracle() -> str:
    sizes = sorted({*NGRAM_PERCENT, WINDOW})
    # a gram's number in its text, from the number of the gram one shorter and the word after that
    chain = "".join(
        f"k{n} AS (SELECT * EXCLUDE (nxt), dense_rank() OVER (PARTITION BY doc_id ORDER BY g{n - 1}, nxt) AS g{n} FROM (SELECT *, lead(g1, {n - 1}) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM k{n - 1})),\n"
        for n in range(2, max(sizes) + 1)
    )
    twice = ", ".join(f"i + {n - 1} <= n AND count(*) OVER (PARTITION BY doc_id, g{n}, i + {n - 1} <= n) > 1 AS d{n}" for n in sizes)
    inside = ", ".join(f"max(CAST(d{n} AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in sizes)
    sums = ", ".join(f"sum(CASE WHEN c{n} = 1 THEN length(w) ELSE 0 END) AS dup_{n}gram_chars" for n in NGRAM_PERCENT)
    rules = " AND ".join(f"100 * dup_{n}gram_chars <= {p} * word_chars" for n, p in NGRAM_PERCENT.items())
    grams_out = ", ".join(f"CAST(dup_{n}gram_chars AS BIGINT) AS dup_{n}gram_chars" for n in NGRAM_PERCENT)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
w AS (SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM s),
k1 AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY w) AS g1 FROM w),
{chain}t AS (SELECT doc_id, i, w, {twice} FROM k{max(sizes)}),
c AS (SELECT doc_id, w, {inside} FROM t),
r AS (SELECT doc_id, sum(length(w)) AS word_chars, sum(c{WINDOW}) AS n_repeat_words, {sums} FROM c GROUP BY doc_id),
l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d),
m AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS k FROM l),
o AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS later FROM m WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
q AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS dup_line_chars FROM o WHERE later GROUP BY doc_id),
a AS (SELECT s.doc_id, len(ws) AS n_words, coalesce(word_chars, 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars,
  {", ".join(f"coalesce(dup_{n}gram_chars, 0) AS dup_{n}gram_chars" for n in NGRAM_PERCENT)}
  FROM s LEFT JOIN r USING (doc_id) LEFT JOIN q USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * dup_line_chars <= {LINE_PERCENT} * word_chars AND 100 * n_symbols <= {SYMBOL_PERCENT} * n_words AND {rules} AS kept,
  CAST(dup_line_chars AS BIGINT) AS dup_line_chars, {grams_out}
FROM b"""


ORACLE = _oracle()
