"""Collocations: frequent word phrases that score high for how often their parts occur.

Phrases are mined by pivot partitioning, as in MG-FSM.  Words are ordered by
frequency, and a phrase is owned by its rarest word, its pivot.  For every word
of a text the neighbours that a phrase with this pivot can hold (no rarer word
between, no punctuation, no infrequent word) make up one rewritten fragment;
equal fragments are combined and routed to the pivot, where its phrases are
counted without a look at any other partition.  The fragments of a pivot of
very many rows are dealt to several partitions, whose counts are added up.

The order of the words comes from a table of at most ``TABLE`` words, the most
frequent ones.  Any order of words gives the same phrases; a word beyond the
table counts as rarer than those in it, and a bit field of fixed size tells
which of these can be frequent.  So what every task holds is bounded, and the
result does not depend on the bound.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import U64
from .common import checkpointed, forget, released, with_package

#: Words whose order is sent to every task, at most, and bits that tell which others may be frequent.
TABLE, FILTER_BITS = 1 << 21, 1 << 27
#: Occurrences of a word per part that its fragments are dealt to, each to a partition of its own.
SHARE = 1 << 19
#: Fragments that are mined at a time; more where one pivot has more, up to SHARE.
CHUNK_ROWS = 1 << 18
#: Bytes of text whose fragments are combined at a time; distinct words that a task counts or numbers at a time.
BLOCK, HELD_WORDS = 6 << 20, 500_000
#: Occurrences of a phrase, its words, phrases reported per language, and percent of its occurrences inside a longer phrase from which it is dropped.
LEAST, LONGEST, MOST, COVERED = 30, 4, 2000, 80
_SEED = 42
# upper-case ASCII letters become lower-case ones, every mark that ends a piece becomes a full stop
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b",;:!?\n\v\f\r", bytes(range(97, 123)) + b"." * 9)


def tokens(texts: Iterable[bytes]) -> list[bytes]:
    """The words of the texts, with b"." between pieces; no word holds that mark."""
    return b".".join(texts).translate(_FOLD).replace(b".", b" . ").split()


def _by_language(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[dict[str, list[bytes]]]:
    """Texts by language, about ``size`` bytes at a time."""
    held: dict[str, list[bytes]] = {}
    n = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            part = text.as_py()
            held.setdefault(lang.as_py(), []).append(part)
            n += len(part)
            if n >= size:
                yield held
                held, n = {}, 0
    if held:
        yield held


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    return with_package(docs).select(F.coalesce("lang", F.lit("und")).alias("lang"), text.alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of every word; a null word has all words of the language.  Each task adds up its own words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, words in seen.items():
                words.pop(b".", 0)
                said = pa.array([*words, None], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(said), pa.string()), said, pa.array([*words.values(), words.total()], pa.int64())], names=["lang", "word", "n"])
            seen.clear()

        for block in _by_language(batches, 1 << 20):
            for lang, texts in block.items():
                seen.setdefault(lang, Counter()).update(tokens(texts))
            if sum(map(len, seen.values())) >= HELD_WORDS:
                yield from counted()
        yield from counted()
        released()

    return _texts(docs).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class _Order:
    """How rare words are: a bounded table of the most frequent ones, and a bit field over the rest that are frequent."""

    def __init__(self, frequent: DataFrame, table: int = TABLE, bits: int = FILTER_BITS) -> None:
        named = frequent.select(F.xxhash64("lang", "word").alias("h"), "n")
        sizes = {r.c: r.n for r in named.groupBy(F.floor(F.log2("n")).alias("c")).agg(F.count("*").alias("n")).collect()}  # at most 64 classes
        least, kept = 64, 0
        for c in sorted(sizes, reverse=True):
            if kept + sizes[c] > table:
                break
            least, kept = c, kept + sizes[c]
        inside = F.floor(F.log2("n")) >= least
        top = named.where(inside).toArrow()  # at most ``table`` rows
        h, n = top["h"].to_numpy().view(U64), top["n"].to_numpy()
        by_count = np.lexsort((h, n))
        rank = np.empty(len(h), np.int64)
        rank[by_count] = np.arange(len(h))
        order = np.argsort(h)
        self.hashes, self.rank = h[order], rank[order].astype(np.int32)
        big = n[by_count]
        self.first_big = int(np.searchsorted(big, SHARE))
        self.shares = 1 + big[self.first_big :] // SHARE
        self.bits, self.filter = bits, None
        if kept < sum(sizes.values()):
            at = F.col("h").bitwiseAND(F.lit(bits - 1))
            words = named.where(~inside).groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h & 63 AS INT))")).alias("word")).toArrow()  # at most bits / 64 rows
            self.filter = np.zeros(bits // 64, np.int64)
            self.filter[words["at"].to_numpy()] = words["word"].to_numpy()

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, shares) of words by their hashes: the order is -1 for an infrequent word, and lower for a rarer one."""
        order, shares = np.full(len(h), -1, np.int64), np.ones(len(h), np.int64)
        if self.filter is not None:
            at = (h & U64(self.bits - 1)).astype(np.int64)
            maybe = (self.filter[at >> 6] >> (at & 63)) & 1 == 1
            order[maybe] = (h[maybe] >> U64(2)).astype(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[at] == h
            rank = self.rank[at[known]].astype(np.int64)
            order[known] = rank + (1 << 62)
            big = np.maximum(rank - self.first_big, -1)
            shares[known] = np.where(big >= 0, np.append(self.shares, 1)[big], 1)
        return order, shares


class _Words(dict):
    """Numbers of the words of one language, with their order; b"." is 0."""

    def __init__(self, lang: str, order: _Order) -> None:
        import xxhash

        super().__init__({b".": 0})
        self._of, self._hash = order, xxhash.xxh64_intdigest
        self._seed = self._hash(lang.encode(), _SEED)
        self.hashes, self.order, self.shares = np.zeros(1, U64), np.full(1, -1, np.int64), np.ones(1, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def numbers(self, said: list[bytes]) -> np.ndarray:
        known = len(self)
        out = np.fromiter(map(self.__getitem__, said), np.int64, len(said))
        if len(self) > known:
            new = list(self)[known:]
            h = np.fromiter((self._hash(w, self._seed) for w in new), U64, len(new))
            order, shares = self._of.of(h)
            self.hashes, self.order, self.shares = np.append(self.hashes, h), np.append(self.order, order), np.append(self.shares, shares)
        return out


def _row_keys(columns: Iterable[np.ndarray], base: int) -> np.ndarray:
    """One number for each row of ``columns`` of numbers below ``base``, equal for equal rows."""
    key, top = None, 1
    for c in columns:  # columns become one number; before it could overflow, its values are numbered anew
        if key is None:
            key, top = c, base
            continue
        if top * base >= 1 << 62:
            key, top = np.unique(key, return_inverse=True)[1], len(c)
        key, top = key * base + c, top * base
    return key


def fragment_block(word: np.ndarray, order: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, n): distinct fragments as rows of ``2 * longest - 1`` word numbers, 0 for none, the pivot in the middle, and how often each occurs.

    To the left of a pivot stand more frequent words only, to its right also
    the same one: so a phrase is owned by the first of its rarest words.
    """
    reach = longest - 1
    w = np.concatenate([np.zeros(reach, np.int64), word, np.zeros(reach, np.int64)])
    key = order[w]
    at = np.flatnonzero(key >= 0)
    mine, members = key[at], [w[at]]
    for side in (-1, 1):
        on = np.ones(len(at), bool)
        for k in range(1, reach + 1):
            there = at + side * k
            on &= key[there] > mine if side < 0 else key[there] >= mine
            members.insert(0 if side < 0 else len(members), np.where(on, w[there], 0))
    rows = np.stack(members, axis=1)
    rows = rows[(rows[:, reach - 1] > 0) | (rows[:, reach + 1] > 0)]
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    used = np.zeros(len(order), np.int64)
    used[rows] = 1
    base = int(used.sum()) + 1
    small = np.cumsum(used)[rows] * (rows > 0)  # 0 for none, and the block's own words from 1
    _, first, n = np.unique(_row_keys(small.T, base), return_index=True, return_counts=True)
    return rows[first], n


def fragments(docs: DataFrame, order: _Order, longest: int = LONGEST) -> DataFrame:
    """(lang, home, shared, at, text, n): rewritten fragments of ``docs``, at words before their pivot, and the partition key they are routed by."""
    sent = docs.sparkSession.sparkContext.broadcast(order)
    reach = longest - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Words] = {}
        for block in _by_language(batches):
            for lang, texts in block.items():
                words = held.setdefault(lang, _Words(lang, sent.value))
                members, n = fragment_block(words.numbers(tokens(texts)), words.order, longest)
                names = pa.array(words, pa.binary()).cast(pa.string())
                for k in range(0, len(n), 1 << 15):
                    some = members[k : k + (1 << 15)]
                    parts = [names.take(pa.array(c, mask=c == 0)) for c in some.T]
                    text = pc.binary_join_element_wise(*parts, " ", null_handling="skip")
                    pivot = some[:, reach]
                    columns = [pa.array([lang] * len(some), pa.string()), pa.array(words.hashes[pivot].view(np.int64)), pa.array(words.shares[pivot]), pa.array((some[:, :reach] > 0).sum(axis=1).astype(np.int32)), text, pa.array(n[k : k + (1 << 15)])]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "pivot", "shares", "at", "text", "n"])
                del names
            if sum(map(len, held.values())) >= HELD_WORDS:
                held.clear()
        held.clear()
        released()

    found = _texts(docs).mapInArrow(run, "lang string, pivot long, shares long, at int, text string, n long")
    shared = F.col("shares") > 1
    home = F.when(shared, F.xxhash64("pivot", F.pmod(F.xxhash64("text"), "shares"))).otherwise(F.col("pivot"))
    return found.select("lang", home.alias("home"), shared.alias("shared"), "at", "text", "n")


def mine_chunk(rows: pa.Table, least: int, longest: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, size, n) of the phrases that hold the pivots of ``rows``, all fragments of some pivots, ``least`` times; of shared pivots all.

    A phrase holds its pivot's left or right neighbour, so where a neighbour
    is too rare beside this pivot, no phrase reaches beyond the pivot there.
    """
    words = pc.split_pattern(rows["text"].combine_chunks(), " ")
    said = words.values.dictionary_encode()
    ids = said.indices.to_numpy().astype(np.int64) + 1
    offsets = words.offsets.to_numpy().astype(np.int64)
    langs = rows["lang"].combine_chunks().dictionary_encode()
    lang = langs.indices.to_numpy().astype(np.int64)
    n, at, shared = rows["n"].to_numpy(), rows["at"].to_numpy().astype(np.int64), np.asarray(rows["shared"])
    pivot = offsets[:-1] + at
    ids = ids[: offsets[-1]]
    base = max(len(said.dictionary), len(langs.dictionary)) + 2

    def member(k: int) -> np.ndarray:
        there = pivot + k
        inside = (there >= offsets[:-1]) & (there < offsets[1:])
        return np.where(inside, ids[np.where(inside, there, 0)], 0)

    def sums(some: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first row, place of each row's phrase, occurrences) of the phrases in ``columns`` of the rows ``some``."""
        _, first, of = np.unique(_row_keys([lang[some], *[c[some] for c in columns]], base), return_index=True, return_inverse=True)
        return some[first], of, np.bincount(of, n[some], len(first)).astype(np.int64)

    reach = longest - 1
    members = {k: member(k) for k in range(-reach, reach + 1)}
    for side in (-1, 1):
        some = np.flatnonzero(members[side])
        if len(some):
            _, of, count = sums(some, [members[0], members[side]])
            lost = some[(count[of] < least) & ~shared[some]]
            for k in range(1, reach + 1):
                members[side * k][lost] = 0
    names = said.dictionary
    for i in range(longest):
        for j in range(longest - i):
            if not i + j:
                continue
            columns = [members[k] for k in range(-i, j + 1)]
            some = np.flatnonzero((columns[0] > 0) & (columns[-1] > 0))
            if not len(some):
                continue
            first, _, count = sums(some, columns)
            kept = (count >= least) | shared[first]
            first, count = first[kept], count[kept]
            for k in range(0, len(first), 1 << 15):
                f = first[k : k + (1 << 15)]
                text = pc.binary_join_element_wise(*[names.take(pa.array(c[f] - 1)) for c in columns], " ")
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[f])), text, pa.array(np.full(len(f), i + j + 1, np.int32)), pa.array(count[k : k + (1 << 15)])], names=["lang", "phrase", "size", "n"])


def mined(routed: DataFrame, least: int, longest: int) -> DataFrame:
    """(lang, phrase, size, n) of ``routed`` fragments, which lie together by home: sums of whole pivots, or of a partition's part of a shared one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK_ROWS and held[0]["home"][0] != batch["home"][-1]:
                rows = pa.Table.from_batches(held)
                last = rows["home"].to_numpy()
                cut = int(np.flatnonzero(last != last[-1])[-1]) + 1  # the last pivot may go on
                yield from mine_chunk(rows.slice(0, cut), least, longest)
                held = rows.slice(cut).to_batches()
                n = rows.num_rows - cut
        if held:
            yield from mine_chunk(pa.Table.from_batches(held), least, longest)
        released()

    return routed.mapInArrow(run, "lang string, phrase string, size int, n long")


def _phrase(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, table: int = TABLE, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of all phrases of 1 to ``longest`` words that occur ``least`` times, and (lang, n) of all words; both checkpointed."""
    words = checkpointed(word_counts(docs).where((F.col("n") >= least) | F.col("word").isNull()))
    frequent = words.where("word IS NOT NULL")
    # every fragment goes once, to its pivot, and is mined there
    routed = fragments(docs, _Order(frequent, table, bits), longest).repartition("home").sortWithinPartitions("home")
    several = mined(routed, least, longest).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    out = checkpointed(several.unionByName(frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "n")))
    totals = checkpointed(words.where("word IS NULL").select("lang", "n"))
    forget(words)
    return out, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``most`` best phrases of 2 to ``longest`` words.

    A phrase with a occurrences, cut into parts with l and r, scores
    floor(2000000 a / (l + r)) at its worst cut, ties to the earliest.  One
    that lies inside a longer frequent phrase with ``covered`` percent of its
    occurrences is dropped.  Ties go by a, then by the phrase in byte order.

    Null texts count as empty, a null lang as und; repeated rows count each;
    very long texts are taken whole, as blocks of their own; a language of
    fewer phrases returns what it has, and an empty table gives none; other
    columns are not read.
    """
    known, totals = frequent_phrases(docs, least, longest)
    phrases = known.where("size > 1").withColumn("words", F.split("phrase", " "))
    # what is to be known of a phrase: the counts of its parts, and of longer phrases around it
    ks = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = phrases.select("lang", "phrase", "words", "size", ks)
    sides = F.inline(F.array(F.struct((F.col("k") * 2).alias("slot"), _phrase(F.col("words"), F.lit(1), F.col("k")).alias("part")), F.struct((F.col("k") * 2 + 1).alias("slot"), _phrase(F.col("words"), F.col("k") + 1, F.col("size") - F.col("k")).alias("part"))))
    asked = cuts.select("lang", "phrase", sides).withColumn("key", F.bitwise_not(F.xxhash64("lang", "part")))
    # a fresh key on both sides lets adaptive execution split a part that very many phrases have
    counts = known.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("n").alias("m"), F.bitwise_not(F.xxhash64("lang", "phrase")).alias("key"))
    parts = asked.join(counts, (asked["key"] == counts["key"]) & (asked["lang"] == counts["of"]) & (asked["part"] == counts["part"])).select(asked["lang"], "phrase", "slot", "m")
    inner = F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("inside")
    longer = phrases.where("size > 2").select("lang", "words", "size", "n", inner).select("lang", "words", "inside", "n", F.explode(F.expr("sequence(1, size - inside + 1)")).alias("at"))
    around = longer.select("lang", _phrase(F.col("words"), F.col("at"), F.col("inside")).alias("phrase"), F.lit(1).alias("slot"), F.col("n").alias("m"))
    own = phrases.select("lang", "phrase", F.lit(0).alias("slot"), F.col("n").alias("m"))
    slot = lambda s: F.max(F.when(F.col("slot") == s, F.col("m")))
    facts = own.unionByName(around).unionByName(parts).groupBy("lang", "phrase").agg(slot(0).alias("a"), F.coalesce(slot(1), F.lit(0)).alias("around"), *[slot(s).alias(f"s{s}") for s in range(2, 2 * longest)])
    score = lambda k: F.expr(f"CAST(a AS DECIMAL(19, 0)) * 2000000 div (CAST(s{2 * k} AS DECIMAL(19, 0)) + s{2 * k + 1})")
    cut = lambda k: F.when(F.col(f"s{2 * k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"s{2 * k}").alias("l"), F.col(f"s{2 * k + 1}").alias("r")))
    worst = F.array_min(F.array_compact(F.array(*[cut(k) for k in range(1, longest)])))
    left = facts.where(F.expr(f"CAST(around AS DECIMAL(19, 0)) * 100 < CAST(a AS DECIMAL(19, 0)) * {covered}")).select("lang", "phrase", "a", worst.alias("cut"))
    scored = left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's best are among the best of each of its parts
    some = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= most)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same phrases in DuckDB SQL: all phrases of 1 to 4 words are listed and counted.
ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda w: w <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM pieces, (SELECT unnest(range(1, 5)) AS size) WHERE len(w) >= size)),
known AS (SELECT lang, phrase, size, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
phrases AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM known WHERE size > 1),
longer AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS around
  FROM (SELECT lang, w, a, s, unnest(range(1, size - s + 2)) AS i FROM phrases, (SELECT unnest([2, 3]) AS s) WHERE s < size) GROUP BY ALL),
cuts AS (SELECT p.lang, p.phrase, a, k, l.f AS l, r.f AS r, CAST(CAST(a AS HUGEINT) * 2000000 // (l.f + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM phrases) p
  JOIN known l ON l.lang = p.lang AND l.phrase = array_to_string(p.w[1:k], ' ') JOIN known r ON r.lang = p.lang AND r.phrase = array_to_string(p.w[k + 1:p.size], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT worst.* FROM worst LEFT JOIN longer USING (lang, phrase) WHERE coalesce(100 * around < 80 * a, TRUE))
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= 2000
"""
