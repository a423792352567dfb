"""Quality classifier by positive-unlabelled learning.

A small network over features of the whole text is fitted to trusted positives
and unlabelled web text by the non-negative unbiased risk

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]),   l(z) = log(1 + exp(-z)),

where prior is the share of positives in the unlabelled text, estimated from
the two samples alone (``estimated_prior``); labels of 0 are not read.  When
the bracket of a batch falls below zero its gradient is turned round, as the
method asks.  The sample that is fitted is bounded by
``MOST_POSITIVE`` and ``MOST_UNLABELLED`` and drawn by hashes of doc_id and text;
scoring is one narrow pass over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, number_spans
from .common import map_rows, released, text_or_empty, with_package

#: Bounds of the fitted sample: rows of it that reach the driver are at most their sum.
MOST_POSITIVE, MOST_UNLABELLED = 12_000, 24_000
#: A row's label is not learnt from if crc32(doc_id) mod FOLDS is HELD_OUT.
FOLDS, HELD_OUT = 4, 2
#: Least score of a predicted 1.
THRESHOLD = 0.7
FEATURES = (
    "words", "word_length", "symbols", "pipes", "shouts", "upper", "digits", "stops", "lines", "non_ascii", "short_words",
    "distinct_words", "repeat_next", "repeat_near", "repeat_pairs", "other_marks", "ends_in_mark", "longest_word",
)

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _bytes_in(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_KINDS = {
    "symbols": _bytes_in(b"#*$%&|<>"), "pipes": _bytes_in(b"|"), "shouts": _bytes_in(b"!?"), "upper": _bytes_in(bytes(range(65, 91))), "digits": _bytes_in(b"0123456789"),
    "stops": _bytes_in(b".,;:"), "lines": _bytes_in(b"\n"), "non_ascii": _bytes_in(bytes(range(0xC0, 0x100))), "other_marks": _bytes_in(b"\"'()[]{}/\\=+-_@^~`"),
}
_MARK = _bytes_in(bytes(c for c in range(33, 127) if not chr(c).isalnum()) + b"")
_MARK[list(b".,")] = False


def features(texts: list[str]) -> np.ndarray:
    """(len(texts), len(FEATURES)) shares and logarithms, over whole texts."""
    parts = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    docs = len(texts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    chars = np.maximum(1, np.array([len(t) for t in texts]))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _WHITE[data]])))
    starts, stops = edge[::2], edge[1::2]
    owner = np.searchsorted(begins, starts, "right") - 1
    count = lambda where: np.bincount(where, minlength=docs)
    n = count(owner)
    words = np.maximum(1, n)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    size = points[stops] - points[starts]
    out = {"words": np.log1p(n) / 3, "word_length": np.log1p(np.bincount(owner, size, docs) / words)}
    for name, table in _KINDS.items():
        total = np.concatenate([[0], np.cumsum(table[data])])
        out[name] = (total[ends] - total[begins]) / (chars if name in ("upper", "digits", "non_ascii") else words)
    number = number_spans(data, starts, stops)[0]
    word = number * docs + owner  # a text of its own is a block of its own, so no product overflows
    out["short_words"] = count(owner[size <= 3]) / words
    out["distinct_words"] = count(owner[_firsts(word)]) / words
    follows = lambda k: owner[k:][word[k:] == word[:-k]] if len(word) > k else owner[:0]
    out["repeat_next"] = count(follows(1)) / words
    out["repeat_near"] = (count(follows(2)) + count(follows(3)) + count(follows(4))) / words
    pair = word[:-1] * (number.max(initial=0) + 1) + number[1:]
    inside = owner[:-1] == owner[1:]
    out["repeat_pairs"] = 1 - count(owner[:-1][inside][_firsts(pair[inside])]) / np.maximum(1, n - 1)
    out["ends_in_mark"] = count(owner[_MARK[data[stops - 1]]]) / words
    longest = np.zeros(docs)
    np.maximum.at(longest, owner, size)
    out["longest_word"] = np.log1p(longest)
    return np.stack([out[f] for f in FEATURES], axis=1).astype(np.float32)


def _firsts(keys: np.ndarray) -> np.ndarray:
    _, at = np.unique(keys, return_index=True)
    return at


@dataclass(frozen=True)
class Model:
    """Means and scales of the features and the network's weights; ``weights`` is empty if there was nothing to learn from."""

    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Each row's probability of label 1; 0.5 without weights."""
        if not self.weights:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-_forward(self.weights, self.normal(x))[1]))

    def normal(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)


def _forward(w: tuple[np.ndarray, ...], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ w[0] + w[1])
    return hidden, np.clip(hidden @ w[2] + w[3], -30, 30)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among ``unlabelled`` rows, from trusted positives and them.

    A network learns to tell the two samples apart on one half of them.  Among
    the other half's highest scores nearly all unlabelled rows are positives,
    so there the share of unlabelled rows above a score, over the share of
    positives above it, is the prior; the score is the one at which that ratio
    with its sampling error is least (best bin estimation).
    """
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    apart = fit(positive[::2], unlabelled[::2], None, epochs=20)
    p, u = np.sort(apart.score(positive[1::2])), np.sort(apart.score(unlabelled[1::2]))
    at = np.unique(np.concatenate([p, u]))
    above_p, above_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
    error = np.sqrt(np.log(4 / 0.1) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    some = above_p > 0
    best = np.argmin((above_u[some] + 1.01 * error) / above_p[some])
    return float(np.clip(above_u[some][best] / above_p[some][best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, hidden: int = 16, epochs: int = 40, batch: int = 1024, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Minimise the non-negative risk over batches by Adam, or without ``prior`` the plain one of telling the samples apart; the same input gives the same model."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    model = Model(mean, scale, (), prior)
    p, u = model.normal(positive).astype(np.float64), model.normal(unlabelled).astype(np.float64)
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    rounds = max(1, -(-len(u) // batch))
    for _ in range(epochs):
        for us in np.array_split(rng.permutation(len(u)), rounds):
            xs_p, xs_u = p[rng.integers(0, len(p), min(batch, len(p)))], u[us]
            x = np.concatenate([xs_p, xs_u])
            h, g = _forward(tuple(w), x)
            is_p = np.arange(len(x)) < len(xs_p)
            up = 1 / (1 + np.exp(-g))  # l(-g)'s slope
            if prior is None:
                slope = np.where(is_p, (up - 1) / len(xs_p), up / len(xs_u))
            else:
                negative = np.where(is_p, -prior * up / len(xs_p), up / len(xs_u))
                loss = np.logaddexp(0, g)
                risk = loss[~is_p].mean() - prior * loss[is_p].mean()
                slope = np.where(is_p, prior * (up - 1) / len(xs_p), 0) + negative if risk >= 0 else -negative
            back = np.outer(slope, w[2]) * (1 - h * h)
            grads = [x.T @ back + decay * w[0], back.sum(axis=0), h.T @ slope + decay * w[2], slope.sum()]
            step += 1
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, tuple(w), 0.5 if prior is None else prior)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, seed: int = 11) -> Model:
    """A model from ``labels`` (doc_id, quality) and the texts of ``docs``; held-out rows take no part.

    At most ``most_positive`` doc_ids of label 1 are trusted, those of the
    least hashes, each by one of its texts; of all rows some are drawn by a
    hash of doc_id and text, and of those that repeat both one; in all no more
    than the sum of the bounds reach the driver, as features.  A doc_id with
    different labels counts as 0; labels without a document and null ids are
    passed over; a very long text counts whole and as one.  Without positives
    or texts the model scores 0.5.
    """
    usable = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    known = labels.where(usable & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = lambda h, share: F.pmod(h, F.lit(1 << 30)) < int(min(1, share) * (1 << 30))
    good = known.where("quality = 1").count()
    rows = docs.where(usable).count()
    none = Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), (), 0.5)
    if not good or not rows:
        return none
    label = F.xxhash64(F.lit(seed), "doc_id")
    trusted = known.where((F.col("quality") == 1) & drawn(label, most_positive / good)).orderBy(label, "doc_id").limit(most_positive).select("doc_id", F.lit(1).alias("_positive"))
    texts = text_or_empty(docs.where(usable), "doc_id").withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text"))
    texts = texts.join(F.broadcast(trusted), "doc_id", "left")  # at most most_positive ids
    texts = texts.withColumn("_drawn", drawn(F.col("_h"), most_unlabelled / rows).cast("int")).where("_positive = 1 OR _drawn = 1")
    # what a row is drawn as goes with its text as one number: the hash, and the doc_id of a trusted one
    drawn_as = F.struct(F.when(F.col("_positive") == 1, F.col("doc_id")).alias("trusted"), F.when(F.col("_drawn") == 1, F.col("_h")).alias("unlabelled"), F.col("_h").alias("h"))

    def run(batches):
        for b in batches:
            x = np.concatenate([np.zeros((0, len(FEATURES)), np.float32), *[features(some) for some in blocks(t.as_py() for t in b.column("text"))]])
            yield pa.RecordBatch.from_arrays([b.column("drawn_as"), pa.array([r.tobytes() for r in x], pa.binary())], names=["drawn_as", "x"])
        released()

    said = with_package(texts).select(drawn_as.alias("drawn_as"), "text").mapInArrow(run, "drawn_as struct<trusted:long, unlabelled:long, h:long>, x binary")
    sides = F.inline(F.array(F.struct(F.lit(1).alias("kind"), F.col("drawn_as.trusted").alias("key")), F.struct(F.lit(2).alias("kind"), F.col("drawn_as.unlabelled").alias("key"))))
    each = said.select(sides, F.col("drawn_as.h").alias("h"), "x").where("key IS NOT NULL").groupBy("kind", "key").agg(F.min_by("x", F.struct("h", "x")).alias("x"))
    bounded = each.orderBy("kind", F.xxhash64("key"), "key").limit(most_positive + most_unlabelled)
    sample = sorted((r.kind, bytes(r.x)) for r in bounded.collect())
    kinds = np.array([k for k, _ in sample])
    x = np.frombuffer(b"".join(b for _, b in sample), np.float32).reshape(-1, len(FEATURES))
    positive, unlabelled = x[kinds == 1], x[kinds == 2]
    if not len(positive) or not len(unlabelled):
        return none
    return fit(positive, unlabelled, estimated_prior(positive, unlabelled))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text), from the text alone.

    Null texts count as empty, which are scored like any other; a null doc_id
    is kept and not held out; repeated rows are scored each; very long texts
    are scored by all of their words; an empty table gives none; other columns
    are not read.
    """

    def make():
        def work(ids, texts):
            s = model.score(features(texts))
            return {"doc_id": pa.array(ids, pa.int64()), "score": s}

        return work

    scored = map_rows(text_or_empty(docs, "doc_id"), make, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score at least THRESHOLD, with all their columns, in one pass over them; all rows if ``model`` has no weights, as nothing was learnt.

    Null texts are scored as empty ones, a null doc_id is a row like any
    other, repeated rows score alike, and an empty table gives none.
    """
    if not model.weights:
        return docs

    def run(batches):
        for b in batches:
            texts = (t.as_py() for t in b.column("text"))
            kept = [model.score(features(some)) >= THRESHOLD for some in blocks(texts)]
            yield b.filter(pa.array(np.concatenate([np.zeros(0, bool), *kept])))
        released()

    return with_package(docs).mapInArrow(run, docs.schema)
