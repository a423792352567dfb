"""Mixing sources to target weights by fitting the budget of each as a subset sum.

Sources share all words by weight; one that would have to repeat more than
``MOST_REPEATS`` times stops there, and what it leaves is shared again.  A
source's whole repeats take all of its documents.  What remains of its target
is fitted over the counts of its documents by exact length: of a large budget
an even share of every length first, then the longest lengths that fit, and
the last words, or a small budget, by a bounded-knapsack dynamic programme.  It says how many documents of each length
are taken once more; which ones is decided by a seeded hash, by distributed
selection: no group of documents of one length is ever in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, forget, with_package

#: Weights of the sources in order, repeated; times that a document is taken, at most.
WEIGHTS, MOST_REPEATS = (5, 2, 1), 3
#: Words that are left to the dynamic programme, at most, wherever shorter documents can take the rest.
EXACT = 1 << 16
#: Rows that are ranked in one group, about.
RANKED = 1 << 14
SEED = 17


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``sizes`` (source, source_size; one row a source) with target, a double.

    Sources in order, null last, have the weights in turn.  Targets are
    proportional to the weights but for sources that stop at ``most`` times
    their size: the common factor is raised until no more sources stop.
    """
    # a source's place is its partition's start and its place there: no task sees all sources
    ordered = sizes.withColumn("_last", F.col("source").isNull())
    placed = checkpointed(ordered.repartitionByRange("_last", "source").sortWithinPartitions("_last", "source").withColumn("_id", F.monotonically_increasing_id()))
    counts = placed.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.count("*").alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # one row a partition
    own = placed.withColumn("_part", F.shiftright("_id", 33)).join(starts, "_part")
    place = F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    weighed = checkpointed(own.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("most")))
    factor, stopped = 0.0, -1
    while True:
        stops = F.col("most") < F.col("weight") * factor
        n, held, open_weight, total = weighed.agg(
            F.count_if(stops), F.coalesce(F.sum(F.when(stops, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~stops, F.col("weight"))), F.lit(0.0)), F.coalesce(F.sum("source_size"), F.lit(0))
        ).first()
        if n == stopped or not open_weight:
            break
        factor, stopped = (total - held) / open_weight, n
    return weighed.select("source", "source_size", F.least(F.col("most"), F.col("weight") * factor).alias("target"))


def fitted(size: np.ndarray, count: np.ndarray, budget: int, exact: int = EXACT) -> np.ndarray:
    """How many documents of each ``size`` (distinct, above 0), of ``count`` each, are taken so that their words come near ``budget``, at most all words.

    Up to ``exact`` words no sum of documents is nearer.  Beyond, every length
    gives its even share first, and the same holds for what is left.
    """
    whole = int((size * count).sum())
    taken = np.zeros(len(size), np.int64)
    if not len(size) or budget <= 0:
        return taken
    if budget >= whole:
        return count.copy()
    if budget > exact:
        taken = np.array([int(c) * budget // whole for c in count], np.int64)  # an even share; products may pass 64 bits
    left = budget - int((size * taken).sum())
    down = np.argsort(-size)
    for i in down:
        if left <= exact:
            break
        more = min(int(count[i] - taken[i]), (left - exact) // int(size[i]) if left - exact >= size[i] else int(left >= size[i]))
        taken[i] += more
        left -= more * int(size[i])
    # what is left: the least part that each sum was first reached with; parts are doubled counts of one length
    top = 2 * left + 1
    first, parts = np.full(top, -1, np.int64), []
    reached = np.zeros(top, bool)
    reached[0] = True
    for i in np.random.default_rng(SEED).permutation(len(size)):  # no length goes before others
        if reached[left]:
            break
        spare, step = min(int(count[i] - taken[i]), (top - 1) // int(size[i])), 1
        while spare:
            n = min(step, spare)
            words = n * int(size[i])
            new = np.flatnonzero(reached[: top - words] & ~reached[words:]) + words if words < top else np.zeros(0, np.int64)
            first[new] = len(parts)
            reached[new] = True
            parts.append((i, n, words))
            spare, step = spare - n, step * 2
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - left))])
    while at:
        i, n, words = parts[first[at]]
        taken[i] += n
        at -= words
    return taken


def _fits(lengths: DataFrame, exact: int) -> DataFrame:
    """(source, size, n, repeats, k) of ``lengths`` (source, size, n, source_size, target): whole repeats, and documents of the length that are taken once more."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        whole, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        repeats = int(target // whole) if whole else 0
        budget = round(target - repeats * whole)
        size, count = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        k = np.zeros(len(size), np.int64)
        k[size > 0] = fitted(size[size > 0], count[size > 0], budget, exact)
        return pd.DataFrame({"source": rows["source"], "size": size, "n": count, "repeats": repeats, "k": k})

    return with_package(lengths).groupBy("source").applyInPandas(fit, "source string, size long, n long, repeats long, k long")


def first_k(rows: DataFrame, group: str, n: str, k: str, order: Sequence[str], ranked: int = RANKED) -> DataFrame:
    """``rows`` with _in: whether a row is among its group's first ``k`` of ``n`` by the columns of ``order`` (longs of even spread, the last one distinct).

    Each column in turn splits the groups into even ranges, as many as their
    rows need; counting decides all ranges but the one that the k-th row is
    in.  Its rows are ranked, or split by the next column if they are many.
    """
    plain = F.col(k) <= 0, F.col(k) >= F.col(n)
    done = [rows.where(plain[0] | plain[1]).withColumn("_in", plain[1] & ~plain[0])]
    open_rows = rows.where(~plain[0] & ~plain[1]).withColumn("_k", F.col(k)).withColumn("_n", F.col(n))
    for by in order:
        bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / ranked))).cast("int")
        unsigned = F.col(by).bitwiseXOR(F.lit(-(1 << 63)))  # ascending longs as ascending bits
        span = F.when(bits == 0, F.lit(0)).otherwise(F.call_function("shiftrightunsigned", unsigned, 64 - bits))
        spread = checkpointed(open_rows.withColumn("_span", span))
        counts = spread.groupBy(group, "_span").agg(F.count("*").alias("_m"), F.first("_k").alias("_want"))
        before = F.coalesce(F.sum("_m").over(Window.partitionBy(group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        edge = counts.select(F.col(group).alias("_of"), F.col("_span").alias("_edge"), "_m", "_want", before.alias("_before")).where("_before < _want AND _want <= _before + _m")
        key = F.bitwise_not(F.col(group))  # not partitioned by it yet, so a group of many rows can be split
        met = spread.withColumn("_key", key).join(edge.withColumn("_key", F.bitwise_not(F.col("_of"))), "_key")
        done.append(met.where("_span <> _edge").withColumn("_in", F.col("_span") < F.col("_edge")).select(*rows.columns, "_in"))
        met = met.where("_span = _edge").select(*rows.columns, (F.col("_want") - F.col("_before")).alias("_k"), F.col("_m").alias("_n"))
        few = (F.col("_n") <= 8 * ranked) if by != order[-1] else F.lit(True)
        place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
        done.append(met.where(few).withColumn("_in", place <= F.col("_k")).select(*rows.columns, "_in"))
        open_rows = met.where(~few)
    return reduce(DataFrame.unionByName, done)


def mix(docs: DataFrame, size: Column | None = None, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED, exact: int = EXACT, ranked: int = RANKED) -> DataFrame:
    """``docs`` (doc_id, source, text, or any column that ``size`` counts) with size, source_size, target, copies and taken.

    copies says how often the mix takes the document, 0 to ``most``; taken is
    that many times its size.  The sum of taken of a source is as near to its
    target as the lengths of its documents allow (see ``fitted``).  Columns
    pass through a checkpoint, so large ones are better joined by doc_id
    afterwards; input columns called as the added ones are replaced.

    Null texts have no words; a null source is a source, the last one; empty
    texts and sources of no words take nothing; rows that repeat a doc_id and
    a text are documents of their own, and it is the place of one in the input
    that decides when some of them are taken; very long texts are counted
    whole; an empty table gives none.
    """
    size = word_count(F.col("text")) if size is None else size
    added = ("size", "source_size", "target", "copies", "taken")
    own = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c not in added]
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), *([F.col("text")] if "text" in docs.columns else []))
    rows = checkpointed(docs.select(F.struct(*own).alias("own"), F.col("source").alias("source"), size.alias("size"), key.alias("_one")).withColumn("_two", F.xxhash64(F.monotonically_increasing_id())))
    lengths = checkpointed(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = checkpointed(source_targets(sizes, weights, most))
    named = targets.withColumnRenamed("source", "of")
    fits = _fits(lengths.join(named, lengths["source"].eqNullSafe(named["of"])).drop("of"), exact)
    group = F.xxhash64(F.col("source").isNull(), "source", "size")
    plan = checkpointed(fits.join(named, fits["source"].eqNullSafe(named["of"])).select(group.alias("_group"), "n", "k", "repeats", "source_size", "target"))
    joined = rows.withColumn("_key", F.bitwise_not(group)).join(plan.withColumn("_key", F.bitwise_not("_group")), "_key").drop("_key")
    decided = first_k(joined, "_group", "n", "k", ["_one", "_two"], ranked)
    copies = F.col("repeats") + F.col("_in").cast("long")
    return decided.select("own.*", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def digests(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
