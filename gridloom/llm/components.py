"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, forget, split_join


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a long, b long): label is the component's smallest node.  No edges: no rows.

    Every round links nodes to the smallest neighbour they know; rounds are
    kept in the shared checkpoint folder, and end when the edge set stays as
    it is.  Rows never grow beyond the edges; minima are combined before the
    shuffle, and joins on a node of many edges are split by adaptive execution.
    """
    stars = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = split_join(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = split_join(large, least, "u")
        old, stars = stars, checkpointed(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        forget(old)
        was, state = state, _state(stars)
        if was == state:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _state(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())
