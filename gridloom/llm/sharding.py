"""Two-pass external shuffle into shards.

First pass: records are scattered uniformly over memory-sized buckets by a
seeded hash of doc_id and text, in which rows that repeat both very often are
told apart by their place in the input.  Second pass: each bucket is shuffled
in memory by Fisher-Yates.  Buckets laid end to end are one random permutation of
the corpus; records are dealt from it to the shards in turn, so shards differ
by at most one row and each is a random sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, MapType, StringType, StructField, StructType

from .common import checkpointed, columns_of, forget, split_join, with_package

#: Bytes in a bucket, about; a task holds one bucket and its shuffled copy.
BUCKET_BYTES = 16 << 20
#: Rows that repeat a doc_id and text are told apart if they are more than this share of a bucket.
HOT_SHARE = 1 / 16
#: Buckets whose sizes are added up in one task at a time.
SUMMED = 4096
#: Columns that ``external_shuffle`` adds; columns of these names in its input are left behind.
ADDED = ("shard", "slot", "bucket", "place")


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of range(n): from the end, each place swaps with a random one at or before it."""
    order = np.arange(n)
    swaps = np.random.default_rng(seed).integers(0, np.arange(1, n + 1)).tolist()
    items = order.tolist()
    for i in range(n - 1, 0, -1):
        j = swaps[i]
        items[i], items[j] = items[j], items[i]
    return np.array(items, np.int64)


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row, about: texts as they are, nested values as JSON, and 64 for the rest."""
    sized = F.lit(64).cast("long")
    for f in df.schema.fields:
        value = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, StringType | BinaryType):
            sized += F.coalesce(F.octet_length(value), F.lit(0))
        elif isinstance(f.dataType, ArrayType | MapType | StructType):
            sized += F.coalesce(F.octet_length(F.to_json(F.struct(value.alias("v")))), F.lit(0))
    return sized


def _before(sizes: DataFrame) -> DataFrame:
    """(bucket, before): rows in all buckets before each one of ``sizes`` (bucket, n); sums of SUMMED buckets are added up first."""
    ahead = lambda over, n: F.coalesce(F.sum(n).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = sizes.withColumn("many", F.call_function("div", F.col("bucket"), F.lit(SUMMED)))
    whole = grouped.groupBy("many").agg(F.sum("n").alias("n")).select("many", ahead(Window.orderBy("many"), "n").alias("start"))
    own = grouped.select("many", "bucket", ahead(Window.partitionBy("many").orderBy("bucket"), "n").alias("inside"))
    return own.join(whole, "many").select("bucket", (F.col("start") + F.col("inside")).alias("before"))


def external_shuffle(docs: DataFrame, shards: int = 8, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` (doc_id, text, other columns) with shard, slot (gapless from 0 in its shard), bucket and place (in its bucket).

    The same rows and seed give the same result however they are partitioned,
    unless rows of one doc_id and text (null ids and texts, say) are more than
    a bucket should hold: these are dealt by their place in the input, so the
    same files give the same result.  Equal texts are rows like any other and
    may go to different shards: the law counts rows alone.  Null and empty
    texts, null doc_ids and repeated rows are kept; a very long text may fill
    more than a bucket and stays whole; an empty table gives none; other
    columns pass through, but for those called as ADDED.
    """
    own = with_package(docs).drop(*ADDED)
    text = F.coalesce(F.col("text"), F.lit(""))
    bytes_ = _row_bytes(own)
    # one pass over the texts tells all sizes: rows and bytes of each scatter hash
    counted = checkpointed(own.select(F.xxhash64(F.lit(seed), F.col("doc_id"), text).alias("scatter"), bytes_.alias("bytes")).groupBy("scatter").agg(F.count("*").alias("copies"), F.sum("bytes").alias("held")))
    total = counted.agg(F.sum("held")).first()[0] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))
    # rows as one column, so that no name of theirs clashes
    ordered = [f"`{f.name.replace('`', '``')}`" for f in own.schema.fields if not f.dataType.simpleString().startswith(("map", "void")) and "map<" not in f.dataType.simpleString()]
    packed = own.select(F.xxhash64(F.lit(seed), F.col("doc_id"), text).alias("scatter"), bytes_.alias("bytes"), F.xxhash64(F.lit(seed + 1), *map(F.col, ordered)).alias("order"), F.monotonically_increasing_id().alias("turn"), F.struct(*columns_of(own)).alias("row"))
    hot = checkpointed(counted.where((F.col("copies") > 1) & (F.col("held") > bucket_bytes * HOT_SHARE)).select("scatter", F.lit(True).alias("hot")))
    bucket = F.pmod("scatter", F.lit(buckets)).cast("long").alias("bucket")
    if hot.isEmpty():
        mixed = packed.select("*", bucket)
        sizes = checkpointed(counted.groupBy(bucket).agg(F.sum("copies").alias("n")))
    else:
        told = F.when(F.col("hot"), F.xxhash64("scatter", "turn")).otherwise(F.col("scatter"))
        mixed = split_join(packed, hot, "scatter", "left").withColumn("bucket", F.pmod(told, F.lit(buckets)).cast("long"))
        sizes = checkpointed(mixed.groupBy("bucket").agg(F.count("*").alias("n")))
    forget(counted)
    done_schema = StructType([StructField("row", own.schema), StructField("bucket", LongType()), StructField("place", LongType()), StructField("before", LongType())])

    def shuffle(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        # the arrival order is no property of the rows: sort first, then shuffle
        table = table.take(pa.array(np.lexsort((table.column("turn").to_numpy(), table.column("order").to_numpy()))))
        table = table.take(pa.array(fisher_yates(table.num_rows, seed * 1_000_003 + bucket)))
        return table.append_column("place", pa.array(np.arange(table.num_rows))).select(["row", "bucket", "place", "before"])

    done = mixed.select("row", "order", "turn", "bucket").join(_before(sizes), "bucket").groupBy("bucket").applyInArrow(shuffle, done_schema)
    rank = F.col("before") + F.col("place")
    return done.select("row.*", F.pmod(rank, F.lit(shards)).cast("int").alias("shard"), F.call_function("div", rank, F.lit(shards)).alias("slot"), "bucket", "place")


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write ``external_shuffle``'s rows as Parquet, a folder for each shard; a file holds one bucket's rows of the shard or several, each in slot order."""
    shuffled.drop("bucket", "place").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def digests(shuffled: DataFrame) -> DataFrame:
    """``external_shuffle``'s rows with size and CRC32 in place of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return shuffled.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
