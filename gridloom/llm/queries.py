"""The operators of this subpackage as queries over the ``documents`` table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_dedup, collocations, divergence, mixing, packing, parse_fingerprints, piece_codec, pu_quality, quality_rules, secret_scan, sharding, simhash, token_counts
from .common import documents


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find_secrets(documents(spark, sf_dir)))


def op5_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(sharding.external_shuffle(documents(spark, sf_dir).select("doc_id", "text")))


def op6_parse_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_fingerprints.fingerprint_documents(documents(spark, sf_dir))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(piece_codec.encode(documents(spark, sf_dir), _vocabulary("piece_bpe_32k.model")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"))


def op9_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pu_quality.score(docs, pu_quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op11_pivot_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = documents(spark, sf_dir).select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    return mixing.digests(mixing.mix(sized, F.col("words")))


def op13_vector_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chunk_dedup, op2_quality_rules, op3_pack_sequences, op4_secret_scan, op5_external_shuffle, op6_parse_fingerprints, op7_piece_codec, op8_token_counts, op9_simhash_near_duplicates, op10_pu_quality, op11_pivot_collocations, op12_budget_mix, op13_vector_divergence)}

ORACLES: dict[str, str] = {"op2_quality_rules": quality_rules.ORACLE, "op4_secret_scan": secret_scan.ORACLE, "op11_pivot_collocations": collocations.ORACLE, "op13_vector_divergence": divergence.ORACLE}
