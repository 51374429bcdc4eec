"""One query for each operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, conversation_repair, debruijn_dedup, decontaminate, feistel, jaccard_join, media, oracle, prefix_trie, quality, simhash, suffix_array_dedup, toxicity, training_order
from .common import table


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.payload_features(table(spark, sf_dir, "documents"))


def op2_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup.remove_repeats(spark, table(spark, sf_dir, "documents"), 50)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(spark, table(spark, sf_dir, "documents"), 4, 85)


def op5_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn_dedup.remove_repeats(spark, table(spark, sf_dir, "documents"), 20)


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.in_training_order(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), inside=True)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.shards(table(spark, sf_dir, "documents"), 16)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repairs(table(spark, sf_dir, "conversations"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(spark, table(spark, sf_dir, "documents"), 3)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark, table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op11_conversation_repair": oracle.REPAIR, "op13_prefix_trie": oracle.TRIE}
