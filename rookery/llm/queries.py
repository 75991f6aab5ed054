"""One query for each operator of this subpackage, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rookery.llm import chat, decontaminate, merkle, mixing, near_dedup, pieces, quality, secrets, sharding, topk, toxicity, trie, urls
from rookery.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.listed_table(spark, urls.RULES))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_planted(table(spark, sf_dir, "conversations"))
    return chat.digest(chat.format_conversations(chat.log_of_rows(rows)))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_decontaminate, op2_quality, op3_url_filter, op4_chat_format, op5_top_k,
            op6_shard, op7_toxicity, op8_sentencepiece, op9_near_dedup, op10_secret_scan,
            op11_merkle_manifest, op12_mix_sources, op13_prefix_trie,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.ORACLE_SQL,
        "op3_url_filter": urls.ORACLE_SQL,
        "op4_chat_format": chat.ORACLE_SQL,
        "op5_top_k": topk.ORACLE_SQL,
        "op6_shard": sharding.ORACLE_SQL,
        "op11_merkle_manifest": merkle.oracle_sql(),
        "op13_prefix_trie": trie.ORACLE_SQL,
    }
