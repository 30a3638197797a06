"""The queries of the training-data operators and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm import chat, decontam, html, jaccard, quality, sharding, spbpe, sufdedup, unigram, urlrules
from taskloom.llm.common import table
from taskloom.llm.oracle import ORACLE_SQL

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2n (chosen) and 2n + 1 (rejected) are a pair."""
    return chat.preferences(table(spark, sf_dir, "conversations"), F.expr("conv_id div 2"), F.col("conv_id") % 2 == 0)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_sentencepiece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spbpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), with_decoded=False)


#: The byte limit of a shard.
SHARD_BYTES = 1 << 20


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sufdedup.dedup(table(spark, sf_dir, "documents"), with_kept=False)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.counts(table(spark, sf_dir, "documents"), unigram.vocabulary(tokenizer_path()))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
