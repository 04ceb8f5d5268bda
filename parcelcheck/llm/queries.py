"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from parcelcheck.llm import (
    backtrack_bpe,
    chat_events,
    disclosure,
    entropy_mix,
    fuzzy_lines,
    nearest_centroid,
    norm_buckets,
    pairwise_quality,
    rule_ledger,
    secret_scan,
    token_alignment,
    trie_join,
    weighted_sampling,
)
from parcelcheck.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_quality.pairwise_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ledger.rule_ledger(table(spark, sf_dir, "documents"))


def op3_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix.entropy_mix(table(spark, sf_dir, "documents"))


def op4_backtrack_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return backtrack_bpe.round_trip(table(spark, sf_dir, "documents"), path)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op6_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_events.chat_events(table(spark, sf_dir, "conversations"))


def op7_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_join.trie_join(table(spark, sf_dir, "documents"))


def op8_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.weighted_sampling(table(spark, sf_dir, "documents"))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.fuzzy_lines(table(spark, sf_dir, "documents"))


def op10_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_centroid.nearest_centroid(table(spark, sf_dir, "documents"))


def op11_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.disclosure(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return token_alignment.token_alignment(table(spark, sf_dir, "documents"), *paths)


def op13_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_buckets.norm_buckets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


LLM_QUERIES: dict[str, Query] = {
    "op1_pairwise_quality": op1_pairwise_quality,
    "op2_rule_ledger": op2_rule_ledger,
    "op3_entropy_mix": op3_entropy_mix,
    "op4_backtrack_bpe": op4_backtrack_bpe,
    "op5_secret_scan": op5_secret_scan,
    "op6_chat_events": op6_chat_events,
    "op7_trie_join": op7_trie_join,
    "op8_weighted_sampling": op8_weighted_sampling,
    "op9_fuzzy_lines": op9_fuzzy_lines,
    "op10_nearest_centroid": op10_nearest_centroid,
    "op11_disclosure": op11_disclosure,
    "op12_token_alignment": op12_token_alignment,
    "op13_norm_buckets": op13_norm_buckets,
}

LLM_ORACLES: dict[str, str] = {
    "op2_rule_ledger": rule_ledger.SQL,
    "op6_chat_events": chat_events.SQL,
    "op13_norm_buckets": norm_buckets.SQL,
}
