"""The queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from heddle.llm import oracle
from heddle.llm.chat import digests, format_conversations, with_probe
from heddle.llm.common import table
from heddle.llm.packing import pack
from heddle.llm.pii import personal_data
from heddle.llm.quality import quality
from heddle.llm.secrets import secrets
from heddle.llm.sharding import shard_documents
from heddle.llm.simhash import simhash_groups
from heddle.llm.suffix import remove_repeats
from heddle.llm.tokens import token_counts
from heddle.llm.wumanber import decontaminate


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(format_conversations(with_probe(table(spark, sf_dir, "conversations"), spark)))


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


_ALL = (
    op1_personal_data, op2_benchmark_decontamination, op3_token_counts, op4_suffix_dedup, op5_secrets, op6_quality_rules,
    op7_packing, op8_chat_format, op9_simhash_groups, op10_sharding,
)
QUERIES = {f.__name__: f for f in _ALL}

#: DuckDB SQL where it can express a query; the others are tested against brute force in tests/llm.
ORACLE_SQL = {"op2_benchmark_decontamination": oracle.OP2, "op6_quality_rules": oracle.OP6, "op8_chat_format": oracle.OP8}
