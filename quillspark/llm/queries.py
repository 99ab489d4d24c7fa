"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash_dedup

    return simhash_dedup.duplicates(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.rejected(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontamination

    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import license_scan

    return license_scan.licenses(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.repeats(_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.encoded(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id

    docs = _table(spark, sf_dir, "documents")
    return language_id.identified(docs, language_id.train(docs))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.judged(_table(spark, sf_dir, "documents"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embedding_dedup

    return embedding_dedup.duplicates(_table(spark, sf_dir, "embeddings"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat_format

    return chat_format.formatted(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from . import decontamination, embedding_dedup, license_scan, suffix_dedup

    return {
        "op1_embedding_dedup": embedding_dedup.ORACLE_SQL,
        "op9_suffix_dedup": suffix_dedup.ORACLE_SQL,
        "op4_decontamination": decontamination.ORACLE_SQL, "op8_license_scan": license_scan.oracle_sql(),
    }
