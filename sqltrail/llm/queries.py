"""The operators' registered queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, embedding_dedup, html_text, line_dedup, prefix_trie, quality, simhash, token_counts, toxicity, url_filter, warc, whitening
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(table(spark, sf_dir, "documents", "text", "lang"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"), rules)


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(spark, table(spark, sf_dir, "pages", "page_id", "url", "html"))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.report(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    return quality.report(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return toxicity.report(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": _op1,
        "op2_line_dedup": _op2,
        "op3_simhash_near_dedup": _op3,
        "op4_url_filters": _op4,
        "op5_html_extraction": _op5,
        "op6_byte_bpe": _op6,
        "op7_warc": _op7,
        "op8_decontamination": _op8,
        "op9_embedding_near_dedup": _op9,
        "op10_quality_classifier": _op10,
        "op11_embedding_whitening": _op11,
        "op12_toxicity": _op12,
        "op13_conversation_trie": _op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.ORACLE, "op4_url_filters": url_filter.ORACLE, "op13_conversation_trie": prefix_trie.ORACLE}
