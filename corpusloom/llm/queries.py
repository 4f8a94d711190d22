"""Queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, counts, decon, lines, maxent, ngramjoin, quality, substring, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decon.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op3_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(_table(spark, sf_dir, "conversations"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return maxent.score(docs, maxent.fit(docs))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.recount(_table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "text", "__dropped").withColumnRenamed("__dropped", "n_dropped")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_warc_index, op3_chat_collapse, op4_lm_scores, op5_token_counts, op6_ngram_jaccard_join, op7_quality_rules, op8_line_dedup, op9_byte_bpe, op10_substring_dedup)}

ORACLES: dict[str, str] = {"op2_warc_index": warc.ORACLE, "op3_chat_collapse": chat.ORACLE, "op7_quality_rules": quality.ORACLE, "op8_line_dedup": lines.ORACLE}
