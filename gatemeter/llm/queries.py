"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from gatemeter.llm import (cover_codes, embedding_dedup, lm_score, minhash, mixing, packing, quality_crf, quality_rules,
                           token_count, topk_search, toxicity, url_filter, word_runs)
from gatemeter.llm.common import table

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.query(table(spark, sf_dir, "embeddings"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.query(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.query(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.query(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.query(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.query(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_codes.query(table(spark, sf_dir, "embeddings"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.query(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.query(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, QueryFn] = {f.__name__: f for f in (
    op1_embedding_near_dedup, op2_quality_rules, op3_mix_sources, op4_token_counts, op5_best_fit_packing,
    op6_url_filter, op7_toxicity, op8_quality_classifier, op9_lm_scoring, op10_minhash_near_dedup, op11_vector_codes,
    op12_exact_top_k, op13_periodic_runs, pipeline)}

ORACLES: dict[str, str] = {
    "op2_quality_rules": quality_rules.ORACLE_SQL, "op6_url_filter": url_filter.ORACLE_SQL,
    "op11_vector_codes": cover_codes.ORACLE_SQL, "op12_exact_top_k": topk_search.ORACLE_SQL}
