"""Registered queries of the training-data operators, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licences, lines, mixing, neighbours, packing, passages, quality, simhash, tokens, wrappers
from .common import read


def op1_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ledger(read(spark, sf_dir, "documents"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablation(quality.ledger(read(spark, sf_dir, "documents")))


def quality_learned_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.learned_ledger(docs, quality.abuse_terms(docs, read(spark, sf_dir, "labels")))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.knn(read(spark, sf_dir, "embeddings"), every=neighbours.EVERY)


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(read(spark, sf_dir, "documents"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(read(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(read(spark, sf_dir, "pages"))


def html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.wrappers(read(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_common_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"))


def op10_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_ledger,
        quality_ablation,
        quality_learned_ledger,
        op2_licence_scan,
        op3_nearest_neighbours,
        op4_simhash_groups,
        op5_repeated_passages,
        op6_html_extraction,
        html_wrappers,
        op7_best_fit_packing,
        op8_line_dedup,
        op9_token_counts,
        op10_source_schedule,
    )
}

ORACLES: dict[str, str] = {
    "op1_quality_ledger": quality.ledger_sql(),
    "quality_ablation": quality.ablation_sql(),
    "op3_nearest_neighbours": neighbours.knn_sql(),
    "op8_line_dedup": lines.drop_common_lines_sql(),
    "op10_source_schedule": mixing.schedule_sql(),
}
