"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from covertrace.llm import abuse, batch_dedup, encodings, leakage, name_variants, packing, representatives
from covertrace.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representatives.best_members(table(spark, sf_dir, "articles"))


def p1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representatives.scored_members(table(spark, sf_dir, "articles"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.tied_names(table(spark, sf_dir, "import_rows"), table(spark, sf_dir, "outlets"), table(spark, sf_dir, "contributors"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_dedup.skipped_duplicates(table(spark, sf_dir, "articles"), table(spark, sf_dir, "incoming_articles"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.damaged_fields(table(spark, sf_dir, "articles")).select("article_id", "field_name")


def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.damaged_fields(table(spark, sf_dir, "articles"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def p8_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.window_report(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leak_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.abusive_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.abuse_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.source_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_members, p4_found, p5_found, p6_found, p6_restored, p8_packed, p8_windows, p9_found, p9_scores, p10_found, p10_scores, p10_rates)}
SQL: dict[str, str] = {}
