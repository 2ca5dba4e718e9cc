"""Queries of the data-preparation operators that belong to the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covertrace.operators import delimited, instants, schema_drift
from covertrace.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.rejected_records(table(spark, sf_dir, "syndication_lines"))


def p2_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.loaded_records(table(spark, sf_dir, "syndication_lines"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.rejection_report(table(spark, sf_dir, "syndication_lines"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports = table(spark, sf_dir, "imports").where(F.col("payload").isin("import_rows", "syndication_lines"))
    return schema_drift.drift_log(imports, table(spark, sf_dir, "syndication_lines"), table(spark, sf_dir, "import_rows"))


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.unified_rows(table(spark, sf_dir, "syndication_lines"), table(spark, sf_dir, "import_rows"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instants.normalised_instants(table(spark, sf_dir, "import_rows"), table(spark, sf_dir, "campaigns"), table(spark, sf_dir, "imports"))


QUERIES = {f.__name__: f for f in (p2_found, p2_loaded, p2_report, p3_found, p3_unified, p7_found)}
SQL: dict[str, str] = {}
