"""Named queries over the test tables and their SQL; filled by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def lab(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "injection_lab")


def load() -> None:
    """Import the query modules, which register themselves."""
    from . import corpus_queries, model_queries, score_queries, text_queries  # noqa: F401
