"""All queries of the engine's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import context_queries, io_queries, retrieval_queries, rule_queries, text_queries, warehouse_queries

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (retrieval_queries, rule_queries, text_queries, warehouse_queries, context_queries, io_queries)


def queries() -> dict[str, Query]:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_queries.chunk_rank_global(spark, sf_dir)
