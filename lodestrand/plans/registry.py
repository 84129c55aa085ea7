"""All queries over the virtual code graph and the plain tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrand.plans import queries_graph, queries_tables

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (queries_tables, queries_graph)


def queries() -> dict[str, Query]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task query, end to end: inverted index, scores, seeds."""
    return queries_graph.QUERIES["seed_topk"](spark, sf_dir)
