"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import analytics, answers, compliance, condition, extraction, graph, machines, mentions, reports, retrieval, signals, text

FAMILIES = (analytics, retrieval, text, extraction, graph, machines, mentions, reports, signals, compliance, answers, condition)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for family in FAMILIES for name, q in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
