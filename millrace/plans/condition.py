"""Queries on condition readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.implausible import implausible_readings
from millrace.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible_readings(table(spark, sf_dir, "reading")).select("reading_id")


def p4_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible_readings(table(spark, sf_dir, "reading"))


QUERIES = {"p4_found": p4_found, "p4_kinds": p4_kinds}
SQL: dict[str, str] = {}
