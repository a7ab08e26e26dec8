"""Sinks: metadata tables as Parquet, and the bundle that a device takes along offline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.vectors import quantised


def store(rows: DataFrame, folder: str, key: str, newest: str) -> None:
    """Rows added to a metadata table, one row a key: the one of the newest ``newest`` wins, of equals the new one.

    The table is written beside the old one and read from there on, so a writer that dies
    leaves the old table whole. folder/_current names the version in use.
    """
    spark = rows.sparkSession
    old, version = current(spark, folder)
    both = rows.withColumn("_new", F.lit(1)) if old is None else rows.withColumn("_new", F.lit(1)).unionByName(old.withColumn("_new", F.lit(0)), allowMissingColumns=True)
    columns = [c for c in both.columns if c not in (key, "_new")]
    kept = both.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(newest, "_new")).alias("r")).select(key, "r.*")
    kept.write.parquet(f"{folder}/v{version + 1}")
    spark.createDataFrame([(version + 1,)], "version int").coalesce(1).write.mode("append").json(f"{folder}/_current")


def current(spark: SparkSession, folder: str) -> tuple[DataFrame | None, int]:
    """(the table in use or None, its version)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_current")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None, 0
    version = spark.read.schema("version int").json(f"{folder}/_current").agg(F.max("version")).first()[0] or 0
    return (spark.read.parquet(f"{folder}/v{version}") if version else None), version


def index_bytes(vector: Column) -> Column:
    """A vector as base64 of one signed byte a dimension."""
    hexed = F.transform(quantised(vector), lambda x: F.lpad(F.hex(F.pmod(x.cast("int"), F.lit(256))), 2, "0"))
    return F.base64(F.unhex(F.array_join(hexed, "")))


def bundle(passages: DataFrame, group: str) -> DataFrame:
    """(group, payload): a group's passages as one JSON text, by id. passages: group, id, text, vector; a bundle is bounded
    by the budget that chose its passages."""
    item = F.struct("id", "text", index_bytes(F.col("vector")).alias("index"))
    return passages.groupBy(group).agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("passages"))).alias("payload"))
